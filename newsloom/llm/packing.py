"""Texts of varying length combined into containers of fixed capacity.

A dynamic program over the global histogram of sizes chooses the length buckets that pad least. Inside each bucket, batches form by token budget: items of
that bucket alone whose tokens fill a container but for SLACK. What no bucket can fill by itself (above all items of more than half the capacity) is left for
a last step, which combines the leftovers of all buckets, largest first; the shortest items are held back for it, as many as the leftovers have room for.
All of that happens on the counts of the sizes, of which there are at most as many as the capacity; the rows only learn their rank
among the items of their size and look up their container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import tokens
from newsloom.session import broadcast_if_small, materialise, spread

CAPACITY = 2048
#: Length buckets that the dynamic program may use, far fewer than sizes: a bucket must be wide enough for its items' sizes to add up to the capacity.
BUCKETS = 16
#: Unused tokens with which a batch inside a bucket still counts as full.
SLACK = CAPACITY // 512
#: Held back of the shortest items for the last step, in parts of the room that its items leave.
HELD = 1.05
#: Rows of one size that are ranked in one task; larger ones are split by a salt.
RANKED = 200_000


def bucket_bounds(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding, if each size is rounded up to its bucket's bound.

    counts[s] is the number of items of size s. Exact, by dynamic programming over the sizes that occur.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    k = min(buckets, len(sizes))
    if k == len(sizes):
        return sizes.tolist()
    n = np.concatenate([[0], np.cumsum(counts[sizes])]).astype(np.float64)
    weight = np.concatenate([[0], np.cumsum(counts[sizes] * sizes)]).astype(np.float64)
    upper = sizes.astype(np.float64)
    # cost[i, j]: padding of one bucket with the sizes i..j
    cost = upper[None, :] * (n[None, 1:] - n[:-1, None]) - (weight[None, 1:] - weight[:-1, None])
    cost[np.tril_indices(len(sizes), -1)] = np.inf
    best, cuts = cost[0].copy(), []
    for _ in range(k - 1):
        total = best[:-1, None] + cost[1:, :]
        choice = total.argmin(axis=0)
        new = total[choice, np.arange(len(sizes))]
        cuts.append(np.where(new < best, choice, -1))
        best = np.minimum(new, best)
    bounds, j = [], len(sizes) - 1
    for step in reversed(cuts):
        bounds.append(int(sizes[j]))
        if step[j] < 0:
            continue
        j = int(step[j])
    bounds.append(int(sizes[j]))
    return sorted(set(bounds))


Pattern = tuple[dict[int, int], int]


def bucket_batches(left: list[int], low: int, high: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[Pattern]:
    """Batches of the items with sizes from low to high alone: patterns (how many of each size) that leave at most slack unused, and how often each occurs.

    A pattern begins with the largest size and goes on with the sizes nearest to an even share of the rest, each chosen so that whole items of the bucket can still
    fill what remains. It is repeated as often as its sizes last, so that there are few patterns whatever the counts. A size that heads no full pattern is left.
    """
    out: list[Pattern] = []
    own = [s for s in range(high, low - 1, -1) if left[s]]
    while own:
        room, used, least, most = capacity, {}, own[-1], own[0]
        while room >= least:
            share = room / (room // least)
            for s in sorted(own, key=lambda s: abs(s - share)) if used else own:
                rest = room - s
                if rest < 0 or used.get(s, 0) >= left[s]:
                    continue
                more = rest // least
                if rest <= slack or more and more * most >= rest - slack:
                    used[s], room = used.get(s, 0) + 1, rest
                    break
            else:
                break
        if not used or room > slack:
            own = own[1:]
            continue
        out.append((used, _repeat(used, left)))
        own = [s for s in own if left[s]]
    return out


def mixed_batches(left: list[int], capacity: int = CAPACITY) -> list[Pattern]:
    """The last step: patterns over all sizes that are left, each taking the largest that fits, again and again."""
    out: list[Pattern] = []
    own = [s for s in range(capacity, 0, -1) if left[s]]
    while own:
        room, used = capacity, {}
        for s in own:
            if take := min(room // s, left[s]):
                used[s] = take
                room -= take * s
        out.append((used, _repeat(used, left)))
        own = [s for s in own if left[s]]
    return out


def _repeat(used: dict[int, int], left: list[int]) -> int:
    times = min(left[s] // n for s, n in used.items())
    for s, n in used.items():
        left[s] -= n * times
    return times


def held_back(counts: np.ndarray, bounds: list[int], capacity: int = CAPACITY, slack: int = SLACK, share: float = HELD) -> list[int]:
    """How many of each size wait for the last step: the shortest, with share times the tokens that the buckets which can't fill a container leave unused."""
    room, low = 0.0, 1
    sizes = np.arange(len(counts))
    for high in bounds:
        n, tokens_in = int(counts[low : high + 1].sum()), float((counts * sizes)[low : high + 1].sum())
        fit = capacity // high
        if n and fit * high < capacity - slack and (fit + 1) * low > capacity:
            room += n / fit * capacity - tokens_in
        low = high + 1
    held, got = [0] * len(counts), 0
    for s in range(1, capacity):
        if got >= room * share:
            break
        held[s] = min(int(counts[s]), int(-(-(room * share - got) // s)))
        got += held[s] * s
    return held


def plan(counts: np.ndarray, buckets: int = BUCKETS, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[list[int], np.ndarray, int]:
    """Bounds of the buckets, segments (size, first rank, container of the first rank, items per container, bound of the bucket or 0 in the last step), and the number of containers."""
    bounds = bucket_bounds(counts, buckets)
    held = held_back(counts, bounds, capacity, slack)
    left = [int(c) - h for c, h in zip(counts, held)]
    patterns: list[tuple[dict, int, int]] = []
    low = 1
    for high in bounds:
        patterns += [(used, times, high) for used, times in bucket_batches(left, low, high, capacity, slack)]
        low = high + 1
    left = [a + b for a, b in zip(left, held)]
    patterns += [(used, times, 0) for used, times in mixed_batches(left, capacity)]
    cursor = [0] * len(left)
    segments, containers = [], 0
    for used, times, of in patterns:
        for s, n in used.items():
            segments.append((s, cursor[s], containers, n, of))
            cursor[s] += n * times
        containers += times
    return bounds, np.array(sorted(segments), np.int64).reshape(-1, 5), containers


def _pieces(folder: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokens.encoding(folder).encode_ordinary
        for b in batches:
            memo: dict = {}
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = memo.get(text)
                if n is None:
                    n = memo[text] = len(size(text)) if text else 0
                for piece, start in enumerate(range(0, max(n, 1), capacity)):
                    rows.append((doc, piece, start, min(capacity, n - start)))
            if rows:
                doc, piece, start, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], names=["doc_id", "piece", "token_start", "n_tokens"])

    return run


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, folder: str = tokens.TOKENIZERS) -> tuple[DataFrame, np.ndarray]:
    """The pieces of all texts with their sizes, written, and the histogram of sizes: at most capacity + 1 rows come to the driver."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    items = materialise(rows.mapInArrow(_pieces(folder, capacity), "doc_id bigint, piece int, token_start bigint, n_tokens int"), "sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in items.groupBy("n_tokens").count().collect():
        counts[n] = c
    counts[0] = 0
    return items, counts


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, container, bucket, mixed: every document in a container of at most capacity tokens.

    bucket is the upper bound of the item's length bucket; mixed tells whether its container comes from the last step, all others hold items of one bucket.
    Only a text of more than capacity tokens is split, into full pieces and a rest. A null, empty text has no tokens, takes no room
    and goes to container 0, bucket 0. Repeated rows are items of their own; other columns are left out; an empty table gives none.
    """
    items, counts = sized(docs, doc_id, text, capacity, folder)
    bounds, segments, _ = plan(counts, buckets, capacity, capacity // 512)

    salts = int(counts.max(initial=0)) // RANKED + 1
    salted = items.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    group = W.partitionBy("n_tokens", "salt")
    ranked = salted.withColumn("rank", F.row_number().over(group.orderBy("doc_id", "piece")) - 1)
    if salts > 1:
        held = salted.groupBy("n_tokens", "salt").count()
        before = held.withColumn("before", F.sum("count").over(W.partitionBy("n_tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).na.fill(0, ["before"])
        ranked = ranked.join(broadcast_if_small(before.drop("count")), ["n_tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 44  # ranks stay below
        keys = segments[:, 0] * shift + segments[:, 1]
        upper = np.array(bounds, np.int32)
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            at = np.searchsorted(keys, size * shift + rank, side="right") - 1
            container = segments[at, 2] + (rank - segments[at, 1]) // segments[at, 3]
            bucket = upper[np.searchsorted(upper, size)] if len(upper) else size.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in range(4)], pa.array(container, pa.int64()), pa.array(bucket, pa.int32()), pa.array(segments[at, 4] == 0)], names=names)

    schema = "doc_id bigint, piece int, token_start bigint, n_tokens int, container bigint, bucket int, mixed boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    placed = ranked.select("doc_id", "piece", "token_start", "n_tokens", F.col("rank").cast("bigint")).mapInArrow(place, schema)
    empty = items.where("n_tokens = 0").withColumns({"container": F.lit(0).cast("bigint"), "bucket": F.lit(0), "mixed": F.lit(False)})
    return placed.unionByName(empty)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def p8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan does with each length bucket: its bound, items, containers that it fills alone, and the items that go to the last step."""
    packed = p8_containers(spark, sf_dir).where("n_tokens > 0")
    alone = F.when(~F.col("mixed"), F.col("container"))
    per = packed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"), F.count_distinct(alone).alias("containers_alone"), F.count_if("mixed").alias("items_mixed"))
    return per
