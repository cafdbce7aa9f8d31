"""Records that share most of their writing: PartEnum signatures over weighted min-wise coordinates, then an exact check.

Each text is the set of its word shingles. The shingle domain is mapped to COORDINATES min-wise coordinates, in which a pair of sets agrees with the
probability of its (weighted) similarity; a coordinate prefers shingles that few texts have, so that boilerplate doesn't make candidates. PartEnum
partitions the coordinates into FIRST parts of SECOND coordinates and enumerates, in each part, the subsets that leave one coordinate out: sets of one size
band that agree in such a subset share a signature. Pairs that share several signatures, and those that share one and whose short sketches agree, are checked
on their whole sets.

Where many different texts share most of their shingles, these weigh little and each text's own words would win the coordinates. Texts that have
signatures over a few unweighted coordinates in common with many others therefore get signatures over further unweighted coordinates as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bloom
from newsloom.llm.prints import ragged
from newsloom.llm.words import WordHashes, find_words, mix
from newsloom.operators.components import components
from newsloom.session import materialise, remove_dir, shared_dir, spread

SHINGLE, LEAST_WORDS, SIMILARITY = 3, 30, 0.5
FIRST, SECOND, SHARED = 12, 3, 2
#: Bits of the shingle-frequency sketch's size: twice as many counters as rows within these bounds, so that what is broadcast has at most 16 MB.
LEAST_BITS, MOST_BITS = 18, 22
CHUNKS = 64
#: Parts of the shingle domain in the short sketch of a set, and the share of filled parts in which a pair with one common signature must agree.
#: Sets with half of their union in common agree in about half, unrelated ones in one in thirty.
PARTS, AGREE = 32, 0.25
#: Texts that may share a shingle before it counts as less than one; more by one for each partition that may count a copy again.
RARE = 60
#: Unweighted coordinates whose probes (below) count how many texts are like a text, and how many others, over all probes, make a family.
PLAIN, FAMILY = FIRST * SECOND, 150
#: Classes with one signature that are paired in one go; of more, blocks of so many are paired with each other in tasks of their own.
HEAVY = 2000
#: Copies of a class that one task pairs with all others.
COPIES = 1000
#: Pairs that are made at once.
PAIRS = 1_000_000
#: Parts and coordinates of a part in the signatures of such texts; with half of their union in common, 0.3 % of pairs share none.
WIDE, DEEP = 16, 4


def shingle_sets(texts: list[tuple[str | None, str | None]], hashes: WordHashes, size: int, least_words: int) -> list[np.ndarray | None]:
    """The sorted set of 32-bit shingle hashes of title, space and content; None where the content has fewer than least_words words or no shingle."""
    out: list = []
    a = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    for title, content in texts:
        if content is None:
            out.append(None)
            continue
        body = find_words(content.lower())
        if len(body) < least_words:
            out.append(None)
            continue
        words = find_words((title + " ").lower()) + body if title else body
        if len(words) < size:
            out.append(None)
            continue
        h = hashes.of(words)
        n = len(h) - size + 1
        s = h[:n] * a[0]
        for k in range(1, size):
            s = mix(s) + h[k : n + k] * a[k % 5]
        out.append(np.unique((mix(s) >> np.uint64(32)).astype(np.uint32)))
    return out


def _set_key(s: np.ndarray) -> int:
    return int(mix(mix(s.astype(np.uint64) + np.uint64(0x51ED270B)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def short_sketch(s: np.ndarray) -> bytes:
    """A byte of the least shingle in each part of the domain; 0 where the part has none."""
    at = np.searchsorted(s, np.arange(PARTS, dtype=np.uint64) << np.uint64(27))
    filled = at < np.append(at[1:], len(s))
    least = s[np.minimum(at, len(s) - 1)] * np.uint32(0x9E3779B1)
    return np.where(filled, np.maximum(least >> np.uint32(24), 1), 0).astype(np.uint8).tobytes()


def shingled(rows: DataFrame, row_id: str, title: str, content: str, size: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, cls (key of the set), n, shingles and short sketch of the rows that take part; the last two only at the first row of its set in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seen: set = set()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sets = shingle_sets(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())), hashes, size, least_words)
                ids, cls, n, flat, valid, short = [], [], [], [], [], []
                for i, s in zip(part.column(0).to_pylist(), sets):
                    if s is None:
                        continue
                    key = _set_key(s)
                    ids.append(i)
                    cls.append(key)
                    n.append(len(s))
                    valid.append(key not in seen)
                    short.append(None if key in seen else short_sketch(s))
                    if key not in seen:
                        flat.append(s)
                        if len(seen) < 5_000_000:
                            seen.add(key)
                if not ids:
                    continue
                lengths = np.where(valid, n, 0)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                values = pa.array(np.concatenate(flat).view(np.int32) if flat else np.empty(0, np.int32), pa.int32())
                arrays = pa.ListArray.from_arrays(offsets, values, mask=pa.array(~np.array(valid)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), arrays, pa.array(short, pa.binary())], names=["id", "cls", "n", "shingles", "short"])

    keyed = spread(rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(title), F.col(content)))
    return keyed.mapInArrow(run, "id bigint, cls bigint, n int, shingles array<int>, short binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column without nulls, and the offsets of its lists."""
    lists = column
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.view(np.uint32), offsets - offsets[0]


def frequency_sketch(sets: DataFrame, bits: int) -> np.ndarray:
    """How many texts have a shingle, by the shingle's leading bits: counted over all texts, summed by chunks of the sketch."""
    width = (1 << bits) // CHUNKS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            values, _ = _flat(b.column(0))
            counts += np.bincount(values >> np.uint32(32 - bits), minlength=len(counts)).astype(np.uint32)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, width)], pa.binary())], names=["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = sets.select("shingles").mapInArrow(local, "chunk int, counts binary").repartition(CHUNKS // 8, "chunk").mapInArrow(total, "chunk int, counts binary")
    out = np.zeros((CHUNKS, width), np.float32)
    for chunk, raw in parts.collect():
        out[chunk] = np.frombuffer(raw, np.uint64)
    return out.reshape(-1)


_SUBSETS = [(SECOND * t + i, SECOND * t + j) for t in range(FIRST) for i, j in combinations(range(SECOND), SECOND - 1)]


def _hashed(values: np.ndarray, k: int) -> np.ndarray:
    x = values ^ np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF)
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    return x


def coordinates(values: np.ndarray, begins: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The min-wise coordinates of each set: a row of FIRST * SECOND 32-bit values, and as many unweighted ones. penalty: 1 / weight of each shingle."""
    out, plain = np.empty((FIRST * SECOND, len(begins)), np.uint32), np.empty((PLAIN, len(begins)), np.uint32)
    for k in range(FIRST * SECOND):
        x = _hashed(values, k)
        plain[k] = np.minimum.reduceat(x, begins)
        key = -np.log((x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)) * penalty
        out[k] = np.minimum.reduceat(key, begins).view(np.uint32)
    return out, plain


_WIDE_SUBSETS = [tuple(DEEP * t + i for i in some) for t in range(WIDE) for some in combinations(range(DEEP), DEEP - 1)]


def plain_coordinates(values: np.ndarray, begins: np.ndarray, first: int, count: int) -> np.ndarray:
    """Unweighted min-wise coordinates of each set, count rows of 32-bit values, from number first on."""
    return np.stack([np.minimum.reduceat(_hashed(values, first + k), begins) for k in range(count)])


def _joint(rows: np.ndarray, subset: tuple[int, ...], seed: int) -> np.ndarray:
    out = np.full(rows.shape[1], seed * 0xD6E8FEB86659FD93 & (2**64 - 1), np.uint64)
    for i in subset:
        out = mix(out ^ rows[i].astype(np.uint64))
    return out


#: Fours of the unweighted coordinates, any two in a cycle with at most one in common.
_PROBES = [tuple((k + d) % PLAIN for d in four) for four in ((0, 1, 4, 6), (0, 2, 9, 17)) for k in range(PLAIN)]


def probes(plain: np.ndarray) -> np.ndarray:
    """A row of 32-bit signatures of the sets for each of _PROBES."""
    return np.stack([(_joint(plain, four, k + 1) >> np.uint64(32)).astype(np.uint32) for k, four in enumerate(_PROBES)])


def probe_sketch(sets: DataFrame, bits: int) -> np.ndarray:
    """How many texts have a probe, by its leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                values, offsets = _flat(b.slice(at, 2000).column(0))
                flat = np.ascontiguousarray(probes(plain_coordinates(values, offsets[:-1], 0, PLAIN)).T).reshape(-1)
                ends = pa.array(np.arange(0, len(flat) + 1, len(_PROBES)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int32)))], names=["shingles"])

    return frequency_sketch(sets.select("shingles").mapInArrow(run, "shingles array<int>"), bits)


def signatures(sets: DataFrame, penalty_sketch: np.ndarray, like_sketch: np.ndarray) -> DataFrame:
    """sig and cls: the PartEnum signatures of each set, for its size band and, where a similar set may lie in it, the band below.

    like_sketch, what probe_sketch gives, tells which sets get the unweighted ones too.
    """
    shared, like = (sets.sparkSession.sparkContext.broadcast(x) for x in (penalty_sketch, like_sketch))
    usual = len(_PROBES) * float(like_sketch.mean())
    family = usual + len(_PROBES) + FAMILY + 4 * usual**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = np.uint32(33 - len(table).bit_length())
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                values, offsets = _flat(part.column(2))
                cls = part.column(0).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                rows, plain = coordinates(values, offsets[:-1], table[values >> shift])
                band = np.floor(np.log2(np.maximum(n, 32) / 32) / 4).astype(np.int64)
                low = (band > 0) & (n < 64 * 16.0**band)
                out_sig, out_cls = [], []
                for k, (i, j) in enumerate(_SUBSETS):
                    joint = mix((rows[i].astype(np.uint64) << np.uint64(32) | rows[j]) ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
                    for where, level in ((slice(None), band), (low, band - 1)):
                        out_sig.append(mix(joint[where] + level[where].astype(np.uint64)))
                        out_cls.append(cls[where])
                many = like.value[probes(plain) >> shift].sum(axis=0) >= family
                if many.any():
                    lengths = np.diff(offsets)
                    rows = plain_coordinates(values[np.repeat(many, lengths)], np.cumsum(lengths[many]) - lengths[many], PLAIN, WIDE * DEEP)
                    for k, subset in enumerate(_WIDE_SUBSETS):
                        joint = _joint(rows, subset, len(_SUBSETS) + k + 1)
                        for where, level in ((slice(None), band[many]), (low[many], band[many] - 1)):
                            out_sig.append(mix(joint[where] + level[where].astype(np.uint64)))
                            out_cls.append(cls[many][where])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_sig).view(np.int64)), pa.array(np.concatenate(out_cls))], names=["sig", "cls"])

    return sets.select("cls", "n", "shingles").mapInArrow(run, "sig bigint, cls bigint")


def _group_pairs(begins: np.ndarray, length: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All pairs within each group of a sorted array, in slices."""
    group = np.repeat(begins, length)
    later = np.arange(len(cls)) - group  # so many of its group come before each
    ends = np.cumsum(later)
    done = 0
    while done < len(cls):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        n = later[done:upto]
        b = np.repeat(cls[done:upto], n)
        a = cls[ragged(group[done:upto].astype(np.int64), n)]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64)), pa.nulls(len(a), pa.int32())], names=["cls_a", "cls_b", "sig", "block"])
        done = upto


def _pair_up(batches: Iterator[pa.RecordBatch], heavy: int = HEAVY) -> Iterator[pa.RecordBatch]:
    """Pairs of the classes that share a signature, from rows sorted by sig and cls; the members of a heavy signature come out singly, with the number of their block."""
    sig, cls = np.empty(0, np.int64), np.empty(0, np.int64)
    open_sig, block = None, 0  # a heavy signature whose members are being given out

    def members(s: int, own: np.ndarray, k: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(np.full(len(own), s)), pa.array(np.full(len(own), k, np.int32))], names=["cls_a", "cls_b", "sig", "block"])

    def groups(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal sig, cls, open_sig, block
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])[: len(sig)]
        sig, cls = sig[fresh], cls[fresh]
        begins = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
        length = np.diff(np.append(begins, len(sig)))
        small = length <= heavy
        if len(begins) and sig[0] == open_sig:
            small[0] = False
        if len(begins) and not last:
            small[-1] = False
        yield from _group_pairs(*_compact(begins[small], length[small], cls))
        rest = 0
        for at, n in zip(begins[~small].tolist(), length[~small].tolist()):
            s, end = int(sig[at]), at + n
            if s != open_sig:
                if end == len(sig) and not last and n <= heavy:  # may go on with the next batch
                    rest = n
                    continue
                open_sig, block = s, 0
            ended = last or end < len(sig)
            while n > heavy or n and ended:
                take = min(n, heavy)
                yield members(s, cls[end - n : end - n + take], block)
                block, n = block + 1, n - take
            rest = n if end == len(sig) else 0
        sig, cls = sig[len(sig) - rest :], cls[len(cls) - rest :]

    for b in batches:
        sig = np.concatenate([sig, b.column(0).to_numpy(zero_copy_only=False)])
        cls = np.concatenate([cls, b.column(1).to_numpy(zero_copy_only=False)])
        yield from groups(False)
    yield from groups(True)


def _compact(begins: np.ndarray, length: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(length) - length, length, cls[ragged(begins.astype(np.int64), length)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a heavy signature, from rows sorted by sig, block of the one, block of the other, cls, with the own block of each: at most 2 * HEAVY rows a pair of blocks."""
    held: list = []

    def pairs(rows: list) -> Iterator[pa.RecordBatch]:
        cls, own = (np.concatenate([r[k] for r in rows]) for k in (3, 4))
        one, other = rows[0][1][0], rows[0][2][0]
        if one == other:
            cls = np.unique(cls)
            yield from _group_pairs(np.zeros(1, np.int64), np.array([len(cls)]), cls)
            return
        x, y = cls[own == one], cls[own == other]
        for at in range(0, len(x), max(1, PAIRS // max(len(y), 1))):
            part = x[at : at + max(1, PAIRS // max(len(y), 1))]
            a, b = np.repeat(part, len(y)), np.tile(y, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), np.int64)), pa.nulls(len(a), pa.int32())], names=["cls_a", "cls_b", "sig", "block"])

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(cols[0])]):
            own = [c[lo:hi] for c in cols]
            if held and any(held[0][k][0] != own[k][0] for k in range(3)):
                yield from pairs(held)
                held = []
            held.append(own)
    if held:
        yield from pairs(held)


PAIRED = "cls_a bigint, cls_b bigint, sig bigint, block int"


def sharing(sigs: DataFrame, path: str | None = None, heavy_from: int = HEAVY) -> DataFrame:
    """cls_a < cls_b for each signature that both have. sigs: sig and cls, repeated rows count once.

    Rows of a signature stream through a task in order. A signature with more than heavy_from classes, whose pairs would be too many for one task, is cut into blocks, and each two
    blocks are paired in a task of their own, so that no task holds more than 2 * heavy_from of them.
    """
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(sigs.repartition(parts, "sig").sortWithinPartitions("sig", "cls").mapInArrow(lambda batches: _pair_up(batches, heavy_from), PAIRED), "sharing", path)
    heavy = met.where("block is not null").select("sig", "block", F.col("cls_a").alias("cls"))
    blocks = heavy.groupBy("sig").agg(F.max("block").alias("last"))
    each = heavy.join(blocks, "sig").select("sig", "block", "cls", F.explode(F.sequence(F.lit(0), "last")).alias("with"))
    each = each.select("sig", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "cls", "block")
    across = each.repartition("sig", "one", "other").sortWithinPartitions("sig", "one", "other", "cls").mapInArrow(_blocks, PAIRED)
    return met.where("block is null").unionByName(across).select("cls_a", "cls_b")


def similar_sets(table: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """cls_a < cls_b: the pairs of different sets with at least similarity of their union in common, written. table: what shingled gives, written."""
    spark = table.sparkSession
    work = shared_dir(spark, "candidates")
    sets = table.where("shingles is not null")
    rows = table.count()
    bits = min(MOST_BITS, max(LEAST_BITS, rows.bit_length() + 1))
    counts = frequency_sketch(sets, bits)
    rare = RARE + max(1, sets.rdd.getNumPartitions())
    penalty = np.maximum(1.0, (np.maximum(counts - counts.mean(), 0) + 1) / rare).astype(np.float32)
    sigs = signatures(sets, penalty, probe_sketch(sets, bits))
    shared = sharing(sigs, f"{work}/sharing")
    met = materialise(shared.groupBy("cls_a", "cls_b").agg(F.count(F.lit(1)).alias("k")), "met", f"{work}/met")
    pairs = materialise(met.where(f"k >= {SHARED}").select("cls_a", "cls_b").unionByName(_agreeing(met.where(f"k < {SHARED}"), sets)), "candidates", f"{work}/candidates")

    # the sets of candidates only, picked by a Bloom filter, go through the exact check
    wanted = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"))
    picks = spark.sparkContext.broadcast(bloom.distributed(wanted, 2 * pairs.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.contains(picks.value, b.column(0).to_numpy(zero_copy_only=False))))

    picked = sets.select("cls", "shingles").mapInArrow(pick, "cls bigint, shingles array<int>").dropDuplicates(["cls"])
    a = picked.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("sa"))
    b = picked.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "cls_a").join(b, "cls_b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = materialise(both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))).select("cls_a", "cls_b"), "links")
    remove_dir(spark, work)
    return links


def _agreeing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs, those whose short sketches agree in a share of AGREE of the parts that either fills."""
    short = sets.select("cls", "short").dropDuplicates(["cls"])
    both = pairs.select("cls_a", "cls_b").join(short.withColumnsRenamed({"cls": "cls_a", "short": "a"}), "cls_a").join(short.withColumnsRenamed({"cls": "cls_b", "short": "b"}), "cls_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, PARTS) for k in (2, 3))
            agree, filled = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["cls_a", "cls_b"]).filter(pa.array(agree >= AGREE * filled))

    return both.select("cls_a", "cls_b", "a", "b").mapInArrow(keep, "cls_a bigint, cls_b bigint")


def near_duplicates(rows: DataFrame, row_id: str, title: str, content: str, similarity: float = SIMILARITY, size: int = SHINGLE, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id and cls of each row that takes part, links the pairs cls_a < cls_b of similar sets.

    Rows whose content is null or has fewer than least_words words take no part; a null title is an empty one. Rows with equal
    sets are one class. Repeated ids come out each; other columns are left out; empty tables give empty results.
    """
    table = materialise(shingled(rows, row_id, title, content, size, least_words), "shingles")
    return table.select("id", "cls"), similar_sets(table, similarity)


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a < id_b: every pair of rows in linked classes or in one class. The result is as long as the pairs there are."""
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = members.join(several, "cls").withColumn("salts", F.ceil(F.col("n") / COPIES).cast("int"))
    # the copies of a class are spread over salts on one side and repeated for each on the other: no task pairs more than COPIES of them with the rest
    x = held.select("cls", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), "salts").alias("salt"))
    y = held.select("cls", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)).alias("salt"))
    same = x.join(y, ["cls", "salt"]).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    sizes = members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("salts"))
    spread_links = links.join(sizes.withColumnRenamed("cls", "cls_a"), "cls_a").select("cls_a", "cls_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)).alias("salt"))
    x = members.join(sizes, "cls").select(F.col("cls").alias("cls_a"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), "salts").alias("salt"))
    y = members.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = spread_links.join(x, ["cls_a", "salt"]).join(y, "cls_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(across)


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, group_id (least id of its group), links (classes its class is linked with) of every row that takes part."""
    roots = components(links, "cls_a", "cls_b").withColumnRenamed("node", "cls")
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    rooted = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("id").alias("group_id"))
    return rooted.join(least, "root").join(degree, "cls", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def _news(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "article_title", "article_content"), "id", "article_title", "article_content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(*_news(spark, sf_dir)).select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of(*_news(spark, sf_dir))
