"""New batches checked for repeats against everything accepted so far, without working through the history again.

A store keeps the fingerprints of the accepted articles in parts (prints.Part), each with Bloom filters over them. A batch's items' fingerprints go to
their parts; there the filters prescreen them, only positives are looked up, the shared coverage of the word sets is verified, and the batch's own fingerprints are
left to be taken in. What is linked within the batch is resolved in order; the repeats among them are left out of the parts.

An article repeats one of its own company only, so that companies are dealt to shards, each with parts of its own. A task takes a shard through a stretch of batches, one after the
other, beside the tasks of all other shards. A batch of which a shard has too much for one task is a query of its own with a task for each part; the ids of its repeats go with the next one to the parts.

Fingerprints are selected as in winnowing: of a whole set of words only the least ones in a fixed order, rare words first, so many that two alike sets surely share some. With at
least 0.8 of their union in common they share two of the first n - ceil(0.8 n) + 2 words, so that each pair of those words is a fingerprint. Above PAIR_WORDS words the
shared first word does instead. Both are exact: no alike headline is missed. A pair belongs to the part of one of its words, so that an item goes to few parts.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.timestamps import parse_instant
from newsloom.llm.flat import Folder
from newsloom.llm.prints import Part, Sets, links_within, ragged
from newsloom.llm.words import WordHashes, find_words, mix
from newsloom.session import materialise, remove_dir, shared_dir, spread

#: Sets of at most so many words are found by pairs of words; from SINGLE_WORDS on also by single words, so that sizes in between meet both ways.
PAIR_WORDS, SINGLE_WORDS = 64, 52
#: Counters of the word-frequency sketch that orders the words; fixed when a store is made.
ORDER_BITS = 16
#: Conflicts within a batch that one task resolves; more are resolved by rounds of joins, with the same result.
ONE_TASK = 1_000_000
#: Items of a history for each part of its store, and the least number of shards.
PART_ITEMS, LEAST_SHARDS = 200_000, 4
#: Items of a shard, and repeats of the batch before, that one task takes batch by batch through all steps. A batch with a larger share is shuffled by part, with the same result.
SMALL = 50_000
#: The parts' runs are merged, a task for each part, when so many times the items of the last time were added.
COMPACT = 1.5
LAST = 2**62
DAY = 86_400_000_000

# Parameters that tell where a reader came from.
_TRACKING = {"ref", "source", "campaign", "gclid", "fbclid"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*)?:?//")
_LEADING = re.compile(r"(?:(?:www|m|amp)\.)+(?=.)")


def address_key(url: str | None) -> str | None:
    """One form of all addresses that count as the same; None for null and blank ones."""
    if url is None or not (text := url.strip()):
        return None
    text = text.split("#", 1)[0]
    scheme = _SCHEME.match(text)
    rest = text[scheme.end() :] if scheme else text
    head, _, query = rest.partition("?")
    host, slash, path = head.partition("/")
    host = host.lower()
    name = (scheme[1] or "").lower() if scheme else ""
    for port, of in ((":80", "http"), (":443", "https")):
        if host.endswith(port) and name in (of, ""):
            host = host[: -len(port)]
    host = _LEADING.sub("", host, count=1) if _LEADING.match(host) else host
    path = slash + path
    while path.endswith(("/", "/amp")):
        path = path[: -1 if path[-1] == "/" else -4]
    kept = sorted(p for p in query.split("&") if p and not ((k := p.split("=", 1)[0]).startswith("utm_") or k in _TRACKING))
    return f"{host}{path}?{'&'.join(kept)}" if kept else f"{host}{path}"


_SIGNED = struct.Struct("<q").unpack


def _hash(kind: str, group: bytes, key: bytes = b"") -> int:
    return _SIGNED(xxhash.xxh3_64_digest(kind.encode() + group + key)[::-1])[0]


class _Groups(dict):
    """company -> hash of its group, as bytes and as a number."""

    def __missing__(self, company: str | None) -> tuple[bytes, int]:
        text = ("\x00" if company is None else company).encode("utf-8", "surrogatepass")
        out = self[company] = xxhash.xxh3_64_digest(b"g" + text), _hash("g", text)
        return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        groups = _Groups()
        company, url, title, cached = (b.column(k).to_pylist() for k in range(1, 5))
        group = [groups[c] for c in company]
        at = [parse_instant(x, "Asia/Kolkata") for x in cached]
        micros = [LAST if x is None else x for x in at]
        addr = [None if (key := address_key(x)) is None else _hash("a", g, key.encode("utf-8", "surrogatepass")) for x, (g, _) in zip(url, group)]
        sets = [set(find_words(x.lower())) if x else () for x in title]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        words = hashes.of(list(chain.from_iterable(sets))).view(np.int64)
        words = words[np.lexsort((words, np.repeat(np.arange(len(sets)), size)))]
        offset = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        raw, ends = words.astype("<i8").tobytes(), (8 * offset).tolist()
        tset = [_hash("t", g, raw[a:z]) if a < z else None for (g, _), a, z in zip(group, ends, ends[1:])]
        lists = pa.ListArray.from_arrays(pa.array(offset), pa.array(words), mask=pa.array(size == 0))
        own = [pa.array(x, pa.int64()) for x in ([g for _, g in group], micros, addr, tset)]
        yield pa.RecordBatch.from_arrays([b.column(0), *own, lists], names=["id", "grp", "micros", "addr", "tset", "words"])


ITEM = "id bigint, grp bigint, micros bigint, addr bigint, tset bigint, words array<bigint>"


def prepare(rows: DataFrame, row_id: str, company: str, url: str, title: str, cached: str) -> DataFrame:
    """id, group, instant, address key, word-set key and words of each row: all that the check needs. A null company is a company of its own;
    a row without readable instant comes after all others."""
    return spread(rows.select(F.col(row_id).cast("bigint"), company, url, title, cached)).mapInArrow(_prepare, ITEM)


def word_order(items: DataFrame) -> np.ndarray:
    """How many headlines have a word, by the word's hash: the order of words, fixed for a store's life. Counted over all rows given."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            values = b.column(0).flatten().to_numpy(zero_copy_only=False)
            counts += np.bincount(values & ((1 << ORDER_BITS) - 1), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["word", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for word, n in items.select("words").mapInArrow(local, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():  # at most 2^ORDER_BITS rows
        counts[word] = n
    return counts


_pair_memo: dict = {}


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _pair_memo:
        _pair_memo[n] = tuple(np.array(list(combinations(range(n), 2))).T)
    return _pair_memo[n]


def fingerprints(offset: np.ndarray, words: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, word, fingerprint) of many sets of word hashes: fingerprints as 64-bit integers salted with the set's group, and the word whose part each belongs to.

    Sets of fewer than four words can only be alike if equal, and have none. Sets of one size are worked on together.
    """
    sizes = np.diff(offset)
    out: list = [[], [], []]
    for n in np.unique(sizes[sizes >= 4]).tolist():
        at = np.flatnonzero(sizes == n)
        sets = words[offset[at][:, None] + np.arange(n)]
        first = n - (4 * n + 4) // 5
        ranked = np.lexsort((sets, order[sets & ((1 << ORDER_BITS) - 1)]), axis=-1)[:, : first + 2]
        lead = np.take_along_axis(sets, ranked, 1).astype(np.uint64)
        lead = mix(lead + group[at].astype(np.uint64)[:, None])
        if n <= PAIR_WORDS:
            i, j = _pairs(first + 2)
            x, y = np.minimum(lead[:, i], lead[:, j]), np.maximum(lead[:, i], lead[:, j])
            out[0].append(np.repeat(at, len(i)))
            out[1].append(x.ravel())
            out[2].append(mix(x * np.uint64(0x9E3779B97F4A7C15) + y).ravel())
        if n >= SINGLE_WORDS:
            x = lead[:, : first + 1]
            out[0].append(np.repeat(at, first + 1))
            out[1].append(x.ravel())
            out[2].append(mix(x ^ np.uint64(0x5851F42D4C957F2D)).ravel())
    if not out[0]:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    item, word, prints = (np.concatenate(x) for x in out)
    return item, word, prints.view(np.int64)


#: What a part says of a batch: an item repeats an accepted article (HIT), is linked to an earlier one of the batch with id key (LINK), shares key with others of the batch (SHARES).
HIT, LINK, SHARES = 0, 1, 2
CONFLICT = "kind int, key bigint, id bigint, micros bigint, parts array<int>"


def resolve_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through a batch's conflicting items in order: an item is a repeat if it has a hit, if one of its keys has an accepted item, or if an accepted item is linked to it.

    Gives the repeats with their parts, and whether the store told.
    """
    shares: dict = defaultdict(list)
    links: dict = defaultdict(list)
    hit: set = set()
    at, parts = {}, {}
    for b in batches:
        for kind, key, item, micros, own in zip(*(b.column(k).to_pylist() for k in range(5))):
            at[item], parts[item] = micros, own
            if kind == HIT:
                hit.add(item)
            else:
                (links if kind == LINK else shares)[item].append(key)
    taken, accepted, killed = set(), set(), []
    for item in sorted(at, key=lambda i: (at[i], i)):
        if item in hit or any(k in taken for k in shares.get(item, ())) or any(s in accepted for s in links.get(item, ())):
            killed.append(item)
        else:
            accepted.add(item)
            taken.update(shares.get(item, ()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(killed, pa.int64()), pa.array([parts[i] for i in killed], pa.list_(pa.int32())), pa.array([i in hit for i in killed], pa.bool_())], names=["id", "parts", "by_store"])


def resolve_in_rounds(conflicts: DataFrame) -> DataFrame:
    """The same by joins: in each round the first undecided item of all its groups without undecided earlier link is accepted, and what it meets is a repeat."""
    spark = conflicts.sparkSession
    killed: DataFrame | None = None
    path = shared_dir(spark, "undecided")
    cur = materialise(conflicts, "undecided", path)
    while cur.limit(1).count():
        at = F.struct("micros", "id")
        items = cur.groupBy("id").agg(F.min("micros").alias("micros"))
        g = cur.where("kind")
        first = g.groupBy("key").agg(F.min(at).alias("first"))
        waits = g.join(first, "key").where(at > F.col("first")).select("id").union(cur.where("not kind").select("id")).distinct()
        accepted = items.join(waits, "id", "left_anti").select("id")
        taken = g.join(accepted, "id", "left_semi").select("key")
        hit = g.join(taken.distinct(), "key", "left_semi").join(accepted, "id", "left_anti").select("id")
        hit = hit.union(cur.where("not kind").join(accepted.select(F.col("id").alias("key")), "key", "left_semi").select("id")).distinct()
        hit = materialise(hit, "killed")
        killed = hit if killed is None else killed.union(hit)
        decided = hit.union(accepted)
        left = cur.join(decided, "id", "left_anti")
        # a link from a repeat says nothing any more; its items stay as members of no group, so that they are decided
        gone = left.where("not kind").join(hit.select(F.col("id").alias("key")), "key", "left_anti")
        alone = left.select(F.lit(True).alias("kind"), F.col("id").alias("key"), "id", "micros").distinct()
        new_path = shared_dir(spark, "undecided")
        new = materialise(left.where("kind").select("kind", "key", "id", "micros").union(gone.select("kind", "key", "id", "micros")).union(alone).distinct(), "undecided", new_path)
        remove_dir(spark, path)
        cur, path = new, new_path
    return killed if killed is not None else spark.createDataFrame([], "id bigint")


KILLED = "id bigint, parts array<int>, by_store boolean"


class AcceptedStore:
    """The accepted articles at path: parts with their fingerprints and filters, and the repeats of each batch, whose folder also says that the batch is done."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: Sequence[int] = (1,) * LEAST_SHARDS):
        """shards: how many parts each shard has, fixed when a store is made."""
        self.spark, self.path, self.shards = spark, path or shared_dir(spark, "accepted"), np.array(shards)
        self._order, self._grown, self._merged = None, 0, 0
        marks = Folder(f"{self.path}/done")
        self._stretches = sorted(tuple(int(b) for b in name.split("_")) for name in marks.names() if name[0] != ".")
        told = [marks.read(f"{a}_{z}") for a, z in self._stretches]
        self.done = sorted(int(b) for x in told for b in x["batch"])
        # the last batch, if the parts don't know its repeats yet
        self._pending = None if not told or told[-1]["sealed"][0] else self.done[-1]
        kept = Folder(self.path)
        if "order" in kept.names():
            head = kept.read("order")
            self.shards, self._order = np.array(head["shards"]), spark.sparkContext.broadcast(np.array(head["order"]))
            self._clear()

    @property
    def parts(self) -> int:
        return int(self.shards.sum())

    def _clear(self) -> None:
        """Removes what a call that failed has left of batches that aren't done."""
        last = self.done[-1] if self.done else -(2**62)
        for k in range(self.parts):
            part = Folder(f"{self.path}/part-{k:05d}")
            part.remove([n for n in part.names() if n.startswith(("run-", "pend-")) and int(n.replace("_", "-").split("-")[-1]) > last])
        for name in Folder(f"{self.path}/killed").names():
            if "=" in name and int(name.partition("=")[2]) > last:
                remove_dir(self.spark, f"{self.path}/killed/{name}")

    def _start(self, items: DataFrame) -> None:
        """The order of words, from the first batch: all that is known then. Any fixed order is exact, rare words first make fewer positives."""
        order = word_order(items)
        Folder(self.path).write("order", {"order": order, "shards": self.shards})
        self._order = self.spark.sparkContext.broadcast(order)

    def killed(self, batch: int | None = None) -> DataFrame:
        """id, parts, by_store of the items that repeat an accepted one: of one batch, or of all with their batch."""
        at, both = f"{self.path}/killed", KILLED + ", batch bigint"
        if batch is not None:
            at += f"/upto={next(b for _, b in self._stretches if batch <= b)}"
        told = self.spark.read.schema(both).parquet(at) if self.done else self.spark.createDataFrame([], both)
        return told if batch is None else told.where(F.col("batch") == batch)

    def _routed(self, items: DataFrame) -> DataFrame:
        order, shards = self._order, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _to_parts(b, order.value, shards)[1]

        return items.select("id", "grp", "micros", "addr", "tset", "words").mapInArrow(run, ROUTED)

    def add(self, batch: int, items: DataFrame, n: int | None = None) -> DataFrame:
        """Checks a batch that comes after all earlier ones and gives id, parts, by_store of its items that repeat an accepted article, earlier or of the batch.

        batch: its number, larger than those before; items: what items_of gives; n: how many a shard has of them at most, all of them if not given. One query reads the batch and, of
        the store, the filters and what they let pass. A batch that is already in the store isn't taken again: its result is read.
        """
        self.add_all([(batch, items.count() if n is None else n)], items.withColumn("batch", F.lit(batch).cast("bigint")))
        return self.killed(batch)

    def add_all(self, batches: list[tuple[int, int]], items: DataFrame) -> None:
        """Takes several batches (number, items of a shard at most) in order, by the items' column batch, which should be one that folders are partitioned by.

        A stretch of batches is one query with a task for each shard, which takes one batch after the other; a batch too large for that is a query of its own with a task for each part.
        """
        batches = [b for b in batches if b[0] not in self.done]
        if batches and self.done and batches[0][0] < self.done[-1]:
            raise ValueError(f"batch {batches[0][0]} comes after batch {self.done[-1]}")
        columns = ["id", "grp", "micros", "addr", "tset", "words"]
        while batches:
            stretch, held = [batches[0]], batches[0][1]
            while len(stretch) < len(batches) and held + batches[len(stretch)][1] <= SMALL:
                held += batches[len(stretch)][1]
                stretch.append(batches[len(stretch)])
            batches = batches[len(stretch) :]
            first, last = stretch[0][0], stretch[-1][0]
            own = items.where(F.col("batch").between(first, last))
            if self._order is None:
                self._start(items.where(F.col("batch") == first))
            gone = None if self._pending is None else self.killed(self._pending).select("id", "parts")
            if max(held, 0 if gone is None else gone.count()) <= SMALL:
                self._by_shards([b for b, _ in stretch], own.select("batch", *columns), gone)
            else:
                self._by_parts(last, own.select(*columns), gone)
            self.done += [b for b, _ in stretch]
            self._grown += held
            if self._grown > COMPACT * self._merged + SMALL:
                self._compact(last + 1)

    def _by_shards(self, batches: list[int], items: DataFrame, gone: DataFrame | None) -> None:
        path, order, shards, previous = self.path, self._order, self.shards, self._pending
        schema = pa.schema([(f, pa.int64()) for f in ("batch", "id", "grp", "micros", "addr", "tset")] + [("words", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])
        both = items.withColumns({"parts": F.lit(None).cast("array<int>"), "shard": F.pmod("grp", F.lit(len(shards))).cast("int")})
        if gone is not None:
            owner = F.lit(np.repeat(np.arange(len(shards)), shards).tolist())
            both = both.unionByName(gone.withColumn("shard", F.get(owner, F.col("parts")[0]).cast("int")), allowMissingColumns=True)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _day_by_day(path, pa.Table.from_batches(rows, schema), batches, previous, order.value, shards)

        told = both.repartitionById(len(shards), "shard").drop("shard").mapInArrow(run, KILLED + ", batch bigint")
        told.write.mode("overwrite").parquet(f"{path}/killed/upto={batches[-1]}")
        self._mark(batches, True)

    def _by_parts(self, batch: int, items: DataFrame, gone: DataFrame | None) -> None:
        path, previous = self.path, self._pending

        def step(key: tuple, table: pa.Table) -> pa.Table:
            return _step(f"{path}/part-{key[0].as_py():05d}", table, batch, previous)

        rows = self._routed(items)
        if gone is not None:
            rows = rows.unionByName(gone.select(F.explode("parts").alias("part"), "id"), allowMissingColumns=True)
        conflicts = materialise(rows.groupBy("part").applyInArrow(step, CONFLICT), "conflicts", f"{path}/conflicts")
        told = conflicts.repartition(1).mapInArrow(resolve_in_task, KILLED) if conflicts.count() <= ONE_TASK else self._by_rounds(conflicts)
        told.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/killed/upto={batch}")
        self._mark([batch], False)

    def _mark(self, batches: list[int], sealed: bool) -> None:
        self._stretches.append((batches[0], batches[-1]))
        Folder(f"{self.path}/done").write(f"{batches[0]}_{batches[-1]}", {"batch": np.array(batches), "sealed": np.array([sealed])})
        self._pending = None if sealed else batches[-1]

    def _compact(self, first: int) -> None:
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    part = Part(f"{path}/part-{k:05d}", first, sealing=False)  # the repeats among what is pending come with the next batch
                    part.compact()
                    part.publish()
                yield b

        self.spark.range(0, self.parts, 1, self.parts).mapInArrow(run, "id bigint").count()
        self._merged += self._grown
        self._grown = 0

    def _by_rounds(self, rows: DataFrame) -> DataFrame:
        hit = rows.where(F.col("kind") == HIT).select("id").distinct()
        rest = rows.where(F.col("kind") != HIT).join(hit, "id", "left_anti").select((F.col("kind") == SHARES).alias("kind"), "key", "id", "micros")
        rest = rest.where("kind").unionByName(rest.where("not kind").join(hit.withColumnRenamed("id", "key"), "key", "left_anti").select("kind", "key", "id", "micros"))
        killed = hit.withColumn("by_store", F.lit(True)).unionByName(resolve_in_rounds(rest).distinct().withColumn("by_store", F.lit(False)))
        parts = rows.groupBy("id").agg(F.first("parts").alias("parts"))
        return killed.join(parts, "id").select("id", "parts", "by_store")


ROUTED = "part int, id bigint, micros bigint, prints array<bigint>, words array<bigint>, keys array<bigint>, parts array<int>"


def _to_parts(b: pa.RecordBatch, order: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
    """A row for each item and part that a fingerprint or key of it belongs to, and the place of its item. words only where there are fingerprints; parts are all parts of the item."""
    ids, group, micros = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    words = b.column(5).flatten().to_numpy(zero_copy_only=False)
    offset = np.concatenate([[0], np.cumsum(b.column(5).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    item, word, prints = fingerprints(offset, words, group, order)
    keys, owner = [], []
    for k in (3, 4):
        valid = b.column(k).is_valid().to_numpy(zero_copy_only=False)
        keys.append(b.column(k).fill_null(0).to_numpy(zero_copy_only=False)[valid])
        owner.append(np.flatnonzero(valid))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    item, value, whole = np.concatenate([item, owner]), np.concatenate([prints, keys]), np.concatenate([np.zeros(len(prints), bool), np.ones(len(keys), bool)])
    shard = group[item] % len(shards)
    part = (np.cumsum(shards) - shards)[shard] + (np.concatenate([word, keys.view(np.uint64)]) % shards[shard].astype(np.uint64)).astype(np.int64)
    by = np.lexsort((value, whole, part, item))
    part, item, value, whole = part[by], item[by], value[by], whole[by]
    again = np.concatenate([[False], (part[1:] == part[:-1]) & (item[1:] == item[:-1]) & (value[1:] == value[:-1])])[: len(part)]
    part, item, value, whole = part[~again], item[~again], value[~again], whole[~again]
    begins = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (item[1:] != item[:-1])])[: len(part)])
    n_whole = np.add.reduceat(whole.astype(np.int64), begins) if len(part) else begins
    n_print = np.diff(np.concatenate([begins, [len(part)]])) - n_whole
    of, to = item[begins], part[begins]
    size = np.where(n_print > 0, np.diff(offset)[of], 0)
    firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
    per_item = np.diff(np.concatenate([firsts, [len(of)]]))
    n_parts_of = np.repeat(per_item, per_item)

    def ragged_list(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))

    return of, pa.RecordBatch.from_arrays([
        pa.array(to.astype(np.int32)), pa.array(ids[of]), pa.array(micros[of]), ragged_list(value[~whole], n_print), ragged_list(words[ragged(offset[of], size)], size),
        ragged_list(value[whole], n_whole), ragged_list(to[ragged(np.repeat(firsts, per_item), n_parts_of)].astype(np.int32), n_parts_of),
    ], names=["part", "id", "micros", "prints", "words", "keys", "parts"])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _step(uri: str, table: pa.Table, batch: int, previous: int | None) -> pa.Table:
    """One part's share of a batch and of the repeats of the one before, which have no instant."""
    fresh = table.column("micros").is_valid()
    part = Part(uri, batch, previous, table.filter(pc.invert(fresh)).column("id").to_numpy())
    out = _share(part, table.filter(fresh), batch)
    part.publish()
    return out


def _share(part: Part, rows: pa.Table, batch: int) -> pa.Table:
    """Screens, looks up, verifies, finds what is linked within the batch, and leaves the rest pending."""
    ids, micros = rows.column("id").to_numpy(), rows.column("micros").to_numpy()
    out: list = []

    def say(kind: int, key: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            own = rows.column("parts").take(pa.array(at)).combine_chunks()
            out.append(pa.table({"kind": pa.array(np.full(len(at), kind, np.int32)), "key": pa.array(key), "id": pa.array(ids[at]), "micros": pa.array(micros[at]), "parts": own}))

    if rows.num_rows:
        prints, n_print = _lists(rows.column("prints"))
        words, n_words = _lists(rows.column("words"))
        keys, n_key = _lists(rows.column("keys"))
        item, owner = np.repeat(np.arange(len(ids)), n_print), np.repeat(np.arange(len(ids)), n_key)
        sets = Sets(ids, np.concatenate([[0], np.cumsum(n_words)]), words)
        hit_item, hit_owner = part.hits(prints, item, sets, keys, owner)
        hit = np.zeros(len(ids), bool)
        hit[hit_item] = hit[hit_owner] = True
        say(HIT, np.zeros(int(hit.sum()), np.int64), np.flatnonzero(hit))
        open_print, open_key = ~hit[item], ~hit[owner]
        prints, item, keys, owner = prints[open_print], item[open_print], keys[open_key], owner[open_key]
        earlier, later = links_within(prints, item, micros, sets)
        say(LINK, ids[earlier], later)
        # the earlier item of a link is one to be decided too, under a key of its own
        first = np.unique(earlier)
        say(SHARES, ids[first] ^ np.int64(-(2**63)), first)
        by = np.argsort(keys, kind="stable")
        same = keys[by][1:] == keys[by][:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.empty(0, bool)
        say(SHARES, keys[by][several], owner[by][several])
        held = np.flatnonzero(~hit)
        place = np.cumsum(~hit) - 1
        kept = Sets(ids[held], np.concatenate([[0], np.cumsum(n_words[held])]), words[np.repeat(~hit, n_words)])
        part.keep(batch, prints, place[item], kept, keys, ids[owner])
    if not out:
        return pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "micros": pa.array([], pa.int64()), "parts": pa.array([], pa.list_(pa.int32()))})
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _day_by_day(path: str, table: pa.Table, batches: list[int], previous: int | None, order: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's share of a stretch, one batch after the other, each through the filters, the store, its own order of acceptance, and into the parts.

    Rows without instant are the repeats of the batch before.
    """
    is_item = table.column("micros").is_valid()
    gone, items = table.filter(pc.invert(is_item)).select(["id", "parts"]), table.filter(is_item).combine_chunks()
    killed, at = gone.column("id").to_numpy(), np.empty(0, np.int32)
    if gone.num_rows:
        at, n = _lists(gone.column("parts"))
        killed = np.repeat(killed, n)
    parts: dict[int, Part] = {}

    def opened(k: int) -> Part:
        if k not in parts:
            parts[k] = Part(f"{path}/part-{k:05d}", batches[0], previous, killed[at == k])
        return parts[k]

    for k in np.unique(at).tolist():
        opened(k)
    shares: dict[int, list[tuple[int, pa.Table]]] = defaultdict(list)
    for b in items.to_batches():
        of, routed = _to_parts(b.select(["id", "grp", "micros", "addr", "tset", "words"]), order, shards)
        number, to = b.column(0).to_numpy()[of], routed.column(0).to_numpy()
        by = np.lexsort((to, number))
        number, to, own = number[by], to[by], pa.Table.from_batches([routed]).take(pa.array(by)).combine_chunks()
        ends = np.flatnonzero(np.concatenate([(number[1:] != number[:-1]) | (to[1:] != to[:-1]), [True]])[: len(to)]) + 1
        for a, z in zip([0, *ends.tolist()], ends.tolist()):
            shares[int(number[a])].append((int(to[a]), own.slice(a, z - a)))
    for batch in sorted(shares):
        conflicts = [x for k, own in shares[batch] for x in _share(opened(k), own, batch).to_batches()]
        for told in resolve_in_task(iter(conflicts)):
            ids = told.column(0).to_numpy()
            for k, _ in shares[batch]:
                parts[k].seal(ids)
            yield pa.RecordBatch.from_arrays([*told.columns, pa.array(np.full(len(ids), batch))], names=[*told.schema.names, "batch"])
    for part in parts.values():
        part.publish()


def items_of(rows: DataFrame) -> DataFrame:
    """Items of what prepare gives: rows of one batch, address and set of words are one, taken by the first of them; rows with neither are left out, as they match nothing."""
    firsts = rows.where("addr is not null or tset is not null").groupBy("batch", "addr", "tset").agg(F.min(F.struct("micros", "id", "grp", "words")).alias("x"))
    return firsts.select("batch", "x.id", "x.grp", "x.micros", "addr", "tset", "x.words")


def replay(rows: DataFrame, row_id: str, company: str, url: str, title: str, cached: str, path: str, store: AcceptedStore | None = None) -> tuple[DataFrame, DataFrame, AcceptedStore]:
    """Takes rows into a store day by day: what prepare and items_of give, with batch, both written below path, and the store, a new one below path if none is given.

    A batch is one UTC day, its number the day since 1970; rows without readable instant are a batch after all others.
    """
    spark = rows.sparkSession
    ready = prepare(rows, row_id, company, url, title, cached).withColumn("batch", F.floor(F.col("micros") / DAY))
    ready = materialise(ready, "ready", f"{path}/ready")
    # in order of batches, so that a stretch of them reads its own row groups
    items = materialise(items_of(ready).repartitionByRange("batch", "id").sortWithinPartitions("batch"), "items", f"{path}/items")
    if store is None:
        n = max(LEAST_SHARDS, items.count() // PART_ITEMS)
        # a shard with a company of many articles has several parts
        held = {r.shard: r.n for r in items.groupBy(F.pmod("grp", F.lit(n)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
        store = AcceptedStore(spark, f"{path}/store", [max(1, held.get(k, 0) // PART_ITEMS) for k in range(n)])
    by_shard = items.groupBy("batch", F.pmod("grp", F.lit(len(store.shards)))).agg(F.count(F.lit(1)).alias("n"))
    days = by_shard.groupBy("batch").agg(F.max("n").alias("n")).orderBy("batch").collect()  # a row a day
    store.add_all([(int(r.batch), r.n) for r in days], items)
    return ready, items, store


def repeats(rows: DataFrame, row_id: str, company: str, url: str, title: str, cached: str, store: AcceptedStore | None = None) -> DataFrame:
    """row_id of every row that repeats an accepted earlier one of its company, by address or by an alike headline.

    Rows come in order of instant, then id, a batch for each UTC day. Null and blank addresses, headlines
    without words match nothing; a row with neither is always accepted. Of rows with one id, those of one day are one row. An empty table gives none.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "replay")
    ready, items, kept = replay(rows, row_id, company, url, title, cached, path, store)
    bare = ready.where("addr is null and tset is null").select("batch", "id")
    accepted = bare
    if kept.done:
        accepted = items.select("batch", "id").join(kept.killed().select("batch", "id"), ["batch", "id"], "left_anti").unionByName(bare)
    found = materialise(ready.select("batch", "id").join(accepted, ["batch", "id"], "left_anti").select("id"), "repeats")
    remove_dir(spark, path)
    return found.withColumnRenamed("id", row_id)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "company_symbol", "article_url", "article_title", "cached_date")
    return repeats(news, "id", "company_symbol", "article_url", "article_title", "cached_date").select(F.col("id").cast("int").alias("id"))


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch: its rows, its items, and how many of them the store told as repeats, and how many an item of the batch itself."""
    news = spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "company_symbol", "article_url", "article_title", "cached_date")
    path = shared_dir(spark, "replay")
    ready, items, store = replay(news, "id", "company_symbol", "article_url", "article_title", "cached_date", path)
    n_rows = ready.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
    n_items = items.groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"))
    told = store.killed().groupBy("batch").agg(F.count_if("by_store").alias("by_store"), F.count_if(~F.col("by_store")).alias("within"))
    out = materialise(n_rows.join(n_items, "batch", "left").join(told, "batch", "left").na.fill(0), "batches")
    remove_dir(spark, path)
    return out
