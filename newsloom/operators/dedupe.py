"""Repeated articles of one company: by hash, by cleaned address, by alike headlines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import article_hash, clean_for_filter, clean_url, headline_words
from newsloom.operators.collect import keep_first
from newsloom.operators.components import components
from newsloom.session import materialise

ALIKE = 0.85


def by_hash_and_url(rows: DataFrame, title: str = "article_title", description: str = "article_content", link: str = "article_url", order: str = "id", within: str = "company_symbol") -> DataFrame:
    """The first row of each hash of cleaned title and description, and of those the first of each cleaned address; rows without address stay."""
    staged = cleaned(rows, title, description)
    hashed = keep_first(staged, [F.col(within), article_hash(F.col("_title"), F.col("_description"))], [F.col(order)]).drop("_title", "_description")
    url = clean_url(F.coalesce(link, F.lit("")))
    return keep_first(hashed, [F.col(within), F.when(url != "", url), F.when(url == "", F.col(order))], [F.col(order)])


def cleaned(rows: DataFrame, title: str, description: str) -> DataFrame:
    """rows with _title and _description as the filter compares them: compatibility-decomposed, squeezed, without tags; null ones are empty."""
    return rows.withColumns({"_title": clean_for_filter(F.coalesce(title, F.lit(""))), "_description": clean_for_filter(F.coalesce(description, F.lit("")))})


def headline_pairs(rows: DataFrame, title: str = "article_title", row_id: str = "id", within: str = "company_symbol", least: float = ALIKE) -> DataFrame:
    """id_a < id_b, similarity: pairs of rows of one company whose headlines' words have more than least of their union in common.

    Candidates share one of the first n - ceil(least * n) + 1 words in the order of their frequency, rare ones first: no pair is missed, and common
    words make no candidates. Equal word sets are compared as one.
    """
    sets = rows.select(F.col(row_id).alias("id"), F.col(within).alias("g"), words_of(F.col(title)).alias("words")).where(F.size("words") > 0)
    return alike_sets(sets, least)


def words_of(title: Column) -> Column:
    """The set of a cleaned headline's words, sorted."""
    return F.array_sort(F.array_distinct(headline_words(clean_for_filter(F.coalesce(title, F.lit(""))))))


def alike_sets(sets: DataFrame, least: float = ALIKE) -> DataFrame:
    """id_a < id_b, similarity of the word sets of sets (id, g, words) that are more than least alike; equal sets of one g count once, by their least id."""
    classes = sets.groupBy("g", "words").agg(F.min("id").alias("c"))
    each = classes.select("g", "c", F.explode("words").alias("w"))
    freq = each.groupBy("w").count()
    ordered = each.join(freq, "w").withColumn("k", F.row_number().over(W.partitionBy("g", "c").orderBy("count", "w")))
    size = classes.select("g", "c", "words", F.size("words").alias("n"))
    lead = ordered.join(size.select("g", "c", "n"), ["g", "c"]).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("g", "c", "w")
    a, b = lead.alias("a"), lead.alias("b")
    pairs = a.join(b, F.expr("a.g <=> b.g and a.w = b.w and a.c < b.c")).select(F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct()
    wa = classes.select(F.col("c").alias("ca"), F.col("words").alias("wa"))
    wb = classes.select(F.col("c").alias("cb"), F.col("words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    alike = pairs.join(wa, "ca").join(wb, "cb").withColumn("similarity", common / (F.size("wa") + F.size("wb") - common)).where(F.col("similarity") > least)
    return alike.select(F.col("ca").alias("id_a"), F.col("cb").alias("id_b"), "similarity")


class _Kept:
    """What one connected group of articles has kept so far. Its size follows what is kept, not what comes in."""

    def __init__(self, least: float):
        self.least = least
        self.hashes, self.urls = set(), set()
        self.titles: list[list] = []  # [words, slot], in the order in which headlines were first kept
        self.place: dict = {}
        self.holders: dict = {}
        self.slots: list[list] = []  # [id, score] of the articles that stay

    def title(self, words: frozenset, slot: list) -> None:
        if words in self.place:
            self.titles[self.place[words]][1] = slot
            return
        self.place[words] = len(self.titles)
        for w in words:
            self.holders.setdefault(w, []).append(len(self.titles))
        self.titles.append([words, slot])

    def like(self, words: frozenset) -> int | None:
        """The first kept headline that is alike."""
        shared: dict = {}
        for w in words:
            for k in self.holders.get(w, ()):
                shared[k] = shared.get(k, 0) + 1
        return min((k for k, n in shared.items() if n > self.least * (len(words) + len(self.titles[k][0]) - n)), default=None)

    def take(self, row_id: int, digest: str | None, url: str | None, words: list[str], score: float) -> None:
        if digest and digest in self.hashes or url and url in self.urls:
            return
        own = frozenset(words)
        if own and (k := self.like(own)) is not None:
            slot = self.titles[k][1]
            if score > slot[1]:
                slot[:] = row_id, score
                self.title(own, slot)
            return
        slot = [row_id, score]
        self.slots.append(slot)
        if digest:
            self.hashes.add(digest)
        if url:
            self.urls.add(url)
        if own:
            self.title(own, slot)


def _fold(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, root = None, None
        for b in batches:
            out: list = []
            for at, *row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if kept is None or at != root:
                    out += [s[0] for s in kept.slots] if kept else []
                    kept, root = _Kept(least), at
                kept.take(*row)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in kept.slots], pa.int64())], names=["id"])

    return run


def in_sequence(rows: DataFrame, row_id: str, within: str, digest: Column | None, url: Column | None, words: Column, score: Column, least: float = ALIKE) -> DataFrame:
    """row_id of the rows that stay, going through each company's rows in order of row_id: a row is a repeat if a kept one has its digest, else if one has its
    url, else if a kept headline's words are alike; in the last case it takes the kept row's place if it scores higher. Only what is kept counts from then on.

    A headline that gave up its place stays known, for the row that took it. What happens to a row depends on rows it is linked with by digest, url or
    alike headlines and on no others, so that each connected group is gone through by itself, as a stream sorted outside Python of which only what is kept is held. Rows without
    any link stay and aren't gathered. Null and empty digests and urls, headlines without words match nothing; null and NaN scores are 0.
    """
    none = F.lit(None).cast("string")
    blank = lambda c: none if c is None else F.nullif(c, F.lit(""))
    narrow = materialise(rows.select(
        F.col(row_id).cast("bigint").alias("id"), F.col(within).alias("g"), blank(digest).alias("digest"), blank(url).alias("url"), words.alias("words"), F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")), "headlines")
    links = alike_sets(narrow.where(F.size("words") > 0).select("id", "g", "words"), least).select("id_a", "id_b")
    for key in ("digest", "url", "words"):
        held = narrow.where(F.size("words") > 0) if key == "words" else narrow.where(F.col(key).isNotNull())
        first = held.groupBy("g", key).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("g").alias("_g"), F.col(key).alias("_k"), "a")
        links = links.unionByName(held.join(first, F.col("g").eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k"))).where("id <> a").select(F.col("a").alias("id_a"), F.col("id").alias("id_b")))
    roots = components(links, "id_a", "id_b").select(F.col("node").alias("id"), "root")
    linked = narrow.join(roots, "id").select("root", "id", "digest", "url", "words", "score")
    kept = linked.repartition("root").sortWithinPartitions("root", "id").mapInArrow(_fold(least), "id bigint")
    return narrow.join(roots, "id", "left_anti").select("id").union(kept).withColumnRenamed("id", row_id)


def greedy(rows: DataFrame, title: str = "article_title", score: str = "relevance_score", row_id: str = "id", within: str = "company_symbol", least: float = ALIKE) -> DataFrame:
    """row_id of the rows that stay by alike headlines alone (see in_sequence)."""
    return in_sequence(rows, row_id, within, None, None, words_of(F.col(title)), F.col(score), least)


def articles(rows: DataFrame, title: str = "article_title", description: str = "article_content", link: str = "article_url", score: str = "score", row_id: str = "id", within: str = "company_symbol") -> DataFrame:
    """row_id of the rows that stay by hash of cleaned title and description, then cleaned address, then alike headlines, in one sequence (see in_sequence)."""
    staged = cleaned(rows, title, description).select(row_id, within, score, *sequence_keys(F.col("_title"), F.col("_description"), F.col(link)))
    return in_sequence(staged, row_id, within, F.col("digest"), F.col("url"), F.col("words"), F.col(score))


def sequence_keys(title: Column, description: Column, link: Column) -> list[Column]:
    """digest, url and words of a cleaned title and description and an address: what in_sequence compares."""
    words = F.array_sort(F.array_distinct(headline_words(title)))
    return [article_hash(title, description).alias("digest"), clean_url(F.coalesce(link, F.lit(""))).alias("url"), words.alias("words")]
