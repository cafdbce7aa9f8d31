"""Collection of articles: which company they are about, unions of sources, and which of several copies stays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.scores import matched_terms
from newsloom.functions.text import blank_to_null, search_terms, without_suffix
from newsloom.session import spread

LIVE_RELEVANCE = 0.7


def match_terms(symbol: Column, name: Column) -> Column:
    """Lower-case terms by which a text is about a company: its search terms, its name with and without suffix, its symbol."""
    terms = F.concat(search_terms(symbol, name), F.array(name, without_suffix(name), symbol))
    return F.array_sort(F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: t.isNotNull() & (t != ""))))


def relevant(articles: DataFrame, companies: DataFrame, title: str = "article_title", description: str = "article_content") -> DataFrame:
    """Articles that hold all words of one of their own company's terms, with matched_terms (sorted) and the live relevance."""
    terms = companies.select(F.col("symbol").alias("company_symbol"), match_terms(F.col("symbol"), F.col("company_name")).alias("_terms"))
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    hit = spread(articles).join(terms, "company_symbol").withColumn("_text", text)
    # behind a generator, so that the filter doesn't match all terms a second time
    hit = hit.select("*", F.inline(F.array(F.struct(matched_terms(F.col("_text"), F.col("_terms")).alias("matched_terms"))))).drop("_terms", "_text")
    return hit.where(F.size("matched_terms") > 0).withColumn("relevance_score", F.lit(LIVE_RELEVANCE))


#: Companies whose words one automaton holds; a larger master is matched in blocks of so many.
BLOCK = 50_000


def about_companies(articles: DataFrame, companies: DataFrame, row_id: str = "id", title: str = "article_title", description: str = "article_content") -> DataFrame:
    """row_id, symbol: every company that each article is about, by the terms of match_terms.

    All words of all terms are sought in one pass over each text by an automaton; a term holds where all its words do. The companies are taken in
    blocks of a fixed size, one broadcast automaton each, so that no text is compared with companies one by one.
    """
    terms = companies.select("symbol", match_terms(F.col("symbol"), F.col("company_name")).alias("terms"))
    n = companies.count()
    blocks = max(1, -(-n // BLOCK))
    keyed = terms.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)))
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    rows = spread(articles.select(F.col(row_id).cast("bigint").alias("id"), text.alias("text")))
    out = None
    for k in range(blocks):
        held = articles.sparkSession.sparkContext.broadcast([(r.symbol, [t.split() for t in r.terms if t.split()]) for r in keyed.where(F.col("block") == k).collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            words: dict = {}
            by_word: dict = {}
            uses: dict = {}
            for symbol, lists in held.value:
                for ws in lists:
                    for w in set(ws):
                        uses[w] = uses.get(w, 0) + 1
            for symbol, lists in held.value:
                for ws in lists:
                    own = set(ws)
                    lead = min(own, key=lambda w: (uses[w], w))  # a term is looked at only where its rarest word occurs
                    by_word.setdefault(lead, []).append((symbol, own))
                    for w in own:
                        words[w] = w
            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for b in batches:
                ids, symbols = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = {w for _, w in automaton.iter(t)} if words else set()
                    hits = {s for w in found for s, own in by_word.get(w, ()) if own <= found}
                    ids += [i] * len(hits)
                    symbols += sorted(hits)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(symbols, pa.string())], names=["id", "symbol"])

        own = rows.mapInArrow(run, "id bigint, symbol string")
        out = own if out is None else out.unionByName(own)
    return out.withColumnRenamed("id", row_id)


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in order; null keys are keys. A key with very many rows is reduced within partitions before the shuffle."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys)))
    first = F.row_number().over(W.partitionBy(*names).orderBy(*order))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n", *names)


def first_per_title_and_link(rows: DataFrame, title: str = "article_title", link: str = "article_url", order: str = "id", within: str = "company_symbol") -> DataFrame:
    return keep_first(rows, [F.col(within), F.lower(title), F.col(link)], [F.col(order)])


def first_per_link(rows: DataFrame, preferred: str, link: str = "article_url", source: str = "source_name", order: str = "id", within: str = "company_symbol") -> DataFrame:
    """One row per company and link, of the preferred source if it has one; blank links are dropped."""
    filled = rows.where(blank_to_null(F.col(link)).isNotNull())
    return keep_first(filled, [F.col(within), F.col(link)], [F.when(F.col(source) == preferred, 0).otherwise(1), F.col(order)])


def capped(rows: DataFrame, n: int = 15, within: str = "company_symbol", order: list[Column] | None = None) -> DataFrame:
    """The first n rows of each company, in list order."""
    rank = F.row_number().over(W.partitionBy(within).orderBy(*(order or [F.col("id")])))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def as_articles(cache: DataFrame) -> DataFrame:
    """Cache rows in the shape of articles; a missing score is 0, title and link are required."""
    rows = cache.where(blank_to_null(F.col("article_title")).isNotNull() & blank_to_null(F.col("article_url")).isNotNull())
    return rows.select(
        "company_symbol", F.col("article_title").alias("title"), F.coalesce("article_content", F.lit("")).alias("description"), F.col("article_url").alias("link"),
        F.coalesce("published_date", F.lit("")).alias("published"), F.coalesce("source_name", F.lit("unknown")).alias("source"),
    )


def all_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
