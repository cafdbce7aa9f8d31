"""Company search: point lookups, tiered and ranked top-k, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import clean_query, highlight, search_terms, strip
from newsloom.session import broadcast_if_small


def _starts(c: Column, q: Column) -> Column:
    return F.startswith(F.upper(c), F.upper(q))


def _contains(c: Column, q: Column) -> Column:
    return F.contains(F.upper(c), F.upper(q))


def by_symbol(companies: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query) joined with the company whose symbol it is, after trimming and upper case."""
    return queries.join(companies, F.upper(strip(F.col("query"))) == F.col("symbol"))


def tiered(companies: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query, priority, symbol, company_name: at most limit companies of each query, best tier first.

    Tiers: the symbol itself; symbols that begin with the query; names that do; names that hold it elsewhere. Each tier has what
    the ones before left of the limit, counted before repeats are dropped, so that fewer than limit rows may come out. Ordered by symbol
    or name within a tier. Matching ignores case; a query is literal text. Queries are few; companies are scanned once for all.
    """
    q, s, n = F.col("query"), F.col("symbol"), F.col("company_name")
    tier = F.array_compact(F.array(
        F.when(s == F.upper(q), 1), F.when(_starts(s, q) & (s != F.upper(q)), 2),
        F.when(_starts(n, q) & ~_starts(s, q), 3), F.when(_contains(n, q) & ~_starts(n, q), 4),
    ))
    hits = companies.select("symbol", "company_name", "series").join(broadcast_if_small(queries), _starts(s, q) | _contains(n, q))
    hits = hits.withColumn("priority", F.explode(tier))
    key = F.when(F.col("priority") <= 2, s).otherwise(n)
    hits = hits.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("priority", key, "symbol"))).where(F.col("place") <= limit)
    once = F.row_number().over(W.partitionBy("query", "symbol").orderBy("place"))
    return hits.withColumn("once", once).where("once = 1").drop("once")


def ranked(companies: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query, rank, symbol, company_name: companies whose symbol, name or ISIN holds the query; exact symbols first, then symbol and name prefixes."""
    q, s, n = F.col("query"), F.col("symbol"), F.col("company_name")
    hits = companies.join(broadcast_if_small(queries), _contains(s, q) | _contains(n, q) | _contains(F.coalesce("isin_number", F.lit("")), q))
    grade = F.when(s == F.upper(q), 1).when(_starts(s, q), 2).when(_starts(n, q), 3).otherwise(4)
    rank = F.row_number().over(W.partitionBy("query").orderBy(grade, "symbol", "company_name"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "symbol", "company_name")


def similar(companies: DataFrame, symbols: DataFrame, limit: int = 5) -> DataFrame:
    """Companies whose name begins with the first word of another's name: for each symbol (of symbols) at most limit others, by name.

    First words are joined with the first words they begin by equality of all beginnings, so that all companies may be asked for at once. Of each first
    word, limit + 1 names are enough, as one may be the asking company's own.
    """
    own = companies.join(broadcast_if_small(symbols.select(F.upper("symbol").alias("symbol"))), "symbol")
    wanted = own.select(F.col("symbol").alias("of_symbol"), F.split("company_name", " ")[0].alias("first_word"))
    named = companies.select("symbol", "company_name", F.split("company_name", " ")[0].alias("word"))
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda k: F.substring(F.col("word"), F.lit(1), k)))
    reached = named.select("word").distinct().select("word", begins.alias("first_word")).join(wanted.select("first_word").distinct(), "first_word")
    place = F.row_number().over(W.partitionBy("first_word").orderBy("company_name", "symbol"))
    first = named.join(reached, "word").withColumn("place", place).where(F.col("place") <= limit + 1).drop("word", "place")
    hits = wanted.join(first, "first_word").where("symbol <> of_symbol")
    rank = F.row_number().over(W.partitionBy("of_symbol").orderBy("company_name", "symbol"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("of_symbol", "rank", "symbol", "company_name")


def of_series(companies: DataFrame, limit: int = 100) -> DataFrame:
    """series, rank and company: the first limit companies of each series by name; companies without series are left out."""
    rank = F.row_number().over(W.partitionBy("series").orderBy("company_name", "symbol"))
    return companies.where("series is not null").withColumn("rank", rank).where(F.col("rank") <= limit)


def recently_listed(companies: DataFrame, as_of: str, days: int = 30, limit: int = 20) -> DataFrame:
    recent = companies.where(F.col("listing_date").isNotNull() & (F.col("listing_date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return recent.orderBy(F.desc("listing_date"), "symbol").limit(limit)


def suggestions(found: DataFrame) -> DataFrame:
    """What a search box shows of tiered's rows: shortened name, subtitle, the match in asterisks, the tier as relevance."""
    name = F.when(F.length("company_name") > 50, F.concat(F.substring("company_name", 1, 50), F.lit("..."))).otherwise(F.col("company_name"))
    text = F.concat_ws(" - ", "symbol", "company_name")
    return found.select(
        "query", F.col("symbol").alias("value"), text.alias("display_text"), name.alias("title"),
        F.when(F.col("series").isNotNull(), F.concat("series", F.lit(" Series"))).otherwise("Listed Stock").alias("subtitle"),
        highlight(text, F.col("query")).alias("highlighted"), F.coalesce("priority", F.lit(4)).alias("search_relevance"),
    )


def autocomplete(companies: DataFrame, typed: DataFrame, limit: int = 10, least: int = 2) -> DataFrame:
    """Suggestions for typed texts (query): cleaned, those with fewer than least characters left out."""
    cleaned = typed.select(clean_query(F.col("query")).alias("query")).where(F.length("query") >= least).distinct()
    return suggestions(tiered(companies, cleaned, limit))


def fallback(companies: DataFrame, typed: DataFrame, prefix: int = 3, limit: int = 10) -> DataFrame:
    """For texts that autocomplete finds nothing for: the same search with their first characters."""
    cleaned = typed.select(clean_query(F.col("query")).alias("query")).distinct()
    missed = cleaned.join(tiered(companies, cleaned, 1), "query", "left_anti").select(F.substring("query", 1, prefix).alias("query")).where("query <> ''").distinct()
    return suggestions(tiered(companies, missed, limit))


def context(companies: DataFrame) -> DataFrame:
    """What collection needs to know of a company: its details, its search terms in order, and the defaults of a news search."""
    terms = search_terms(F.col("symbol"), F.col("company_name"))
    config = F.struct(F.lit(30).alias("date_range_days"), F.lit(50).alias("max_articles"), F.array(F.lit("rss"), F.lit("llm")).alias("sources"), F.lit(0.7).alias("relevance_threshold"))
    return companies.select(
        "*", F.col("symbol").alias("nse_symbol"), F.lit("active").alias("status"), F.lit(True).alias("validated"), terms.alias("search_terms"),
        F.get(terms, F.lit(0)).alias("primary_search_term"), F.get(terms, F.lit(1)).alias("secondary_search_term"), config.alias("news_config"),
    )
