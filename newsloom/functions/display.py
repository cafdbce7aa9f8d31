"""What an interface shows, and the records at the edges: percents, bands, dates, errors, prompts, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages by error code, and the one for any other.
ERRORS = {
    "invalid_input": "Type at least two letters or digits.", "not_found": "No listed company has this symbol.", "no_results": "Nothing was found.",
    "no_articles": "There are no recent articles about this company.", "source_error": "The news sources can't be read just now.",
}
OTHER_ERROR = "Something went wrong."
PROMPT = "List recent news about {NAME} ({SYMBOL}) from these publishers only: {SOURCES}. Answer with a JSON list of objects with title, url, date (YYYY-MM-DD) and summary."


def percent(part: Column, whole: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 1)


def band(confidence: Column) -> Column:
    return F.when(confidence > 0.7, "green").when(confidence > 0.4, "yellow").otherwise("red")


def label_text(label: Column) -> Column:
    """Title of a verdict whatever its case; neutral for any other."""
    low = F.lower(label)
    return F.when(low == "bullish", "Bullish").when(low == "bearish", "Bearish").otherwise("Neutral")


def day(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def error_message(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.lit(OTHER_ERROR))


def prompt(name: Column, symbol: Column, sources: list[str], template: str = PROMPT) -> Column:
    text = F.lit(template.replace("{SOURCES}", ", ".join(sources)))
    return F.replace(F.replace(text, F.lit("{NAME}"), name), F.lit("{SYMBOL}"), symbol)


def cache_key(url: Column, title: Column, text: Column) -> Column:
    """Key of a normalised article: its address, title and the first thousand characters, hashed."""
    empty = F.lit("")
    return F.sha2(F.concat(F.coalesce(url, empty), F.coalesce(title, empty), F.substring(F.coalesce(text, empty), 1, 1000)), 256)


def batches(rows: DataFrame, order: list[Column], within: str, size: int = 16) -> DataFrame:
    """rows with batch: numbers of groups of size rows, counted within a column's values."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(within).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def envelope(articles: DataFrame, by: str = "company_symbol") -> DataFrame:
    """Of each company: how many articles were collected, whether that is enough, and how many came from the cache (from_cache)."""
    n = F.count(F.lit(1))
    return articles.groupBy(by).agg(n.alias("article_count"), (n >= 1).alias("success"), F.count_if("from_cache").alias("cached"))
