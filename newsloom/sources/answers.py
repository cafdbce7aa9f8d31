"""Answers of a web search by a language model: raw text to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import blank_to_null, strip, unfence
from newsloom.schemas import ANSWER
from newsloom.session import broadcast_if_small


def articles_of(body: Column) -> Column:
    """The array of articles of an answer; an empty array where it is malformed or no list, null for a null answer."""
    text = unfence(body)
    return F.when(body.isNull(), None).otherwise(F.coalesce(F.when(text.startswith("["), F.from_json(text, ANSWER, {"mode": "PERMISSIVE"})), F.from_json(F.lit("[]"), ANSWER)))


def from_envelope(rows: DataFrame, raw: str, into: str = "body") -> DataFrame:
    """rows with the text of a provider's answer, candidates[0].content.parts[0].text, null where any of that is missing or it isn't JSON, and truncated: whether it stopped at its most tokens."""
    first = "$.candidates[0]"
    cut = F.coalesce(F.get_json_object(raw, f"{first}.finishReason") == "MAX_TOKENS", F.lit(False))
    return rows.withColumns({into: F.get_json_object(raw, f"{first}.content.parts[0].text"), "truncated": cut})


def host(url: Column) -> Column:
    """Host of an address with its port, lower case, every www. removed; null without scheme and host."""
    return F.replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit("www."), F.lit(""))


def is_valid_url(url: Column) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) != "") & (F.try_parse_url(url, F.lit("AUTHORITY")) != ""), F.lit(False))


def credible(rows: DataFrame, domains: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """Rows whose host is one of domains or below one. Each host gives its own suffixes, so that the join is by equality, not by pattern."""
    labels = F.split(host(F.col(url)), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_suffixes", F.when(n > 0, suffixes))
    allowed = broadcast_if_small(domains.select(F.lower(domain).alias("_suffix")).distinct())
    hits = keyed.withColumn("_suffix", F.explode("_suffixes")).join(allowed, "_suffix")
    return hits.dropDuplicates(["_row"]).drop("_row", "_suffixes", "_suffix")


def normalise(answers: DataFrame, fetched: str = "fetched_at") -> DataFrame:
    """One row per usable article of each answer: title and a valid address are required, a missing date is the day of the answer.

    place is the article's place in its answer, from 0.
    """
    rows = answers.select("response_id", "company_symbol", F.col(fetched).alias("fetched_at"), F.posexplode(articles_of(F.col("body"))).alias("place", "a"))
    title, url = strip(F.col("a.title")), strip(F.col("a.url"))
    date = F.coalesce(F.try_to_timestamp(F.col("a.date"), F.lit("yyyy-MM-dd")), F.date_trunc("day", F.col("fetched_at")))
    rows = rows.select("response_id", "company_symbol", "place", title.alias("title"), url.alias("link"), F.coalesce("a.summary", F.lit("")).alias("description"), F.date_format(date, "yyyy-MM-dd").alias("published"), F.lit("gemini").alias("source"))
    return rows.where(blank_to_null(F.col("title")).isNotNull() & is_valid_url(F.col("link")))
