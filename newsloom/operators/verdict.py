"""Predictions of chunks to one verdict per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARKET = {"positive": "bullish", "neutral": "neutral", "negative": "bearish"}


def with_predictions(chunks: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their prediction; chunks without one are left out, of several predictions of one key the last stays (by ord, if there is one)."""
    if "ord" in predictions.columns:
        last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ord")))
        predictions = predictions.withColumn("_n", last).where("_n = 1").drop("_n", "ord")
    return chunks.join(predictions, keys)


def verdict_of(score: Column, margin: float = 0.2) -> Column:
    return F.when(score >= margin, "bullish").when(score <= -margin, "bearish").otherwise("neutral")


def summary(predicted: DataFrame, by: list[str]) -> DataFrame:
    """Counts by label, mean positive less mean negative score, its verdict and confidence, for each group."""
    score = F.coalesce(F.avg("scores.positive") - F.avg("scores.negative"), F.lit(0.0))
    counts = [F.count_if(F.col("sentiment") == label).alias(name) for label, name in MARKET.items()]
    out = predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("chunk_count"), *counts, score.alias("_s"))
    return out.select(
        *by, "chunk_count", *MARKET.values(), F.round("_s", 4).alias("overall_score"), verdict_of(F.col("_s")).alias("sentiment_label"),
        F.round(F.least(F.abs("_s") + 0.3, F.lit(1.0)), 4).alias("confidence"),
    )


def documents(predicted: DataFrame, companies: DataFrame, by: str = "company_symbol", most: int = 15) -> DataFrame:
    """One JSON document per company: company, counts, summary and its chunks in order, at most `most` of them listed."""
    item = F.struct(
        F.coalesce("metadata.title", F.lit("")).alias("title"), F.coalesce("metadata.url", F.lit("")).alias("url"), F.coalesce("metadata.source", F.lit("unknown")).alias("source"),
        F.coalesce("metadata.published_date", F.lit("")).alias("published"), "sentiment", *[F.round(f"scores.{k}", 4).alias(k) for k in MARKET],
    )
    rank = F.row_number().over(W.partitionBy(by).orderBy("ord", "chunk_id"))
    listed = predicted.withColumn("_n", rank).where(F.col("_n") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_n", item.alias("item")))).alias("_l"))
    whole = summary(predicted, [by]).join(listed, by)
    named = whole.join(companies.select(F.col("symbol").alias(by), "company_name"), by, "left")
    doc = F.struct(
        F.struct(F.col(by).alias("symbol"), F.col("company_name").alias("name"), F.lit("Unknown").alias("sector")).alias("company"), F.col("chunk_count").alias("article_count"),
        F.struct(*MARKET.values(), "overall_score", "sentiment_label", "confidence").alias("sentiment_summary"), F.transform("_l", lambda x: x["item"]).alias("articles"),
    )
    return named.select(by, F.to_json(doc).alias("document"))


def shares(summary_rows: DataFrame) -> DataFrame:
    """Percent of each label with one decimal, and the band of the confidence."""
    pct = [F.round(F.coalesce(F.try_divide(F.col(c), F.col("chunk_count")), F.lit(0.0)) * 100, 1).alias(f"{c}_pct") for c in MARKET.values()]
    band = F.when(F.col("confidence") > 0.7, "high").when(F.col("confidence") > 0.4, "medium").otherwise("low")
    return summary_rows.select("*", *pct, band.alias("confidence_band"))
