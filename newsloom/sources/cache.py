"""The article cache: rows with an expiry, read, purged, and replaced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.timestamps import parse_column

TTL_DAYS = 3


def instant(c: Column) -> Column:
    """Instant of a cache time; without zone it is wall time of the cache's own zone."""
    return F.timestamp_micros(parse_column(c, F.lit("Asia/Kolkata"), F.lit(True)))


def not_older(rows: DataFrame, since: str, as_of: str, date: str = "cached_date", into: str = "at") -> DataFrame:
    """Rows whose date is since or later, with its instant in column into. An unreadable date counts as as_of; null and blank ones are older than any."""
    at = F.coalesce(instant(F.col(date)), F.lit(as_of).cast("timestamp"))
    # a generator keeps the filter from being pushed below it, where the dates would be parsed a second time
    rows = rows.where(F.trim(date) != "").select("*", F.inline(F.array(F.struct(at.alias(into)))))
    return rows.where(F.col(into) >= F.lit(since).cast("timestamp"))


def valid(cache: DataFrame, as_of: str) -> DataFrame:
    """Rows that expire after as_of, by the instants of what is written; an unreadable expiry is none."""
    return cache.where(instant(F.col("expires_date")) > F.lit(as_of).cast("timestamp"))


def purge(cache: DataFrame, as_of: str) -> DataFrame:
    """What is left without the rows that expired before as_of; a row that expires at as_of stays, and so does one without readable expiry."""
    return cache.where(F.coalesce(instant(F.col("expires_date")) >= F.lit(as_of).cast("timestamp"), F.lit(True)))


def stamped(rows: DataFrame, as_of: str, days: int = TTL_DAYS) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumn("cached_date", text(now)).withColumn("expires_date", text(now + F.expr(f"INTERVAL {days} DAYS")))


def replace_by_key(rows: DataFrame, path: str, key: str = "company_symbol") -> None:
    """Replaces the partitions of the keys that rows hold and keeps all others: one atomic dynamic overwrite."""
    out = rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(key).parquet(path)


def cached_or_fresh(cached: DataFrame, fresh: DataFrame, key: str = "company_symbol") -> DataFrame:
    """Cached rows, and fresh ones of the keys that have none."""
    return cached.unionByName(fresh.join(cached.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("n_articles"), F.count_distinct("company_symbol").alias("n_companies"), F.count_distinct("source_name").alias("n_sources"))


def backup(spark: SparkSession, path: str, to: str) -> None:
    spark.read.parquet(path).write.mode("errorifexists").parquet(to)
