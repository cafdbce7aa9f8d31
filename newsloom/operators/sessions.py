"""Searches of users: debounced typing and recent searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def debounced(typed: DataFrame, user: str = "user_id", ts: str = "ts", delay_ms: int = 300, tie: str = "event_id") -> DataFrame:
    """Rows that no newer one of their user follows within the delay."""
    later = F.lead(ts).over(W.partitionBy(user).orderBy(ts, tie))
    gap = F.unix_micros(later.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return typed.where("true").withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= delay_ms * 1000)).drop("_gap")


def recent(searches: DataFrame, user: str, item: str, ts: str, keep: int = 10, tie: str = "event_id") -> DataFrame:
    """The newest search of each item, newest first, at most keep for each user; repeated items move to the front."""
    last = searches.groupBy(user, item).agg(F.max(F.struct(ts, tie)).alias("_l"))
    rank = F.row_number().over(W.partitionBy(user).orderBy(F.desc("_l")))
    return last.withColumn("rank", rank).where(F.col("rank") <= keep).select(user, item, F.col(f"_l.{ts}").alias(ts), "rank")
