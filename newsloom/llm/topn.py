"""The N best rows of every group by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.timestamps import parse_instant
from newsloom.operators.timestamps import with_source_zone
from newsloom.session import materialise

_LOW = -(2**63)


def _local(n: int):
    """The n best rows of each group within one partition, and the key of the n-th: a lower bound of the group's n-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        memo: dict = {}
        for b in batches:
            for group, row, score, raw, zone, day in zip(*(b.column(k).to_pylist() for k in range(6))):
                known = score is not None and score == score
                heap = best.get(group)
                # most rows of a large group end here, before their date is read
                if heap is not None and len(heap) == n and (known, score if known else 0.0) < heap[0][:2]:
                    continue
                at = (raw, zone, day)
                if at not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[at] = parse_instant(raw, zone or "UTC", True if day is None else day)
                micros = memo[at]
                key = (known, score if known else 0.0, _LOW if micros is None else micros, -row)
                if heap is None:
                    best[group] = [key]
                elif len(heap) < n:
                    heappush(heap, key)
                elif key > heap[0]:
                    heapreplace(heap, key)
        rows = [(g, *k, len(h) == n and k == h[0]) for g, h in best.items() for k in h]
        if rows:
            cols = list(zip(*rows))
            types = [pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["g", "known", "score", "micros", "neg", "last"])

    return run


def top_n(rows: DataFrame, group: str, row_id: str, score: str, when: str, n: int = 5) -> DataFrame:
    """The n best rows of each group: highest score first, then newest instant of when, then smallest id.

    rows needs _zone and _day (with_source_zone). Null and NaN scores are equal and come last, so do unreadable dates among equal scores; a
    null group is a group of its own. Groups with fewer than n rows come out whole; equal rows count each. An empty table gives none.

    Each partition keeps its n best of each group; the n-th of them is a lower bound of the group's n-th best. The largest bound
    of a group prunes the partitions' candidates, and at most n rows of a partition reach the final ranking, however large the group.
    The whole sort key is the bound, not the score alone, so that heavily tied scores prune too.
    """
    narrow = rows.select(
        F.col(group).cast("string").alias("g"), F.col(row_id).cast("bigint"), F.col(score).cast("double"), F.col(when), F.col("_zone"), F.col("_day"))
    local = materialise(narrow.mapInArrow(_local(n), "g string, known boolean, score double, micros bigint, neg bigint, last boolean"), "topn")
    key = F.struct("known", "score", "micros", "neg")
    bounds = local.where("last").groupBy("g").agg(F.max(key).alias("bound")).withColumnRenamed("g", "bg")
    alive = local.withColumn("key", key).join(bounds, F.col("g").eqNullSafe(F.col("bg")), "left").where(F.col("bound").isNull() | (F.col("key") >= F.col("bound")))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("key")))
    return alive.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), (-F.col("neg")).alias(row_id), "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "company_symbol", "relevance_score", "published_date", "source_name")
    zoned = with_source_zone(news, spark.read.parquet(f"{sf_dir}/news_sources.parquet"))
    return top_n(zoned, "company_symbol", "id", "relevance_score", "published_date").select("company_symbol", F.col("id").cast("int").alias("id"))
