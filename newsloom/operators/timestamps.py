"""Mixed timestamp formats and time zones brought to one instant in UTC.

The distinct written values, with the zone and day order of their source, form a dictionary that is parsed once and kept
as a table; later runs parse only what the table lacks, and the instants are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.timestamps import parse_instant
from newsloom.session import broadcast_if_small, materialise, path_exists, shared_dir

KEY = ["_raw", "_zone", "_day_first"]
#: A value that more than 1 / HOT of all rows share is joined by broadcast; there are fewer than HOT such values.
HOT = 1000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, zone, first = (b.column(k).to_pylist() for k in range(3))
        micros = [parse_instant(*x) for x in zip(raw, zone, first)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(micros, pa.int64())], names=[*b.schema.names, "_micros"])


def parse_column(raw: Column, zone: Column, day_first: Column) -> Column:
    """Instants without the dictionary table, for few or nearly all different values: each Arrow batch parses a value once."""

    @F.arrow_udf("bigint")
    def parse(r: pa.Array, z: pa.Array, d: pa.Array) -> pa.Array:
        memo: dict = {}
        out = []
        for key in zip(r.to_pylist(), z.to_pylist(), d.to_pylist()):
            if key not in memo:
                memo[key] = parse_instant(*key)
            out.append(memo[key])
        return pa.array(out, pa.int64())

    return parse(raw, zone, day_first)


class TimestampDictionary:
    """The table of parsed values at path; each normalise call adds what it has not seen.

    Parquet folders are only appended to, one per call, so that a reader never sees a half-written state.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_dir(spark, "timestamps")

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if path_exists(self.spark, self.path) else None

    def normalise(self, rows: DataFrame, raw: Column, zone: Column, day_first: Column, into: str = "utc_micros") -> DataFrame:
        """rows with the instant of raw in column into (microseconds since 1970-01-01 UTC).

        Null, blank, relative and impossible values give null. zone is the IANA zone of a value that names none; null
        or unknown means UTC. Rows are kept whole, repeated ones too, with whatever other columns they have; a column named
        like into is replaced. An empty table gives an empty table.
        """
        keep = [c for c in rows.columns if c != into]
        keyed = rows.select(
            *[F.col(f"`{c}`") for c in keep],
            raw.alias("_raw"), F.coalesce(zone, F.lit("UTC")).alias("_zone"), F.coalesce(day_first, F.lit(True)).alias("_day_first"),
        )
        counts = materialise(keyed.where(F.trim("_raw") != "").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")), "values")
        known = self.read()
        new = counts if known is None else counts.join(known.select(*KEY), KEY, "left_anti")
        parsed = new.select(*KEY).mapInArrow(_parse, "_raw string, _zone string, _day_first boolean, _micros bigint")
        parsed.write.mode("append").option("compression", "zstd").parquet(self.path)
        # how often a value occurs is counted anew in each call: one that was rare before may be hot now
        table = counts.join(self.read().where(F.col("_micros").isNotNull()), KEY)
        total = counts.agg(F.sum("_n")).first()[0] or 0
        hot_if = F.col("_n") > max(total // HOT, 1000)
        self.hot = hot = broadcast_if_small(table.where(hot_if).select(*KEY, F.col("_micros").alias("_hot")), HOT)
        cold = table.where(~hot_if).select(*KEY, F.col("_micros").alias("_cold"))
        # a row that the broadcast has answered joins under a null key, spread over all partitions by the outer join
        first = keyed.join(hot, KEY, "left").withColumn("_look", F.when(F.col("_hot").isNull() & (F.trim("_raw") != ""), F.col("_raw")))
        spread = F.when(F.col("_look").isNull(), F.monotonically_increasing_id() % 4096)
        first = first.withColumn("_spread", spread)
        cold = cold.withColumnRenamed("_raw", "_look").withColumn("_spread_c", F.lit(None).cast("bigint"))
        on = (F.col("a._look") == F.col("b._look")) & (F.col("a._zone") == F.col("b._zone")) & (F.col("a._day_first") == F.col("b._day_first"))
        # null keys would all meet in one task; give each its own key that matches nothing
        first = first.withColumn("_look", F.coalesce("_look", F.concat(F.lit("\x00"), F.col("_spread").cast("string"))))
        joined = first.alias("a").join(cold.alias("b"), on, "left")
        return joined.select(*[F.col(f"a.`{c}`") for c in keep], F.coalesce("a._hot", "b._cold").alias(into))


def with_source_zone(rows: DataFrame, sources: DataFrame, source: str = "source_name") -> DataFrame:
    """rows with _zone and _day of their publisher: UTC and day first where the source is null or unknown."""
    dim = sources.groupBy(F.col("source_name").alias("_source")).agg(F.min("home_zone").alias("_zone"), F.min("day_first").alias("_day"))
    return rows.join(broadcast_if_small(dim), rows[source] == F.col("_source"), "left").drop("_source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "source_name", "published_date", "cached_date")
    zoned = with_source_zone(news, spark.read.parquet(f"{sf_dir}/news_sources.parquet"))
    # one scan gives both fields
    fields = zoned.select("id", F.explode(F.array(
        F.struct(F.lit("published_date").alias("field_name"), F.col("published_date").alias("raw"), F.col("_zone").alias("zone"), F.col("_day").alias("day")),
        F.struct(F.lit("cached_date").alias("field_name"), F.col("cached_date").alias("raw"), F.lit("Asia/Kolkata").alias("zone"), F.lit(True).alias("day")),
    )).alias("x")).select("id", "x.*")
    done = TimestampDictionary(spark).normalise(fields, F.col("raw"), F.col("zone"), F.col("day"))
    return done.where(F.col("utc_micros").isNotNull()).select("id", "field_name", "utc_micros")
