"""Tables as views, and SQL with bound parameters over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> None:
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)


def query(spark: SparkSession, sql: str, *args: object) -> DataFrame:
    """The result of sql, its question marks bound to args; text from outside never becomes part of the statement."""
    return spark.sql(sql, args=list(args))
