"""The company master: read from the listing file, cleaned, one row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import blank_to_null, strip

# The listing file's headers, trimmed, and the columns they become.
HEADERS = {
    "SYMBOL": "symbol", "NAME OF COMPANY": "company_name", "SERIES": "series", "DATE OF LISTING": "listing_date",
    "PAID UP VALUE": "paid_up_value", "MARKET LOT": "market_lot", "ISIN NUMBER": "isin_number", "FACE VALUE": "face_value",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The listing file as strings, headers trimmed and renamed. A missing file or column raises."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if missing := [h for h in HEADERS if h not in raw.columns]:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return raw.withColumnsRenamed(HEADERS)


def clean(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Typed and trimmed companies, one per symbol.

    Rows without symbol or name are dropped, unreadable dates and numbers become null. Of rows with one symbol the first in order stays;
    without an order column that is the least by name, series and the rest, nulls last, as files have no order of rows in Spark.
    """
    text = {c: blank_to_null(strip(F.col(c))) for c in HEADERS.values()}
    date = text["listing_date"]
    day = F.coalesce(F.try_to_timestamp(F.initcap(date), F.lit("dd-MMM-yyyy")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))).cast("date")
    typed = raw.select(
        F.upper(text["symbol"]).alias("symbol"), text["company_name"].alias("company_name"), F.upper(text["series"]).alias("series"), day.alias("listing_date"),
        text["paid_up_value"].try_cast("double").alias("paid_up_value"), text["market_lot"].try_cast("int").alias("market_lot"),
        text["isin_number"].alias("isin_number"), text["face_value"].try_cast("double").alias("face_value"),
        *[F.col(c).alias(f"_o_{c}") for c in order or []],
    )
    typed = typed.where("symbol is not null and company_name is not null")
    by = [f"_o_{c}" for c in order] if order else [c for c in typed.columns if c != "symbol"]
    first = F.row_number().over(W.partitionBy("symbol").orderBy(*[F.asc_nulls_last(c) for c in by]))
    return typed.withColumn("_n", first).where("_n = 1").drop("_n", *[f"_o_{c}" for c in order or []])


def write(companies: DataFrame, path: str, files: int = 1) -> None:
    """Replaces the table: rows sorted by symbol within files, so that a lookup reads few row groups, with Bloom filters for point lookups."""
    out = companies.repartitionByRange(files, "symbol").sortWithinPartitions("symbol").write.mode("overwrite")
    out.option("parquet.bloom.filter.enabled#symbol", "true").option("parquet.bloom.filter.enabled#isin_number", "true").parquet(path)
