from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.functions.timestamps import parse_instant
from newsloom.operators.timestamps import TimestampDictionary, parse_column, with_source_zone


def us(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(("raw", "zone", "day_first", "want"), [
    ("2025-01-01T22:32:07", "Asia/Kolkata", True, us(2025, 1, 1, 17, 2, 7)),
    ("2025-01-01T11:36:27Z", "Asia/Kolkata", True, us(2025, 1, 1, 11, 36, 27)),
    ("2025-01-02T12:45:37+05:30", None, None, us(2025, 1, 2, 7, 15, 37)),
    ("2025-01-12T05:42:59+0000", None, None, us(2025, 1, 12, 5, 42, 59)),
    ("2025-01-12 07:07:30 +05:30", None, None, us(2025, 1, 12, 1, 37, 30)),
    ("06/01/2025 10:42", "UTC", True, us(2025, 1, 6, 10, 42)),
    ("06/01/2025 10:42", "UTC", False, us(2025, 6, 1, 10, 42)),
    ("13/01/2025", "UTC", False, None),
    ("2025-01-11", "Asia/Singapore", True, us(2025, 1, 10, 16)),
    ("Wed, 01 Jan 2025 08:17:03 +0530", None, None, us(2025, 1, 1, 2, 47, 3)),
    ("Fri, 10 Jan 2025 23:40:43 IST", None, None, us(2025, 1, 10, 18, 10, 43)),
    ("Sun, 30 Mar 2025 02:13:47 BST", None, None, us(2025, 3, 30, 1, 13, 47)),
    ("Wed, 16 Apr 2025 08:57:54 CEST", None, None, us(2025, 4, 16, 6, 57, 54)),
    ("02-Jan-2025 03:54 IST", None, None, us(2025, 1, 1, 22, 24)),
    ("09-JAN-2025 16:26", "UTC", True, us(2025, 1, 9, 16, 26)),
    ("10 January 2025, 23:01", "UTC", True, us(2025, 1, 10, 23, 1)),
    ("Jan 11, 2025 7:30 AM", "UTC", True, us(2025, 1, 11, 7, 30)),
    ("Jun 25, 2025 12:01 AM", "UTC", True, us(2025, 6, 25, 0, 1)),
    ("Feb 23, 2025 12:05 PM", "UTC", True, us(2025, 2, 23, 12, 5)),
    ("1736421865939", None, None, 1736421865939000),
    (" 1735850595 ", None, None, 1735850595000000),
    ("1736405599.006", None, None, 1736405599006000),
    ("20250101T060254Z", None, None, us(2025, 1, 1, 6, 2, 54)),
    ("2025-01-23T10:23:19[Europe/London]", "Asia/Kolkata", True, us(2025, 1, 23, 10, 23, 19)),
    ("2025-01-03T00:41:02.706354+05:30", None, None, us(2025, 1, 2, 19, 11, 2, 706354)),
    # happens twice: the first; skipped: the offset before the change
    ("2025-11-02T01:30:00", "America/New_York", False, us(2025, 11, 2, 5, 30)),
    ("2025-03-09T02:30:00", "America/New_York", False, us(2025, 3, 9, 7, 30)),
    ("2025-02-30T10:00:00Z", None, None, None), ("2025-13-04", "UTC", True, None), ("0000-00-00 00:00:00", "UTC", True, None),
    ("31 November 2025, 10:15", "UTC", True, None), ("2025-06-1x", "UTC", True, None), ("yesterday", "UTC", True, None), ("3 hours ago", "UTC", True, None),
    ("", "UTC", True, None), ("  ", "UTC", True, None), (None, "UTC", True, None), ("n/a", "UTC", True, None), ("x" * 5000, "UTC", True, None), ("Jan 11, 2025 13:30 AM", "UTC", True, None),
])
def test_parse_instant(raw, zone, day_first, want):
    assert parse_instant(raw, zone, day_first) == want


def test_dictionary_parses_once_and_keeps_rows(spark):
    rows = spark.createDataFrame(
        [(1, "2025-01-01T00:00:00Z", None, 7), (2, "2025-01-01T00:00:00Z", None, 7), (3, None, "Asia/Kolkata", 7), (4, "  ", None, 7), (5, "2025-01-01", "Asia/Kolkata", 7), (5, "2025-01-01", "Asia/Kolkata", 7), (6, "soon", None, 7)],
        "id int, raw string, zone string, utc_micros int")
    d = TimestampDictionary(spark)
    got = {(r.id, r.utc_micros) for r in d.normalise(rows, F.col("raw"), F.col("zone"), F.lit(None).cast("boolean")).collect()}
    assert got == {(1, us(2025, 1, 1)), (2, us(2025, 1, 1)), (3, None), (4, None), (5, us(2024, 12, 31, 18, 30)), (6, None)}
    assert d.read().count() == 3
    more = rows.union(spark.createDataFrame([(9, "2025-01-02", None, 0)], rows.schema))
    assert d.normalise(more, F.col("raw"), F.col("zone"), F.lit(None).cast("boolean")).count() == 8
    assert d.read().count() == 4
    assert d.normalise(rows.limit(0), F.col("raw"), F.col("zone"), F.lit(True)).count() == 0


def test_dictionary_with_a_hot_value(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "2025-01-01").otherwise(F.concat(F.lit("2025-01-02 00:00:0"), (F.col("id") % 7).cast("string"))).alias("raw"))
    got = TimestampDictionary(spark).normalise(rows, F.col("raw"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    counts = {r.utc_micros: r["count"] for r in got.groupBy("utc_micros").count().collect()}
    assert counts[us(2025, 1, 1)] == 4000 and sum(counts.values()) == 6000 and len(counts) == 8


def test_parse_column_and_source_zone(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "id int, source_name string")
    sources = spark.createDataFrame([("a", "Asia/Kolkata", False)], "source_name string, home_zone string, day_first boolean")
    zoned = with_source_zone(rows, sources).select("id", parse_column(F.lit("02/01/2025"), F.col("_zone"), F.col("_day")).alias("t"))
    assert {tuple(r) for r in zoned.collect()} == {(1, us(2025, 1, 31, 18, 30)), (2, us(2025, 1, 2)), (3, us(2025, 1, 2))}
    assert with_source_zone(rows.limit(0), sources.limit(0)).count() == 0


def test_a_value_that_becomes_hot_in_a_later_run(spark):
    kept = TimestampDictionary(spark)
    schema = "id int, raw string"
    once = kept.normalise(spark.createDataFrame([(1, "2025-01-02 03:04"), (2, "soon")], schema), F.col("raw"), F.lit("UTC"), F.lit(True))
    assert kept.hot.count() == 0 and once.where("utc_micros is not null").count() == 1
    many = spark.range(5000).selectExpr("cast(id as int) as id", "case when id < 4000 then '2025-01-02 03:04' else concat('2025-03-01 00:00:00.', id) end as raw")
    again = kept.normalise(many, F.col("raw"), F.lit("UTC"), F.lit(True))
    assert [r._raw for r in kept.hot.collect()] == ["2025-01-02 03:04"]
    assert again.count() == 5000 and again.where("utc_micros is null").count() == 0


def test_long_texts_are_read_whole():
    assert parse_instant(" " * 200 + "2025-01-02" + " " * 200) is not None
    assert parse_instant("2025-01-02T03:04:05" + " " * 200 + "+05:30") == parse_instant("2025-01-02T03:04:05+05:30")
    assert parse_instant("2025-01-02 " * 50_000) is None
