"""Feeds: the dimension of publishers, feed documents to article rows, a live source with failover, and how a fetch went."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.functions.text import blank_to_null
from newsloom.operators.timestamps import parse_column
from newsloom.schemas import FEED_ITEM


def first_filled(*columns: Column) -> Column:
    """The first that isn't blank, else an empty text."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def read_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of feed files (RSS: item, Atom: entry), read in parallel; malformed items are skipped."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(FEED_ITEM).load(path)


def parse_items(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of one XML element each in column xml, with the other columns; what isn't XML gives null fields."""
    others = [c for c in documents.columns if c != xml]
    return documents.select(*others, F.from_xml(F.col(xml), FEED_ITEM, {"mode": "PERMISSIVE"}).alias("i")).select(*others, "i.*")


def to_articles(items: DataFrame, description_field: Column | None = None, date_field: Column | None = None, as_of: str | None = None) -> DataFrame:
    """Article rows of feed items; title and link are required.

    The description is the field that the source names, else the first filled of summary, description, content. The date is the field named, else published, updated,
    pubDate; published_ts is its instant, as_of where it can't be read.
    """
    description_field = F.lit("description") if description_field is None else description_field
    date_field = F.lit("published") if date_field is None else date_field
    pick = lambda name, fields: F.coalesce(*[F.when(name == f, blank_to_null(F.col(f))) for f in fields], F.lit(None).cast("string"))
    text = first_filled(pick(description_field, ("summary", "description", "content")), F.col("summary"), F.col("description"), F.col("content"))
    raw = first_filled(pick(date_field, ("published", "updated", "pubDate")), F.col("published"), F.col("updated"), F.col("pubDate"))
    others = [c for c in items.columns if c not in {x.split()[0] for x in FEED_ITEM.split(", ")}]
    rows = items.where(blank_to_null(F.col("title")).isNotNull() & blank_to_null(F.col("link")).isNotNull())
    micros = parse_column(raw, F.lit("UTC"), F.lit(True))
    ts = F.timestamp_micros(micros)
    return rows.select(
        *others, "title", text.alias("description"), "link", raw.alias("published"), (F.coalesce(ts, F.lit(as_of).cast("timestamp")) if as_of else ts).alias("published_ts"),
        F.coalesce("author", F.lit("")).alias("author"), F.coalesce("guid", F.col("link")).alias("guid"), F.coalesce("category", F.array()).alias("category"), F.length(text).alias("content_length"),
    )


def active(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce("active", F.lit(True)))


def fetch(urls: list[str], get: Callable[[str], bytes], attempts: int = 2, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes | None, str]:
    """The first non-empty answer of urls (primary, then backup) within attempts, with exponential waits between; and the last error."""
    error = ""
    for k in range(attempts):
        for url in urls:
            try:
                if body := get(url):
                    return body, ""
                error = f"empty answer of {url}"
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        if k + 1 < attempts:
            sleep(backoff**k)
    return None, error


class _Source(InputPartition):
    def __init__(self, name: str, urls: list[str]):
        self.name, self.urls = name, urls


class FeedSource(DataSource):
    """spark.read.format("newsfeed"): one partition a source. Options: sources as name=url|backup lines, timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "newsfeed"

    def schema(self) -> str:
        return "source string, document string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options):
        self.sources = [line.split("=", 1) for line in options.get("sources", "").splitlines() if "=" in line]
        self.timeout = float(options.get("timeout", 10))

    def partitions(self) -> list[InputPartition]:
        return [_Source(name.strip(), [u.strip() for u in urls.split("|")]) for name, urls in self.sources]

    def read(self, partition: _Source) -> Iterator[tuple]:
        from urllib.request import urlopen

        def get(url: str) -> bytes:
            with urlopen(url, timeout=self.timeout) as r:
                return r.read()

        body, error = fetch(partition.urls, get)
        yield partition.name, None if body is None else body.decode("utf-8", "replace"), error or None


def fetch_report(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Of each source: whether it is active, how many articles it gave, whether it failed (active without any)."""
    counts = articles.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_articles"))
    joined = sources.select("source_name", F.coalesce("active", F.lit(True)).alias("active")).join(counts, "source_name", "left")
    n = F.coalesce("n_articles", F.lit(0))
    return joined.select("source_name", "active", n.alias("n_articles"), (F.col("active") & (n == 0)).alias("failed"))


def failure_summary(report: DataFrame) -> DataFrame:
    """One row: sources attempted, successful, failed, share of successes in percent, how severe the failures are, and the failed sources by name."""
    total, failed = F.count_if("active"), F.count_if("failed")
    row = report.agg(total.alias("attempted"), failed.alias("failed"), F.sum("n_articles").alias("articles"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("source_name")))), "|").alias("failed_sources"))
    ok = F.col("attempted") - F.col("failed")
    severity = F.when(ok == 0, "critical").when(ok < F.col("attempted") / 2, "high").otherwise("low")
    return row.select("attempted", ok.alias("successful"), "failed", F.coalesce("articles", F.lit(0)).alias("articles"), F.round(F.coalesce(F.try_divide(ok, F.col("attempted")), F.lit(0.0)) * 100, 1).alias("success_rate"), severity.alias("severity"), "failed_sources")
