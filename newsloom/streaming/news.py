"""The stateful parts as streams: ingest of dropped files, debounced typing, recent searches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.sources.cache import replace_by_key


def ingest(spark: SparkSession, folder: str, schema: str, event_time: str = "ts", key: str = "link", late: str = "1 day") -> DataFrame:
    """Articles dropped as Parquet files, the first of each key within the watermark."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def to_table(rows: DataFrame, path: str, checkpoint: str, key: str = "company_symbol") -> StreamingQuery:
    """Appends each micro-batch to the cache, partitioned by key, in folders named by batch, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy(key).parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(typed: DataFrame, user: str = "user_id", ts: str = "ts", text: str = "query", delay: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last text of each burst of typing, when the burst is over."""
    rows = typed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, delay).alias("burst"), user).agg(F.max_by(text, ts).alias(text), F.max(ts).alias(ts)).select(user, text, ts)


def recent(searches: DataFrame, user: str = "user_id", item: str = "symbol", ts: str = "ts", keep: int = 10) -> DataFrame:
    """After each micro-batch, the list of recent items of every user that searched in it: state is one short list a user."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(ts)
        for x in rows[item]:
            if x in items:
                items.remove(x)
            items.insert(0, x)
            del items[keep:]
        state.update((items,))
        yield pd.DataFrame({user: [key[0]], "items": [items]})

    return searches.groupBy(user).applyInPandasWithState(update, f"{user} bigint, items array<string>", "items array<string>", "update", GroupStateTimeout.NoTimeout)


def replacing(rows: DataFrame, path: str, checkpoint: str, key: str = "company_symbol"):
    """Writes a stream of whole collections to a cache table: each micro-batch replaces the rows of the keys it holds and leaves all others, until what is there is read."""

    def replace(batch: DataFrame, number: int) -> None:
        replace_by_key(batch, path, key)

    return rows.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
