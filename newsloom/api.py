"""The single-company entry point over the same plans: search, verdict documents with a typed status, recent searches."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsloom.functions.display import ERRORS
from newsloom.operators import search, verdict
from newsloom.plans import news_queries
from newsloom.plans.shared import companies
from newsloom.session import ship


class News:
    """tables: the folder of Parquet tables."""

    def __init__(self, spark: SparkSession, tables: str):
        ship(spark)
        self.spark, self.tables = spark, tables
        self._recent: list[dict] = []

    def autocomplete(self, text: str, limit: int = 10) -> list[dict]:
        """Suggestions for a typed text, by its first letters where nothing else is found."""
        typed = self.spark.createDataFrame([(text,)], "query string")
        master = companies(self.spark, self.tables)
        rows = search.autocomplete(master, typed, limit).orderBy("search_relevance", "value").collect() or search.fallback(master, typed, limit=limit).collect()
        return [r.asDict() for r in rows]

    def run(self, symbols: list[str]) -> dict[str, dict]:
        """The verdict document of each symbol; {'status': 'not_found' or 'no_articles', 'error': ...} where there is none."""
        wanted = [s.strip().upper() for s in symbols]
        known = {r.symbol: r.company_name for r in companies(self.spark, self.tables).where(F.col("symbol").isin(wanted)).select("symbol", "company_name").collect()}
        predicted = news_queries.predicted(self.spark, self.tables, wanted)
        docs = {r.company_symbol: json.loads(r.document) for r in verdict.documents(predicted, companies(self.spark, self.tables)).collect()}
        out: dict[str, dict] = {}
        for s in wanted:
            status = "ok" if s in docs else "no_articles" if s in known else "not_found"
            out[s] = {"status": status, **docs[s]} if status == "ok" else {"status": status, "error": ERRORS[status]}
            if s in known:
                self._recent = [{"symbol": s, "name": known[s], "at": datetime.now().isoformat(timespec="seconds")}, *[x for x in self._recent if x["symbol"] != s]][:10]
        return out

    def recent(self, n: int = 5) -> list[dict]:
        return self._recent[:n]
