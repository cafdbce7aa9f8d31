"""Views that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import master

AS_OF = "2025-07-01 00:00:00"
WS = r"[\t-\r \x{85}\p{Z}]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.clean(read(spark, sf_dir, "nse_stocks_raw"))


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{WS}+|{WS}+\z', '', 'g')"


def sql_squeeze(c: str) -> str:
    return rf"regexp_replace({c}, '{WS}+', ' ', 'g')"


_T = {c: f"nullif({sql_strip(c)}, '')" for c in ("symbol", "company_name", "series", "listing_date", "paid_up_value", "market_lot", "isin_number", "face_value")}
COMPANIES = f"""typed AS (
  SELECT upper({_T['symbol']}) AS symbol, {_T['company_name']} AS company_name, upper({_T['series']}) AS series,
    coalesce(try_strptime({_T['listing_date']}, '%d-%b-%Y'), try_strptime({_T['listing_date']}, '%Y-%m-%d'))::DATE AS listing_date,
    try_cast({_T['paid_up_value']} AS DOUBLE) AS paid_up_value, try_cast({_T['market_lot']} AS INTEGER) AS market_lot,
    {_T['isin_number']} AS isin_number, try_cast({_T['face_value']} AS DOUBLE) AS face_value
  FROM nse_stocks_raw),
companies AS (
  SELECT * FROM typed WHERE symbol IS NOT NULL AND company_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY company_name NULLS LAST, series NULLS LAST, listing_date NULLS LAST,
    paid_up_value NULLS LAST, market_lot NULLS LAST, isin_number NULLS LAST, face_value NULLS LAST) = 1)"""


def sql_without_suffix(c: str) -> str:
    from newsloom.functions.text import SUFFIXES

    whens = " ".join(f"WHEN {sql_strip(c)}[-{len(s)}:] = '{s}' THEN {sql_strip(f'{sql_strip(c)}[:-{len(s) + 1}]')}" for s in SUFFIXES)
    return f"CASE {whens} ELSE {sql_strip(c)} END"


def sql_replace_suffixes(c: str) -> str:
    from newsloom.functions.text import SUFFIXES

    for s in SUFFIXES:
        c = f"replace({c}, '{s}', '')"
    return sql_strip(c)


def query_list(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "query string")


def sql_list(texts: tuple[str, ...], name: str = "query") -> str:
    return "(VALUES " + ", ".join(f"('{t}')" for t in texts) + f") AS q({name})"


__all__ = ["AS_OF", "COMPANIES", "F", "WS", "companies", "query_list", "read", "sql_list", "sql_replace_suffixes", "sql_squeeze", "sql_strip", "sql_without_suffix"]
