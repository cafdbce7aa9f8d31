"""Queries over the company master."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import search
from newsloom.plans.shared import AS_OF, COMPANIES, companies, query_list, read, sql_list, sql_replace_suffixes, sql_squeeze, sql_strip, sql_without_suffix
from newsloom.sources import tables

TYPED = ("KI", "RABISATO", "pharma", "du", "Limited", "MU", "ZZZZ", "100%")
SYMBOLS = ("rabisato", "KIHESEKUTH", "DUMASIBAL", "NOSUCH")
ISINS = ("INZ000000011", "INZ000000022", "INZ000000044", "INZ999999999")
WITH = f"WITH {COMPANIES} "

Q, S = {}, {}

Q["company_master"] = lambda spark, d: companies(spark, d).withColumns({"listing_date": F.col("listing_date").cast("string"), "market_lot": F.col("market_lot").cast("double")})
S["company_master"] = WITH + "SELECT * REPLACE (listing_date::VARCHAR AS listing_date, market_lot::DOUBLE AS market_lot) FROM companies"

Q["company_stats"] = lambda spark, d: companies(spark, d).agg(
    F.count(F.lit(1)).alias("n_companies"), F.count_distinct("series").alias("n_series"), F.count("isin_number").alias("n_isin"),
    F.count_if(F.col("listing_date") >= F.date_sub(F.lit(AS_OF[:10]).cast("date"), 365)).alias("n_recent"))
S["company_stats"] = WITH + f"""SELECT count(*) AS n_companies, count(DISTINCT series) AS n_series, count(isin_number) AS n_isin,
  count(*) FILTER (WHERE listing_date >= DATE '{AS_OF[:10]}' - 365) AS n_recent FROM companies"""

Q["series_counts"] = lambda spark, d: companies(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "series")
S["series_counts"] = WITH + "SELECT series, count(*) AS n FROM companies GROUP BY series"

Q["distinct_series"] = lambda spark, d: companies(spark, d).where("series is not null").select("series").distinct().orderBy("series")
S["distinct_series"] = WITH + "SELECT DISTINCT series FROM companies WHERE series IS NOT NULL"

Q["recently_listed"] = lambda spark, d: search.recently_listed(companies(spark, d), AS_OF[:10], 700, 20).select("symbol", "company_name", F.col("listing_date").cast("string").alias("listing_date"))
S["recently_listed"] = WITH + f"""SELECT symbol, company_name, listing_date::VARCHAR AS listing_date FROM companies WHERE listing_date >= DATE '{AS_OF[:10]}' - 700
  ORDER BY companies.listing_date DESC, symbol LIMIT 20"""

Q["lookup_isin"] = lambda spark, d: companies(spark, d).where(F.col("isin_number").isin(*ISINS)).select("isin_number", "symbol", "company_name", "series", "market_lot")
S["lookup_isin"] = WITH + f"SELECT isin_number, symbol, company_name, series, market_lot FROM companies WHERE isin_number IN {ISINS}"

Q["search_exact"] = lambda spark, d: search.by_symbol(companies(spark, d), query_list(spark, SYMBOLS)).select("query", "symbol", "company_name")
S["search_exact"] = WITH + f"SELECT query, symbol, company_name FROM companies JOIN {sql_list(SYMBOLS)} ON upper(trim(query)) = symbol"

_TIERS = WITH + f""", hits AS (SELECT query, symbol, company_name, series, unnest(list_filter([
    CASE WHEN symbol = upper(query) THEN 1 END, CASE WHEN starts_with(upper(symbol), upper(query)) AND symbol <> upper(query) THEN 2 END,
    CASE WHEN starts_with(upper(company_name), upper(query)) AND NOT starts_with(upper(symbol), upper(query)) THEN 3 END,
    CASE WHEN contains(upper(company_name), upper(query)) AND NOT starts_with(upper(company_name), upper(query)) THEN 4 END], lambda x: x IS NOT NULL)) AS priority
  FROM companies, {sql_list(TYPED)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, CASE WHEN priority <= 2 THEN symbol ELSE company_name END, symbol) AS place FROM hits
  QUALIFY place <= 10),
once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY query, symbol ORDER BY place) = 1) """
Q["search_tiered_topk"] = lambda spark, d: search.tiered(companies(spark, d), query_list(spark, TYPED)).select("query", "priority", "place", "symbol", "company_name")
S["search_tiered_topk"] = _TIERS + "SELECT query, priority, place, symbol, company_name FROM once"

Q["search_prefix"] = lambda spark, d: companies(spark, d).where(F.col("symbol").ilike("KI%") | F.col("company_name").ilike("KI%")).select("symbol", "company_name")
S["search_prefix"] = WITH + "SELECT symbol, company_name FROM companies WHERE symbol ILIKE 'KI%' OR company_name ILIKE 'KI%'"

Q["search_multi_field"] = lambda spark, d: search.ranked(companies(spark, d), query_list(spark, TYPED))
S["search_multi_field"] = WITH + f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN symbol = upper(query) THEN 1
    WHEN starts_with(upper(symbol), upper(query)) THEN 2 WHEN starts_with(upper(company_name), upper(query)) THEN 3 ELSE 4 END, symbol, company_name) AS rank, symbol, company_name
  FROM companies, {sql_list(TYPED)} WHERE contains(upper(symbol), upper(query)) OR contains(upper(company_name), upper(query)) OR contains(upper(coalesce(isin_number, '')), upper(query))
  QUALIFY rank <= 20"""

Q["suggestions_format"] = lambda spark, d: search.suggestions(search.tiered(companies(spark, d), query_list(spark, TYPED)))
_TEXT = "symbol || ' - ' || company_name"
S["suggestions_format"] = _TIERS + f"""SELECT query, symbol AS value, {_TEXT} AS display_text,
  CASE WHEN length(company_name) > 50 THEN company_name[:50] || '...' ELSE company_name END AS title,
  CASE WHEN series IS NOT NULL THEN series || ' Series' ELSE 'Listed Stock' END AS subtitle,
  regexp_replace({_TEXT}, '(?i)(' || regexp_replace(query, '([^a-zA-Z0-9_ ])', '\\\\\\1', 'g') || ')', '**\\1**', 'g') AS highlighted, priority AS search_relevance FROM once"""

Q["autocomplete"] = lambda spark, d: search.autocomplete(companies(spark, d), query_list(spark, (" ki ", "r", "M&U", "dum-")))
S["autocomplete"] = _TIERS.replace(sql_list(TYPED), sql_list(("KI", "MU", "DUM-"))) + S["suggestions_format"].split("once AS")[1].split("= 1) ", 1)[1]

Q["highlight_term"] = lambda spark, d: companies(spark, d).select("symbol", T.highlight(F.col("company_name"), F.lit("li")).alias("highlighted"))
S["highlight_term"] = WITH + r"SELECT symbol, regexp_replace(company_name, '(?i)(li)', '**\1**', 'g') AS highlighted FROM companies"

Q["similar_companies"] = lambda spark, d: search.similar(companies(spark, d), companies(spark, d).select("symbol"))
S["similar_companies"] = WITH + """, own AS (SELECT symbol AS of_symbol, string_split(company_name, ' ')[1] AS first_word FROM companies)
SELECT of_symbol, row_number() OVER (PARTITION BY of_symbol ORDER BY company_name, symbol) AS rank, symbol, company_name
FROM companies, own WHERE starts_with(company_name, first_word) AND symbol <> of_symbol QUALIFY rank <= 5"""

Q["by_series"] = lambda spark, d: search.of_series(companies(spark, d)).select("series", "rank", "symbol", "company_name")
S["by_series"] = WITH + "SELECT series, row_number() OVER (PARTITION BY series ORDER BY company_name, symbol) AS rank, symbol, company_name FROM companies WHERE series IS NOT NULL QUALIFY rank <= 100"

Q["search_terms"] = lambda spark, d: companies(spark, d).select("symbol", F.array_join(T.search_terms(F.col("symbol"), F.col("company_name")), "|").alias("terms"))
_CLEANED = sql_replace_suffixes("company_name")
S["search_terms"] = WITH + f""", w AS (SELECT symbol, company_name, {_CLEANED} AS cleaned FROM companies),
v AS (SELECT *, string_split({sql_squeeze('cleaned')}, ' ') AS words FROM w),
l AS (SELECT symbol, unnest([symbol, company_name, cleaned, CASE WHEN len(words) >= 2 THEN words[1] || ' ' || words[2] END]) AS t, unnest([1, 2, 3, 4]) AS k FROM v),
f AS (SELECT symbol, t, min(k) AS k FROM l WHERE t IS NOT NULL AND t <> '' GROUP BY symbol, t)
SELECT symbol, string_agg(t, '|' ORDER BY k) AS terms FROM f GROUP BY symbol"""

Q["clean_company_name"] = lambda spark, d: companies(spark, d).select("symbol", T.without_suffix(F.col("company_name")).alias("name"))
S["clean_company_name"] = WITH + f"SELECT symbol, {sql_without_suffix('company_name')} AS name FROM companies"

Q["company_context"] = lambda spark, d: search.context(companies(spark, d)).select(
    "symbol", "nse_symbol", "status", "validated", "primary_search_term", "secondary_search_term", F.col("news_config.date_range_days").alias("days"), F.size("search_terms").alias("n_terms"))
S["company_context"] = S["search_terms"].split("SELECT symbol, string_agg")[0] + """SELECT symbol, symbol AS nse_symbol, 'active' AS status, true AS validated,
  (list(t ORDER BY k))[1] AS primary_search_term, (list(t ORDER BY k))[2] AS secondary_search_term, 30 AS days, count(*)::INT AS n_terms FROM f GROUP BY symbol"""

Q["raw_input_clean"] = lambda spark, d: read(spark, d, "news_cache").select("id", T.clean_query(F.col("article_title")).alias("cleaned"))
S["raw_input_clean"] = rf"SELECT id, upper(regexp_replace({sql_squeeze(sql_strip('article_title'))}, '[^a-zA-Z0-9\-.\t-\r \x{{85}}\p{{Z}}]', '', 'g')) AS cleaned FROM news_cache"

Q["validate_symbols"] = lambda spark, d: read(spark, d, "news_cache").groupBy("company_symbol").agg(F.count(F.lit(1)).alias("n")).join(
    companies(spark, d).select(F.col("symbol").alias("company_symbol"), F.lit(True).alias("_k")), "company_symbol", "left").select("company_symbol", "n", F.col("_k").isNotNull().alias("known"))
S["validate_symbols"] = WITH + "SELECT company_symbol, count(*) AS n, company_symbol IN (SELECT symbol FROM companies) AS known FROM news_cache GROUP BY company_symbol"

Q["series_search_counts"] = lambda spark, d: search.tiered(companies(spark, d), query_list(spark, TYPED)).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
S["series_search_counts"] = _TIERS + "SELECT query, count(*) AS n FROM once GROUP BY query"


def _point_query(spark, d):
    tables.register(spark, d, ("news_cache",))
    return tables.query(spark, "SELECT id, article_title FROM news_cache WHERE company_symbol = ? AND relevance_score >= ? AND NOT isnan(relevance_score)", "DUMASIBAL", 0.5)


Q["sql_point_query"] = _point_query
S["sql_point_query"] = "SELECT id, article_title FROM news_cache WHERE company_symbol = 'DUMASIBAL' AND relevance_score >= 0.5 AND NOT isnan(relevance_score)"

# there is no source of sectors: a search by sector finds nothing, with the columns of any search
Q["sector_search"] = lambda spark, d: companies(spark, d).where("false").select("symbol", "company_name")
S["sector_search"] = WITH + "SELECT symbol, company_name FROM companies WHERE false"
