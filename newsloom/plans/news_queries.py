"""Queries over articles: the cache, feeds, answers, collection, filtering, preparation, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import display, scores, text as T
from newsloom.operators import chunks, collect, dedupe, sentiment, sessions, verdict
from newsloom.plans.instants import EXPIRES, PUBLISHED, sql_instants
from newsloom.plans.shared import AS_OF, COMPANIES, WS, companies, query_list, read, sql_squeeze, sql_strip, sql_without_suffix
from newsloom.operators.timestamps import parse_column, with_source_zone
from newsloom.session import materialise, shared_dir, spread
from newsloom.sources import answers, cache, feeds

WITH = f"WITH {COMPANIES} "
Q, S = {}, {}
news = lambda spark, d: read(spark, d, "news_cache")

# --- the cache ---------------------------------------------------------------------------------------------------------
Q["cache_valid"] = lambda spark, d: cache.valid(news(spark, d), AS_OF).select("id", "company_symbol", "expires_date")
S["cache_valid"] = f"SELECT id, company_symbol, x AS expires_date FROM {sql_instants(EXPIRES)} WHERE utc_micros > epoch_us(TIMESTAMP '{AS_OF}')"

Q["cache_purge"] = lambda spark, d: cache.purge(news(spark, d), AS_OF).select("id", "company_symbol")
S["cache_purge"] = f"SELECT id, company_symbol FROM {sql_instants(EXPIRES)} WHERE coalesce(utc_micros >= epoch_us(TIMESTAMP '{AS_OF}'), true)"

Q["cache_purge_count"] = lambda spark, d: news(spark, d).agg(F.count_if(cache.instant(F.col("expires_date")) < F.lit(AS_OF).cast("timestamp")).alias("deleted"))
S["cache_purge_count"] = f"SELECT count(*) FILTER (WHERE utc_micros < epoch_us(TIMESTAMP '{AS_OF}')) AS deleted FROM {sql_instants(EXPIRES)}"

Q["cache_stats"] = lambda spark, d: cache.stats(news(spark, d))
S["cache_stats"] = "SELECT count(*) AS n_articles, count(DISTINCT company_symbol) AS n_companies, count(DISTINCT source_name) AS n_sources FROM news_cache"

Q["articles_by_source"] = lambda spark, d: news(spark, d).groupBy("source_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_name")
S["articles_by_source"] = "SELECT source_name, count(*) AS n FROM news_cache GROUP BY source_name"


def _cache_or_fetch(spark, d):
    rows = news(spark, d)
    cached = cache.valid(rows, AS_OF).select("company_symbol", "article_url", F.lit(True).alias("from_cache"))
    fresh = rows.where("article_url is not null").select("company_symbol", "article_url", F.lit(False).alias("from_cache"))
    return cache.cached_or_fresh(cached, fresh)


Q["cache_or_fetch"] = _cache_or_fetch
S["cache_or_fetch"] = f"""WITH c AS (SELECT company_symbol, article_url FROM news_cache WHERE id IN (SELECT id FROM ({S['cache_valid']})))
SELECT company_symbol, article_url, true AS from_cache FROM c UNION ALL
SELECT company_symbol, article_url, false FROM news_cache WHERE article_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.company_symbol = news_cache.company_symbol)"""


def _replace_by_key(spark, d):
    """Writes a cache by series, replaces one key's rows, and reads what is there then."""
    path = shared_dir(spark, "cache")
    rows = news(spark, d).select("id", "article_title", F.coalesce("source_name", F.lit("unknown")).alias("source_name"))
    cache.replace_by_key(rows, path, "source_name")
    cache.replace_by_key(rows.where("source_name = 'Market Lantern' and id % 2 = 0"), path, "source_name")
    return spark.read.parquet(path).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))


Q["cache_replace_by_key"] = _replace_by_key
S["cache_replace_by_key"] = """SELECT coalesce(source_name, 'unknown') AS source_name, count(*) AS n, min(id) AS least_id FROM news_cache
WHERE coalesce(source_name, 'unknown') <> 'Market Lantern' OR id % 2 = 0 GROUP BY 1"""

Q["cache_backup"] = lambda spark, d: _backup(spark, d)


def _backup(spark, d):
    to = shared_dir(spark, "backup")
    cache.backup(spark, f"{d}/news_cache.parquet", to)
    return spark.read.parquet(to).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


S["cache_backup"] = "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM news_cache"

Q["recent_searches"] = lambda spark, d: sessions.recent(read(spark, d, "events"), "user_id", "event_type", "ts").select("user_id", "event_type", "rank")
S["recent_searches"] = """SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, max_by(event_id, (ts, event_id)) DESC) AS rank
FROM events GROUP BY user_id, event_type QUALIFY rank <= 10"""

Q["debounce"] = lambda spark, d: sessions.debounced(read(spark, d, "events"), delay_ms=3_600_000).select("event_id", "user_id")
S["debounce"] = """SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR"""

# --- answers and feeds -------------------------------------------------------------------------------------------------
Q["llm_json_parse"] = lambda spark, d: answers.normalise(read(spark, d, "llm_responses")).select("response_id", "company_symbol", "place", "title", "link", "description", "published")
_UNFENCE = sql_strip(rf"regexp_replace({sql_strip('body')}, '\A```(json)?', '')")
_UNFENCE = sql_strip(rf"regexp_replace({_UNFENCE}, '```\z', '')")
_UNFENCE = sql_strip(f"ltrim({_UNFENCE}, 'json')")
_ANSWERS = f"""WITH u AS (SELECT response_id, company_symbol, fetched_at, {_UNFENCE} AS t FROM llm_responses),
v AS (SELECT *, CASE WHEN starts_with(t, '[') AND json_valid(t) THEN t ELSE '[]' END AS j FROM u WHERE t IS NOT NULL),
a AS (SELECT response_id, company_symbol, fetched_at, unnest(j::JSON[]) AS o, generate_subscripts(j::JSON[], 1) - 1 AS place FROM v) """
S["llm_json_parse"] = _ANSWERS + f"""SELECT response_id, company_symbol, place, {sql_strip("o->>'title'")} AS title, {sql_strip("o->>'url'")} AS link, coalesce(o->>'summary', '') AS description,
  strftime(coalesce(try_strptime(o->>'date', '%Y-%m-%d'), (fetched_at AT TIME ZONE 'UTC')::DATE::TIMESTAMP), '%Y-%m-%d') AS published
FROM a WHERE {sql_strip("o->>'title'")} <> '' AND regexp_matches({sql_strip("o->>'url'")}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+')"""

Q["llm_answer_sizes"] = lambda spark, d: read(spark, d, "llm_responses").select("response_id", F.size(answers.articles_of(F.col("body"))).cast("int").alias("n")).where("n >= 0")
S["llm_answer_sizes"] = _ANSWERS + "SELECT response_id, len(j::JSON[])::INT AS n FROM v"



def _envelopes(spark, d):
    """Every answer inside the envelope that a provider sends, and read out of it again."""
    part = F.when(F.col("body").isNotNull(), F.array(F.struct(F.col("body").alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))
    reason = F.when(F.col("response_id") % 5 == 0, "MAX_TOKENS").otherwise("STOP")
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(part.alias("parts"), F.lit("model").alias("role")).alias("content"), reason.alias("finishReason"))).alias("candidates")))
    return answers.from_envelope(read(spark, d, "llm_responses").select("response_id", raw.alias("raw")), "raw").select("response_id", "body", "truncated")


Q["provider_envelope"] = _envelopes
S["provider_envelope"] = "SELECT response_id, body, response_id % 5 = 0 AS truncated FROM llm_responses"

Q["url_host_whitelist"] = lambda spark, d: answers.credible(news(spark, d).select("id", F.col("article_url").alias("url")), read(spark, d, "news_sources").where("priority <= 12"), "url", "host").select("id", answers.host(F.col("url")).alias("host"))
_HOST = "replace(lower(regexp_extract(article_url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]+)', 1)), 'www.', '')"
S["url_host_whitelist"] = f"""SELECT id, {_HOST} AS host FROM news_cache WHERE EXISTS (SELECT 1 FROM news_sources s WHERE priority <= 12 AND ({_HOST} = s.host OR ends_with({_HOST}, '.' || s.host)))"""

Q["url_validity"] = lambda spark, d: news(spark, d).groupBy(answers.is_valid_url(F.col("article_url")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))
S["url_validity"] = "SELECT coalesce(regexp_matches(article_url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+'), false) AS valid, count(*) AS n FROM news_cache GROUP BY 1"

Q["url_clean"] = lambda spark, d: news(spark, d).select("id", T.clean_url(F.col("article_url")).alias("url"))
S["url_clean"] = "SELECT id, " + sql_strip("lower(regexp_replace(regexp_replace(article_url, '[?&](utm_|ref=|source=|campaign=)[^&]*', '', 'g'), '[/#]+$', ''))") + " AS url FROM news_cache"


def _feed_articles(spark, d):
    """Every cached article as a feed item of its source, and back: what parsing gives is what was written."""
    rows = news(spark, d).where("article_title is not null and article_url is not null")
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit("&#13;"))
    xml = F.concat(
        F.lit("<item><title>"), esc(F.col("article_title")), F.lit("</title><link>"), esc(F.col("article_url")), F.lit("</link><description>"), esc(F.col("article_content")),
        F.lit("</description><author>"), esc(F.col("company_symbol")), F.lit("</author><pubDate>"), esc(F.col("published_date")), F.lit("</pubDate><category>markets</category><category>"), esc(F.coalesce("source_name", F.lit("none"))), F.lit("</category></item>"))
    items = feeds.parse_items(rows.select("id", xml.alias("xml")))
    return feeds.to_articles(items)


def _feed(spark, d):
    rows = _feed_articles(spark, d).withColumn("description", T.strip(F.col("description")))
    return rows.select("id", T.strip(F.col("title")).alias("title"), T.strip(F.col("link")).alias("link"), F.array_join("category", "|").alias("categories"), "description", F.length("description").alias("length"), "author", T.strip(F.col("guid")).alias("guid"), T.strip(F.col("published")).alias("published"), F.unix_micros("published_ts").alias("utc_micros"))


_CONTENT = "coalesce(article_content, '')"
Q["rss_parse"] = _feed
S["rss_parse"] = rf"""WITH p AS (SELECT id, utc_micros FROM {sql_instants("SELECT id, published_date AS x, 'UTC' AS zone, true AS day_first FROM news_cache")})
SELECT id, {sql_strip('article_title')} AS title, {sql_strip('article_url')} AS link, 'markets|' || coalesce(source_name, 'none') AS categories, {sql_strip(_CONTENT)} AS description, length({sql_strip(_CONTENT)})::INT AS length,
  coalesce(company_symbol, '') AS author, {sql_strip('article_url')} AS guid, {sql_strip("coalesce(published_date, '')")} AS published, utc_micros FROM news_cache JOIN p USING (id)
WHERE regexp_replace(coalesce(article_title, ''), '{WS}', '', 'g') <> '' AND regexp_replace(coalesce(article_url, ''), '{WS}', '', 'g') <> ''"""

Q["source_status"] = lambda spark, d: read(spark, d, "news_sources").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("active", F.lit(True))).alias("active"))
S["source_status"] = "SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(active, true)) AS active FROM news_sources"

Q["active_sources"] = lambda spark, d: feeds.active(read(spark, d, "news_sources")).select("source_name", "priority").orderBy("priority")
S["active_sources"] = "SELECT source_name, priority FROM news_sources WHERE coalesce(active, true)"

Q["fetch_report"] = lambda spark, d: feeds.fetch_report(read(spark, d, "news_sources"), news(spark, d))
S["fetch_report"] = """SELECT s.source_name, coalesce(active, true) AS active, count(n.id) AS n_articles, coalesce(active, true) AND count(n.id) = 0 AS failed
FROM news_sources s LEFT JOIN news_cache n ON n.source_name = s.source_name GROUP BY s.source_name, active"""

Q["failure_severity"] = lambda spark, d: feeds.failure_summary(Q["fetch_report"](spark, d))
S["failure_severity"] = f"""WITH r AS ({S['fetch_report']}), t AS (SELECT count(*) FILTER (WHERE active) AS attempted, count(*) FILTER (WHERE failed) AS failed, sum(n_articles)::BIGINT AS articles,
  coalesce(string_agg(source_name, '|' ORDER BY source_name) FILTER (WHERE failed), '') AS failed_sources FROM r)
SELECT attempted, attempted - failed AS successful, failed, articles, round((attempted - failed) / attempted * 100, 1) AS success_rate,
  CASE WHEN attempted = failed THEN 'critical' WHEN attempted - failed < attempted / 2 THEN 'high' ELSE 'low' END AS severity, failed_sources FROM t"""

# sources whose articles of one day are missing: a fetch window by instants, so that there are failures to report
_SINCE, _UNTIL = "2025-01-06 00:00:00", "2025-01-13 00:00:00"
_window = lambda spark, d: cache.not_older(news(spark, d), _SINCE, AS_OF, into="at").where(F.col("at") < F.lit(_UNTIL).cast("timestamp"))
Q["failures_of_a_week"] = lambda spark, d: feeds.failure_summary(feeds.fetch_report(read(spark, d, "news_sources"), _window(spark, d)))
_CACHED = "SELECT id, source_name, cached_date AS x, 'Asia/Kolkata' AS zone, true AS day_first FROM news_cache"
S["failures_of_a_week"] = S["failure_severity"].replace("LEFT JOIN news_cache n", f"LEFT JOIN (SELECT * FROM {sql_instants(_CACHED)} WHERE utc_micros >= epoch_us(TIMESTAMP '{_SINCE}') AND utc_micros < epoch_us(TIMESTAMP '{_UNTIL}')) n")

# --- collection --------------------------------------------------------------------------------------------------------
Q["relevant_articles"] = lambda spark, d: collect.relevant(news(spark, d), companies(spark, d)).select("id", "company_symbol", F.array_join("matched_terms", "|").alias("matched"), "relevance_score")
_SHORT = sql_without_suffix("company_name")
_TEXT = "lower(coalesce(article_title, '') || ' ' || coalesce(article_content, ''))"
from newsloom.plans.company_queries import S as _CS  # noqa: E402

_TERMS = _CS["search_terms"].split("SELECT symbol, string_agg")[0] + f""", allterms AS (SELECT symbol, lower(t) AS t FROM f UNION SELECT symbol, lower({_SHORT}) FROM companies),
terms AS (SELECT DISTINCT symbol, t FROM allterms WHERE t <> ''),
hits AS (SELECT n.id, t.symbol, t.t FROM (SELECT id, company_symbol, {_TEXT} AS txt FROM news_cache) n JOIN terms t ON __ON__
  WHERE list_bool_and(list_transform(string_split_regex(t.t, ' +'), lambda w: contains(n.txt, w)))) """
S["relevant_articles"] = _TERMS.replace("__ON__", "t.symbol = n.company_symbol") + """SELECT id, symbol AS company_symbol, string_agg(t, '|' ORDER BY t) AS matched, 0.7::DOUBLE AS relevance_score FROM hits GROUP BY id, symbol"""

Q["company_article_match"] = lambda spark, d: collect.about_companies(news(spark, d), companies(spark, d))
S["company_article_match"] = _TERMS.replace("__ON__", "true") + "SELECT DISTINCT id, symbol FROM hits"

Q["dedupe_title_link"] = lambda spark, d: collect.first_per_title_and_link(news(spark, d)).select("id")
S["dedupe_title_link"] = "SELECT id FROM news_cache QUALIFY row_number() OVER (PARTITION BY company_symbol, lower(article_title), article_url ORDER BY id) = 1"

Q["dedupe_url_priority"] = lambda spark, d: collect.first_per_link(news(spark, d), "Gemini Web Search").select("id", "source_name")
S["dedupe_url_priority"] = f"""SELECT id, source_name FROM news_cache WHERE {sql_strip('article_url')} <> ''
QUALIFY row_number() OVER (PARTITION BY company_symbol, article_url ORDER BY CASE WHEN source_name = 'Gemini Web Search' THEN 0 ELSE 1 END, id) = 1"""

Q["top15_per_company"] = lambda spark, d: collect.capped(news(spark, d), 15).select("id", "company_symbol", "rank")
S["top15_per_company"] = "SELECT id, company_symbol, row_number() OVER (PARTITION BY company_symbol ORDER BY id) AS rank FROM news_cache QUALIFY rank <= 15"


Q["newest_by_text"] = lambda spark, d: collect.capped(news(spark, d), 15, order=[F.desc(F.coalesce("published_date", F.lit(""))), F.col("id")]).select("id", "company_symbol", "rank")
S["newest_by_text"] = "SELECT id, company_symbol, row_number() OVER (PARTITION BY company_symbol ORDER BY coalesce(published_date, '') DESC, id) AS rank FROM news_cache QUALIFY rank <= 15"


def _union(spark, d):
    rss = collect.as_articles(news(spark, d))
    llm = answers.normalise(read(spark, d, "llm_responses")).select("company_symbol", "title", "description", "link", "published", "source")
    return collect.all_sources(rss, llm).groupBy("company_symbol", F.when(F.col("source") == "gemini", "gemini").otherwise("feeds").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


Q["union_sources"] = _union
S["union_sources"] = f"""SELECT company_symbol, 'feeds' AS kind, count(*) AS n FROM news_cache WHERE {sql_strip('article_title')} <> '' AND {sql_strip('article_url')} <> '' GROUP BY company_symbol
UNION ALL SELECT company_symbol, 'gemini', count(*) FROM ({S['llm_json_parse']}) GROUP BY company_symbol"""

# --- filtering ---------------------------------------------------------------------------------------------------------
_named = lambda spark, d: spread(news(spark, d)).join(companies(spark, d).select(F.col("symbol").alias("company_symbol"), "company_name"), "company_symbol").select(
    "id", "company_symbol", "company_name", F.coalesce("article_title", F.lit("")).alias("t"), F.coalesce("article_content", F.lit("")).alias("d"))
_NAMED = WITH + f""", n AS (SELECT id, symbol, company_name, coalesce(article_title, '') AS t, coalesce(article_content, '') AS d, {_TEXT} AS txt, lower(company_name) AS whole,
  lower({_SHORT}) AS short FROM news_cache JOIN companies ON symbol = company_symbol) """


def _score(name):
    return lambda spark, d: _scored_rows(spark, d).select("id", F.round(getattr(scores, name)(), 6).alias("score"))


def _scored_rows(spark, d):
    return scores.prepared(_named(spark, d), F.col("t"), F.col("d"), F.col("company_name"), F.col("company_symbol"))


Q["relevance_v1"] = _score("relevance")
_MATCH = "CASE WHEN contains(txt, whole) THEN 1.0::DOUBLE WHEN contains(txt, short) THEN 0.8 WHEN length(string_split(short, ' ')[1]) > 3 AND contains(txt, string_split(short, ' ')[1]) THEN 0.3 ELSE 0 END"
_ANY = lambda words: f"regexp_matches(txt, '{'|'.join(words)}')"
S["relevance_v1"] = _NAMED + f"""SELECT id, round(CASE WHEN {sql_strip('txt')} = '' THEN 0 ELSE least(1.0, greatest(
  CASE WHEN contains(txt, lower(symbol)) THEN 0.8::DOUBLE ELSE 0 END + ({_MATCH}) * 0.6 + CASE WHEN {_ANY(scores.BUSINESS)} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN NOT {_ANY(scores.IRRELEVANT)} THEN 0.05::DOUBLE ELSE 0 END,
  CASE WHEN contains(txt, lower(symbol)) THEN 0.1 WHEN contains(txt, whole) THEN 0.08 ELSE 0 END)) END, 6) AS score FROM n"""

Q["relevance_v0"] = _score("weighted_relevance")
_KEYS = " + ".join(f"({' + '.join(f'contains(txt, {w!r})::INT' for w in ws)}) / {len(ws)}::DOUBLE * {k}" for k, ws in scores.KEYWORDS.items())
_STOP = ", ".join(repr(w) for w in T.STOP_WORDS)
_SIG = f"list_filter(words, lambda w: length(w) > 3 AND w NOT IN ({_STOP}))"
S["relevance_v0"] = _NAMED + f""", w AS (SELECT *, string_split({sql_squeeze('short')}, ' ') AS words FROM n), s AS (SELECT *, {_SIG} AS sig FROM w)
SELECT id, round(CASE WHEN {sql_strip('txt')} = '' THEN 0 ELSE least(1.0, CASE WHEN contains(txt, lower(symbol)) THEN 0.4::DOUBLE ELSE 0 END
  + least(1.0, CASE WHEN contains(txt, whole) THEN 1.0::DOUBLE WHEN contains(txt, short) THEN 0.8 ELSE
      CASE WHEN len(words) >= 2 AND contains(txt, words[1] || ' ' || words[2]) THEN 0.5::DOUBLE ELSE 0 END
      + CASE WHEN len(sig) > 0 THEN len(list_filter(sig, lambda w: contains(txt, w))) / len(sig)::DOUBLE * 0.3 ELSE 0 END END) * 0.3
  + ({_KEYS}) / 6.0::DOUBLE * 0.2
  + least(1.0, CASE WHEN contains(lower(t), lower(symbol)) THEN 0.6::DOUBLE WHEN contains(lower(t), whole) THEN 0.4 ELSE 0 END
      + CASE WHEN contains(lower(d), lower(symbol)) THEN 0.3::DOUBLE WHEN contains(lower(d), whole) THEN 0.2 ELSE 0 END) * 0.1) END, 6) AS score FROM s"""

Q["identifiers_found"] = lambda spark, d: _named(spark, d).select("id", F.array_join(scores.identifiers_found(F.lower(F.concat("t", F.lit(" "), "d")), F.col("company_symbol"), F.col("company_name")), "|").alias("found"))
S["identifiers_found"] = _NAMED + "SELECT id, concat_ws('|', CASE WHEN contains(txt, lower(symbol)) THEN 'symbol:' || symbol END, CASE WHEN contains(txt, whole) THEN 'company:' || company_name END) AS found FROM n"

Q["identifiers_found_v0"] = lambda spark, d: _named(spark, d).select("id", F.array_join(scores.identifiers_found(F.lower(F.concat("t", F.lit(" "), "d")), F.col("company_symbol"), F.col("company_name"), T.search_terms(F.col("company_symbol"), F.col("company_name"))), "|").alias("found"))
S["identifiers_found_v0"] = _CS["search_terms"].split("SELECT symbol, string_agg")[0] + _NAMED.removeprefix(WITH) + """, g AS (SELECT id, string_agg('search_term:' || f.t, '|' ORDER BY k) AS terms FROM n JOIN f ON f.symbol = n.symbol AND contains(txt, lower(f.t)) GROUP BY id)
SELECT id, concat_ws('|', CASE WHEN contains(txt, lower(symbol)) THEN 'symbol:' || symbol END, CASE WHEN contains(txt, whole) THEN 'company:' || company_name END, g.terms) AS found FROM n LEFT JOIN g USING (id)"""

Q["topic_flags"] = lambda spark, d: news(spark, d).select("id", F.coalesce(scores.any_of(F.lower("article_content"), scores.BUSINESS), F.lit(False)).alias("business"), F.coalesce(scores.any_of(F.lower("article_content"), scores.IRRELEVANT), F.lit(False)).alias("irrelevant"))
_RX = lambda ws: f"regexp_matches(lower(article_content), '{'|'.join(ws)}')"
S["topic_flags"] = f"SELECT id, coalesce({_RX(scores.BUSINESS)}, false) AS business, coalesce({_RX(scores.IRRELEVANT)}, false) AS irrelevant FROM news_cache"

Q["dedupe_hash"] = lambda spark, d: dedupe.by_hash_and_url(news(spark, d)).select("id")
# white space and tags as the filter cleans them; the decomposition of compatibility characters has no SQL
_FCLEAN = lambda c: f"""regexp_replace({sql_squeeze(sql_strip(f"coalesce({c}, '')"))}, '<[^>]+>', '', 'g')"""
_HASH = f"md5(lower({_FCLEAN('article_title')} || '|' || substr({_FCLEAN('article_content')}, 1, 200)))"
S["dedupe_hash"] = f"""WITH h AS (SELECT * FROM news_cache QUALIFY row_number() OVER (PARTITION BY company_symbol, {_HASH} ORDER BY id) = 1),
u AS (SELECT *, {S['url_clean'].split('SELECT id, ')[1].split(' AS url')[0].replace('article_url', "coalesce(article_url, '')")} AS url FROM h)
SELECT id FROM u QUALIFY row_number() OVER (PARTITION BY company_symbol, nullif(url, ''), CASE WHEN url = '' THEN id END ORDER BY id) = 1"""

Q["title_jaccard_pairs"] = lambda spark, d: dedupe.headline_pairs(news(spark, d)).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))
_GAPS = f"regexp_replace(lower({_FCLEAN('article_title')}), '{T.NOT_WORD_OR_WS}', ' ', 'g')"
_WORDS = f"list_sort(list_distinct(list_filter(string_split({sql_squeeze(sql_strip(_GAPS))}, ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))))"
S["title_jaccard_pairs"] = f"""WITH w AS (SELECT id, company_symbol AS g, {_WORDS} AS words FROM news_cache), c AS (SELECT g, words, min(id) AS c FROM w WHERE len(words) > 0 GROUP BY g, words)
SELECT a.c AS id_a, b.c AS id_b, round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))::DOUBLE, 6) AS similarity
FROM c a JOIN c b ON a.g IS NOT DISTINCT FROM b.g AND a.c < b.c
WHERE len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))::DOUBLE > 0.85"""


def _sequence_sql(rows: str) -> str:
    """The ids that stay, article by article in each company's order, as a recursion whose state is the lists of what is known. rows gives id, g, digest, url, words and score."""
    return f"""RECURSIVE sq AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS rn FROM ({rows})),
fold AS (SELECT g, 0::BIGINT AS rn, []::VARCHAR[] AS hashes, []::VARCHAR[] AS urls, []::STRUCT(words VARCHAR[], slot INT)[] AS titles, []::STRUCT(id BIGINT, score DOUBLE)[] AS slots FROM (SELECT DISTINCT g FROM sq)
  UNION ALL
  SELECT g, next, CASE WHEN act = 'keep' AND digest <> '' THEN list_append(hashes, digest) ELSE hashes END, CASE WHEN act = 'keep' AND url <> '' THEN list_append(urls, url) ELSE urls END,
    CASE WHEN len(words) = 0 OR act = 'drop' THEN titles WHEN act = 'keep' THEN list_append(titles, {{'words': words, 'slot': (len(slots) + 1)::INT}})
      WHEN list_contains(list_transform(titles, lambda t: t.words), words) THEN list_transform(titles, lambda t: CASE WHEN t.words = words THEN {{'words': t.words, 'slot': titles[m].slot}} ELSE t END)
      ELSE list_append(titles, {{'words': words, 'slot': titles[m].slot}}) END,
    CASE act WHEN 'keep' THEN list_append(slots, {{'id': id, 'score': score}}) WHEN 'drop' THEN slots
      ELSE list_transform(slots, lambda x, i: CASE WHEN i = titles[m].slot THEN {{'id': id, 'score': score}} ELSE x END) END
  FROM (SELECT *, CASE WHEN list_contains(hashes, digest) OR list_contains(urls, url) THEN 'drop' WHEN m IS NULL THEN 'keep' WHEN score > slots[titles[m].slot].score THEN 'replace' ELSE 'drop' END AS act
    FROM (SELECT fold.*, sq.id::BIGINT AS id, digest, url, words, score::DOUBLE AS score, sq.rn AS next, CASE WHEN len(words) > 0 THEN list_position(list_transform(titles, lambda t:
        len(list_intersect(t.words, words)) / (len(t.words) + len(words) - len(list_intersect(t.words, words)))::DOUBLE > 0.85), true) END AS m
      FROM fold JOIN sq ON sq.g IS NOT DISTINCT FROM fold.g AND sq.rn = fold.rn + 1) AS one) AS two),
stay AS (SELECT unnest(list_transform(slots, lambda x: x.id))::INT AS id FROM fold JOIN (SELECT g, max(rn) AS rn FROM sq GROUP BY g) AS l ON l.g IS NOT DISTINCT FROM fold.g AND l.rn = fold.rn) """


_CLEAN_URL = S["url_clean"].split("SELECT id, ")[1].split(" AS url")[0].replace("article_url", "coalesce(article_url, '')")
Q["dedupe_fuzzy_greedy"] = lambda spark, d: dedupe.greedy(news(spark, d)).select(F.col("id").cast("int").alias("id"))
S["dedupe_fuzzy_greedy"] = "WITH " + _sequence_sql(f"SELECT id, company_symbol AS g, NULL::VARCHAR AS digest, NULL::VARCHAR AS url, {_WORDS} AS words, coalesce(CASE WHEN isnan(relevance_score) THEN 0 ELSE relevance_score END, 0) AS score FROM news_cache") + "SELECT id FROM stay"
Q["dedupe_sequence"] = lambda spark, d: dedupe.articles(news(spark, d), score="relevance_score").select(F.col("id").cast("int").alias("id"))
S["dedupe_sequence"] = "WITH " + _sequence_sql(f"SELECT id, company_symbol AS g, {_HASH} AS digest, nullif({_CLEAN_URL}, '') AS url, {_WORDS} AS words, coalesce(CASE WHEN isnan(relevance_score) THEN 0 ELSE relevance_score END, 0) AS score FROM news_cache") + "SELECT id FROM stay"

MAX_DAYS = 30


def filter_pipeline(spark, d, threshold: float = 0.05, most: int = 50, version: int = 1):
    """Scored (version 1 with the boost of the search terms), thresholded, repeats dropped in one sequence, not older than MAX_DAYS by the published instant, best and newest first, at most `most` of each company.

    A null or blank published date is older than any, an unreadable one counts as now.
    """
    rows = news(spark, d).join(companies(spark, d).select(F.col("symbol").alias("company_symbol"), "company_name"), "company_symbol")
    rows = with_source_zone(rows, read(spark, d, "news_sources"))
    rows = scores.prepared(dedupe.cleaned(rows, "article_title", "article_content"), F.col("_title"), F.col("_description"), F.col("company_name"), F.col("company_symbol"))
    if version == 1:
        raw = F.lower(F.concat(F.coalesce("article_title", F.lit("")), F.lit(" "), F.coalesce("article_content", F.lit(""))))
        score = scores.boosted(scores.relevance(), raw, T.search_terms(F.col("company_symbol"), F.col("company_name")))
    else:
        score = scores.weighted_relevance()
    # what the sequence compares is computed here once, so that no text is carried on; behind a generator, so that the filter doesn't compute the score a second time
    keys = dedupe.sequence_keys(F.col("_title"), F.col("_description"), F.col("article_url"))
    rows = rows.select("id", "company_symbol", "published_date", "_zone", "_day", *keys, F.inline(F.array(F.struct(F.round(score, 6).alias("score"))))).where(F.col("score") >= threshold)
    rows = materialise(rows, "scored")
    kept = rows.join(dedupe.in_sequence(rows, "id", "company_symbol", F.col("digest"), F.col("url"), F.col("words"), F.col("score")), "id", "left_semi")
    since = (F.lit(AS_OF).cast("timestamp") - F.expr(f"INTERVAL {MAX_DAYS} DAYS"))
    at = F.coalesce(F.timestamp_micros(parse_column(F.col("published_date"), F.col("_zone"), F.col("_day"))), F.lit(AS_OF).cast("timestamp"))
    dated = kept.where(F.trim("published_date") != "").select("*", F.inline(F.array(F.struct(at.alias("at"))))).where(F.col("at") >= since)
    return collect.capped(dated, most, order=[F.desc("score"), F.desc("at"), F.col("id")]).select("id", "company_symbol", "score", "rank")


def _pipeline_sql() -> str:
    return _sequence_sql(f"SELECT k.id, company_symbol AS g, {_HASH} AS digest, nullif({_CLEAN_URL}, '') AS url, {_WORDS} AS words, score FROM k") + f""", pub AS ({PUBLISHED})
SELECT id, company_symbol, score, row_number() OVER (PARTITION BY company_symbol ORDER BY score DESC, coalesce(utc_micros, epoch_us(TIMESTAMP '{AS_OF}')) DESC, id) AS rank
FROM k JOIN stay USING (id) JOIN pub USING (id) WHERE trim(published_date) <> '' AND coalesce(utc_micros, epoch_us(TIMESTAMP '{AS_OF}')) >= epoch_us(TIMESTAMP '{AS_OF}' - INTERVAL {MAX_DAYS} DAYS) QUALIFY rank <= 50"""


_CLEANED_CACHE = f"(SELECT * REPLACE ({_FCLEAN('article_title')} AS article_title, {_FCLEAN('article_content')} AS article_content) FROM news_cache) AS news_cache"
_scored_sql = lambda name: S[name].replace("FROM news_cache JOIN companies", f"FROM {_CLEANED_CACHE} JOIN companies")
_BOOST = _CS["search_terms"].split("SELECT symbol, string_agg")[0].removeprefix(WITH)
Q["filter_pipeline_v1"] = filter_pipeline
S["filter_pipeline_v1"] = f"""WITH RECURSIVE {COMPANIES}{_BOOST}, sc AS ({_scored_sql('relevance_v1')}),
b AS (SELECT DISTINCT n.id FROM (SELECT id, company_symbol, {_TEXT} AS txt FROM news_cache) n JOIN f ON f.symbol = n.company_symbol AND contains(n.txt, lower(f.t))),
s AS (SELECT sc.id, round(CASE WHEN b.id IS NULL THEN sc.score ELSE least(1.0, sc.score + 0.25) END, 6) AS score FROM sc LEFT JOIN b USING (id)),
k AS (SELECT n.*, s.score FROM news_cache n JOIN s USING (id) WHERE s.score >= 0.05), """ + _pipeline_sql().removeprefix("RECURSIVE ")
Q["filter_pipeline_v0"] = lambda spark, d: filter_pipeline(spark, d, 0.2, version=0)
S["filter_pipeline_v0"] = f"WITH RECURSIVE {COMPANIES}, sc AS ({_scored_sql('relevance_v0')}), k AS (SELECT n.*, sc.score FROM news_cache n JOIN sc USING (id) WHERE sc.score >= 0.2), " + _pipeline_sql().removeprefix("RECURSIVE ")

Q["filter_stats"] = lambda spark, d: scores.filter_stats(spark)
S["filter_stats"] = f"""SELECT 1 AS version, 0.05::DOUBLE AS relevance_threshold, 50 AS max_articles, 30 AS max_days, 0 AS total_keywords, {len(T.STOP_WORDS)} AS stop_words
UNION ALL SELECT 0, 0.2, 50, 7, {sum(map(len, scores.KEYWORDS.values()))}, {len(T.STOP_WORDS)}"""

# --- preparation -------------------------------------------------------------------------------------------------------
Q["text_clean"] = lambda spark, d: news(spark, d).select("id", T.clean_for_model(F.col("article_content")).alias("content"))


def _CLEAN(c):
    bare = sql_squeeze(f"regexp_replace({c}, '<[^>]+>', '', 'g')")
    return sql_strip(rf"regexp_replace(regexp_replace({bare}, '₹{WS}*([0-9]+)', 'INR \1', 'g'), '\${WS}*([0-9]+)', 'USD \1', 'g')")


S["text_clean"] = f"SELECT id, {_CLEAN('article_content')} AS content FROM news_cache"

Q["training_text_clean"] = lambda spark, d: read(spark, d, "documents").select("doc_id", T.clean_for_training(F.col("text")).alias("text"))
S["training_text_clean"] = "SELECT doc_id, " + sql_strip(f"""regexp_replace({sql_squeeze("coalesce(text, '')")}, '<[^>]+>', '', 'g')""") + " AS text FROM documents"

Q["filter_text_clean"] = lambda spark, d: news(spark, d).select("id", T.clean_for_filter(F.col("article_title")).alias("title"))
Q["html_clean"] = lambda spark, d: news(spark, d).select("id", T.html_text(F.col("article_content")).alias("text"))

Q["sentences"] = lambda spark, d: read(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))
S["sentences"] = rf"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: length(s) > 10))::INT AS n
FROM documents WHERE text IS NOT NULL"""


def _articles(spark, d):
    rows = news(spark, d).select(
        "id", "company_symbol", F.col("article_title").alias("title"), F.col("article_content").alias("description"), F.col("article_url").alias("link"), F.col("published_date").alias("published"), F.col("source_name").alias("source"))
    return chunks.prepared(rows)


Q["articles_prepared"] = lambda spark, d: _articles(spark, d).select("id", "source", "full_text")
_FULL = sql_strip("CASE WHEN t <> '' THEN t || '. ' ELSE '' END || c")
S["articles_prepared"] = f"""WITH p AS (SELECT id, coalesce(source_name, 'unknown') AS source, {_CLEAN("coalesce(article_title, '')")} AS t, {_CLEAN("coalesce(article_content, '')")} AS c FROM news_cache),
f AS (SELECT id, source, {_FULL} AS full_text FROM p) SELECT * FROM f WHERE full_text <> ''"""


def _chunks(spark, d, cap: int | None = 15):
    rows = _articles(spark, d)
    if cap:
        rows = collect.capped(rows, cap).drop("rank")
    return chunks.chunks(rows.withColumn("ord", F.col("id")), ["company_symbol", "ord"])


Q["chunks"] = lambda spark, d: _chunks(spark, d, None).select("ord", "chunk_id", "total_chunks", "text")


def _chunks_sql(prepared: str) -> str:
    """Common tables that end with cut (id, chunk_id, total_chunks, text): the chunks of prepared (id, full_text), sentence by sentence."""
    return rf"""a AS ({prepared}), l AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(full_text, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: length(x) > 10) AS ss
  FROM a WHERE length(full_text) / 4.0 > 400),
f AS (SELECT id, 0 AS k, '' AS cur, 0.0::DOUBLE AS tok, []::VARCHAR[] AS done FROM l
  UNION ALL SELECT id, k + 1, CASE WHEN filled THEN opened WHEN cur <> '' THEN cur || ' ' || x ELSE x END, CASE WHEN filled THEN length(opened) / 4.0::DOUBLE ELSE tok + length(x) / 4.0::DOUBLE END,
    CASE WHEN filled THEN list_append(done, {sql_strip('cur')}) ELSE done END
  FROM (SELECT *, CASE WHEN len(string_split(cur, ' ')) > 12 THEN array_to_string(string_split(cur, ' ')[-12:], ' ') || ' ' || x ELSE x END AS opened, tok + length(x) / 4.0::DOUBLE > 400 AND cur <> '' AS filled
    FROM (SELECT f.*, l.ss[f.k + 1] AS x FROM f JOIN l ON l.id = f.id AND f.k < len(l.ss)) AS u) AS v),
z AS (SELECT f.id, CASE WHEN {sql_strip('cur')} <> '' THEN list_append(done, {sql_strip('cur')}) ELSE done END AS texts FROM f JOIN l ON l.id = f.id AND f.k = len(l.ss)
  UNION ALL SELECT id, [full_text] FROM a WHERE length(full_text) / 4.0 <= 400),
cut AS (SELECT id, unnest(texts) AS text, generate_subscripts(texts, 1) - 1 AS chunk_id, len(texts) AS total_chunks FROM z) """


S["chunks"] = f"WITH RECURSIVE {_chunks_sql(S['articles_prepared'])} SELECT id AS ord, chunk_id, total_chunks, text FROM cut"
Q["chunk_counts"] = lambda spark, d: chunks.counts(_articles(spark, d))
S["chunk_counts"] = f"""WITH RECURSIVE {_chunks_sql(S['articles_prepared'])} SELECT length(full_text) / 4.0 <= 400 AS single, count(*) AS articles, count(*) FILTER (WHERE len(texts) >= 1) AS with_chunks,
  count(*) FILTER (WHERE len(texts) = 1) AS one_chunk, sum(len(texts))::BIGINT AS chunks FROM a JOIN z USING (id) GROUP BY 1"""

# --- sentiment ---------------------------------------------------------------------------------------------------------
Q["softmax_label"] = lambda spark, d: sentiment.with_softmax(read(spark, d, "embeddings"), F.slice("embedding", 1, 3).cast("array<double>"), "p").select(
    "vec_id", sentiment.label_of(F.col("p")).alias("sentiment"), *[F.round(F.get("p", F.lit(k)), 6).alias(x) for k, x in enumerate(sentiment.LABELS)])
S["softmax_label"] = """WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
m AS (SELECT *, greatest(a, b, c) AS t FROM l), e AS (SELECT vec_id, a, b, c, t, exp(a - t) AS x, exp(b - t) AS y, exp(c - t) AS z FROM m)
SELECT vec_id, CASE WHEN a = t THEN 'positive' WHEN b = t THEN 'neutral' ELSE 'negative' END AS sentiment, round(x / (x + y + z), 6) AS positive, round(y / (x + y + z), 6) AS neutral,
  round(z / (x + y + z), 6) AS negative FROM e"""

_COUNT = lambda cues: " + ".join(f"((length(low) - length(replace(low, '{c}', ''))) / {len(c)})::INT" for c in cues)
_SCORED = f"""WITH l AS (SELECT *, lower(text) AS low FROM documents WHERE {sql_strip('text')} <> ''),
g AS (SELECT *, ({_COUNT(sentiment.POSITIVE_CUES)})::DOUBLE AS a, 1.0::DOUBLE AS b, ({_COUNT(sentiment.NEGATIVE_CUES)})::DOUBLE AS c FROM l),
m AS (SELECT *, greatest(a, b, c) AS t FROM g), e AS (SELECT *, exp(a - t) AS x, exp(b - t) AS y, exp(c - t) AS z FROM m),
p AS (SELECT *, x / (x + y + z) AS positive, z / (x + y + z) AS negative, CASE WHEN a = t THEN 'positive' WHEN b = t THEN 'neutral' ELSE 'negative' END AS sentiment FROM e) """
Q["lexicon_labels"] = lambda spark, d: sentiment.scored(read(spark, d, "documents")).select("doc_id", "sentiment", F.round("scores.positive", 6).alias("positive"), F.round("scores.negative", 6).alias("negative"))
S["lexicon_labels"] = _SCORED + "SELECT doc_id, sentiment, round(positive, 6) AS positive, round(negative, 6) AS negative FROM p"

Q["model_labels"] = lambda spark, d: sentiment.scored_by_model(read(spark, d, "documents").select("doc_id", "text"), sentiment.hashed_model).select(
    "doc_id", "sentiment", *[F.round(f"scores.{x}", 6).alias(x) for x in sentiment.LABELS])
_VECTOR = lambda k: f"coalesce(list_avg(list_transform(ids, lambda x: ((x // {7919**k}) % 1009) / 1009.0::DOUBLE)), 0) * 10"
S["model_labels"] = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+')[1:512] AS ws FROM documents WHERE {sql_strip('text')} <> ''),
i AS (SELECT doc_id, list_transform(ws, lambda x: ('0x' || md5(x)[1:8])::BIGINT) AS ids FROM w), g AS (SELECT doc_id, {_VECTOR(0)} AS a, {_VECTOR(1)} AS b, {_VECTOR(2)} AS c FROM i),
m AS (SELECT *, greatest(a, b, c) AS t FROM g), e AS (SELECT *, exp(a - t) AS x, exp(b - t) AS y, exp(c - t) AS z FROM m)
SELECT doc_id, CASE WHEN a = t THEN 'positive' WHEN b = t THEN 'neutral' ELSE 'negative' END AS sentiment, round(x / (x + y + z), 6) AS positive, round(y / (x + y + z), 6) AS neutral, round(z / (x + y + z), 6) AS negative FROM e"""

Q["verdict_by_company"] = lambda spark, d: verdict.shares(verdict.summary(sentiment.scored(read(spark, d, "documents")), ["company_symbol"]))
S["verdict_by_company"] = _SCORED + """, v AS (SELECT company_symbol, count(*) AS chunk_count, count(*) FILTER (WHERE sentiment = 'positive') AS bullish, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  count(*) FILTER (WHERE sentiment = 'negative') AS bearish, avg(positive) - avg(negative) AS s FROM p GROUP BY company_symbol),
w AS (SELECT company_symbol, chunk_count, bullish, neutral, bearish, round(s, 4) AS overall_score, CASE WHEN s >= 0.2 THEN 'bullish' WHEN s <= -0.2 THEN 'bearish' ELSE 'neutral' END AS sentiment_label,
  round(least(abs(s) + 0.3, 1.0), 4) AS confidence FROM v)
SELECT *, round(bullish / chunk_count * 100, 1) AS bullish_pct, round(neutral / chunk_count * 100, 1) AS neutral_pct, round(bearish / chunk_count * 100, 1) AS bearish_pct,
  CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS confidence_band FROM w"""


def predicted(spark, d, symbols: list[str] | None = None):
    """Relevant articles of every company (or of symbols), the first 15, cleaned, chunked, scored, and joined with their predictions."""
    rows = news(spark, d) if symbols is None else news(spark, d).where(F.col("company_symbol").isin(symbols))
    rows = collect.first_per_title_and_link(collect.relevant(rows, companies(spark, d)))
    rows = collect.capped(rows, 15).select(
        "company_symbol", F.col("id").alias("ord"), F.col("article_title").alias("title"), F.col("article_content").alias("description"), F.col("article_url").alias("link"), F.col("published_date").alias("published"), F.col("source_name").alias("source"))
    cut = chunks.chunks(chunks.prepared(rows), ["company_symbol", "ord"])
    return sentiment.scored(cut)


_KEPT = f"""SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY company_symbol ORDER BY id) AS place FROM (SELECT n.* FROM news_cache n WHERE id IN (SELECT id FROM ({S['relevant_articles']}) AS r)
    QUALIFY row_number() OVER (PARTITION BY company_symbol, lower(article_title), article_url ORDER BY id) = 1) AS n) AS m WHERE place <= 15"""
_FLAG = f"""WITH RECURSIVE kept AS ({_KEPT}), {_chunks_sql(S['articles_prepared'].replace("FROM news_cache)", "FROM kept)"))}, texts AS (SELECT cut.*, company_symbol FROM cut JOIN kept USING (id)), """
_FLAG += _SCORED.removeprefix("WITH ").replace("FROM documents", "FROM texts").replace("l AS (SELECT *, lower(text) AS low", "lo AS (SELECT *, lower(text) AS low").replace("AS c FROM l)", "AS c FROM lo)").replace("g AS (SELECT *, (", "gc AS (SELECT *, (").replace("FROM g)", "FROM gc)")
S["verdict_flagship"] = _FLAG + S["verdict_by_company"].removeprefix(_SCORED).split("\nSELECT *")[0] + " SELECT * FROM w"
Q["verdict_flagship"] = lambda spark, d: verdict.summary(predicted(spark, d), ["company_symbol"])
Q["verdict_documents"] = lambda spark, d: verdict.documents(predicted(spark, d), companies(spark, d))


# --- what an interface shows -------------------------------------------------------------------------------------------
Q["display_fields"] = lambda spark, d: Q["verdict_by_company"](spark, d).select(
    "company_symbol", display.percent(F.col("bullish"), F.col("chunk_count")).alias("bullish_pct"), display.band(F.col("confidence")).alias("band"), display.label_text(F.upper("sentiment_label")).alias("label"))
S["display_fields"] = f"""SELECT company_symbol, bullish_pct, CASE WHEN confidence > 0.7 THEN 'green' WHEN confidence > 0.4 THEN 'yellow' ELSE 'red' END AS band,
  CASE sentiment_label WHEN 'bullish' THEN 'Bullish' WHEN 'bearish' THEN 'Bearish' ELSE 'Neutral' END AS label FROM ({S['verdict_by_company']})"""

Q["display_days"] = lambda spark, d: read(spark, d, "events").select("event_id", display.day(F.col("ts").cast("timestamp")).alias("day"))
S["display_days"] = "SELECT event_id, strftime(ts, '%b %-d, %Y') AS day FROM events"

Q["error_messages"] = lambda spark, d: query_list(spark, tuple(display.ERRORS)).select(F.col("query").alias("event_type")).union(read(spark, d, "events").select("event_type").distinct()).select("event_type", display.error_message(F.col("event_type")).alias("message"))
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
S["error_messages"] = f"SELECT DISTINCT event_type, '{display.OTHER_ERROR}' AS message FROM events UNION ALL SELECT * FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in display.ERRORS.items())}) AS e(event_type, message)"

Q["search_prompts"] = lambda spark, d: companies(spark, d).select("symbol", display.prompt(F.col("company_name"), F.col("symbol"), ["a.example", "b.example"]).alias("prompt"))
S["search_prompts"] = WITH + f"""SELECT symbol, replace(replace('{display.PROMPT.replace("{SOURCES}", "a.example, b.example")}', '{{NAME}}', company_name), '{{SYMBOL}}', symbol) AS prompt FROM companies"""

Q["normalised_keys"] = lambda spark, d: news(spark, d).select("id", display.cache_key(F.col("article_url"), F.col("article_title"), F.col("article_content")).alias("key"))
S["normalised_keys"] = "SELECT id, sha256(coalesce(article_url, '') || coalesce(article_title, '') || substr(coalesce(article_content, ''), 1, 1000)) AS key FROM news_cache"

Q["url_encode"] = lambda spark, d: companies(spark, d).select("symbol", F.replace(F.url_encode("company_name"), F.lit("+"), F.lit("%20")).alias("encoded"))
S["url_encode"] = WITH + "SELECT symbol, url_encode(company_name) AS encoded FROM companies"

Q["inference_batches"] = lambda spark, d: display.batches(news(spark, d), [F.col("id")], "company_symbol").groupBy("company_symbol", "batch").agg(F.count(F.lit(1)).alias("n"))
S["inference_batches"] = """SELECT company_symbol, batch, count(*) AS n FROM (SELECT company_symbol, floor((row_number() OVER (PARTITION BY company_symbol ORDER BY id) - 1) / 16)::INT AS batch FROM news_cache)
GROUP BY company_symbol, batch"""

Q["collection_envelope"] = lambda spark, d: display.envelope(Q["cache_or_fetch"](spark, d))
S["collection_envelope"] = f"SELECT company_symbol, count(*) AS article_count, true AS success, count(*) FILTER (WHERE from_cache) AS cached FROM ({S['cache_or_fetch']}) GROUP BY company_symbol"


def _joined(spark, d):
    """Chunks joined with predictions of other rows by their keys, of repeated predictions the last."""
    docs = read(spark, d, "documents").select("doc_id", "company_symbol", "text")
    first = sentiment.scored(docs).select("doc_id", "sentiment", F.lit(1).alias("ord"))
    second = first.where("doc_id % 3 = 0").select("doc_id", F.lit("neutral").alias("sentiment"), F.lit(2).alias("ord"))
    return verdict.with_predictions(docs.select("doc_id", "company_symbol"), first.union(second), ["doc_id"]).select("doc_id", "company_symbol", "sentiment")


Q["chunk_prediction_join"] = _joined
S["chunk_prediction_join"] = _SCORED + "SELECT doc_id, company_symbol, CASE WHEN doc_id % 3 = 0 THEN 'neutral' ELSE sentiment END AS sentiment FROM p"
