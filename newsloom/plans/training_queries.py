"""Queries of data sets and evaluation, and of the streams run to their end."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from newsloom.operators import classifier, evaluation as ev, sentiment
from newsloom.plans.shared import read, sql_strip
from newsloom.session import shared_dir
from newsloom.streaming import news as streams

Q, S = {}, {}

Q["export_news"] = lambda spark, d: ev.export_news(read(spark, d, "news_cache"), 0.5)
S["export_news"] = f"""WITH e AS (SELECT id, CASE WHEN {sql_strip("coalesce(article_content, '')")} <> '' THEN article_title || '. ' || article_content ELSE article_title END AS text, source_name AS source,
  published_date, article_url AS url, relevance_score, company_symbol AS symbol FROM news_cache WHERE relevance_score >= 0.5 AND NOT isnan(relevance_score) AND {sql_strip('article_title')} <> '')
SELECT * FROM e WHERE {sql_strip('text')} <> ''"""

Q["export_summary"] = lambda spark, d: Q["export_news"](spark, d).agg(
    F.count(F.lit(1)).alias("n"), F.min("published_date").alias("first_date"), F.max("published_date").alias("last_date"), F.round(F.avg("relevance_score"), 3).alias("mean_relevance"), F.count_distinct("symbol").alias("n_symbols"))
S["export_summary"] = f"""SELECT count(*) AS n, min(published_date) AS first_date, max(published_date) AS last_date, round(avg(relevance_score), 3) AS mean_relevance, count(DISTINCT symbol) AS n_symbols
FROM ({S['export_news']})"""


def _export_csv(spark, d):
    """Writes the export as CSV and reads it again, whole texts with quotes and line ends included."""
    path = shared_dir(spark, "export")
    rows = Q["export_news"](spark, d).select("text", "source", "published_date", "url", "relevance_score", "symbol")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("relevance_score"), 4).alias("relevance"))


Q["export_csv_roundtrip"] = _export_csv
S["export_csv_roundtrip"] = f"SELECT symbol, count(*) AS n, round(sum(relevance_score), 4) AS relevance FROM ({S['export_news']}) GROUP BY symbol"

_LABEL = lambda c: f"CASE WHEN lower({sql_strip(c)}) IN ('pos', 'positive') THEN 'positive' WHEN lower({sql_strip(c)}) IN ('neu', 'neutral') THEN 'neutral' WHEN lower({sql_strip(c)}) IN ('neg', 'negative') THEN 'negative' END"
_gold = lambda spark, d: read(spark, d, "gold_labels").select("doc_id", ev.clean_label(F.col("manual_label")).alias("gold"), ev.clean_label(F.col("finbert_label")).alias("model"))
_GOLD = f"gold AS (SELECT doc_id, {_LABEL('manual_label')} AS gold, {_LABEL('finbert_label')} AS model FROM gold_labels)"

Q["label_counts"] = lambda spark, d: _gold(spark, d).groupBy("gold", "model").agg(F.count(F.lit(1)).alias("n"))
S["label_counts"] = f"WITH {_GOLD} SELECT gold, model, count(*) AS n FROM gold GROUP BY gold, model"

Q["label_encode"] = lambda spark, d: _gold(spark, d).where("gold is not null").select("doc_id", "gold", ev.encode_label(F.col("gold")).alias("code"), ev.decode_label(ev.encode_label(F.col("gold"))).alias("decoded"))
S["label_encode"] = f"WITH {_GOLD} SELECT doc_id, gold, CASE gold WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS code, gold AS decoded FROM gold WHERE gold IS NOT NULL"

_both = lambda spark, d: _gold(spark, d).where("gold is not null and model is not null")
_BOTH = f"{_GOLD}, r AS (SELECT * FROM gold WHERE gold IS NOT NULL AND model IS NOT NULL)"
Q["confusion_matrix"] = lambda spark, d: ev.confusion(_both(spark, d), "gold", "model")
_CM = """m AS (SELECT a AS actual, count(gold) FILTER (WHERE model = 'positive') AS positive, count(gold) FILTER (WHERE model = 'neutral') AS neutral, count(gold) FILTER (WHERE model = 'negative') AS negative
  FROM (VALUES ('positive'), ('neutral'), ('negative')) AS l(a) LEFT JOIN r ON gold = a GROUP BY a)"""
S["confusion_matrix"] = f"WITH {_BOTH}, {_CM} SELECT * FROM m"

_REPORT = """p AS (SELECT label, count(*) FILTER (WHERE gold = label AND model = label) AS tp, count(*) FILTER (WHERE model = label) AS predicted, count(*) FILTER (WHERE gold = label) AS support
  FROM r, (VALUES ('positive'), ('neutral'), ('negative')) AS l(label) GROUP BY label),
q AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support, tp FROM p),
f AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support, tp FROM q)"""
Q["class_report"] = lambda spark, d: ev.report(ev.confusion(_both(spark, d), "gold", "model")).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
S["class_report"] = f"WITH {_BOTH}, {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f"

_avg = lambda spark, d, a, p: ev.averages(ev.report(ev.confusion(_both(spark, d), a, p)))
Q["class_averages"] = lambda spark, d: _avg(spark, d, "gold", "model").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")], "support")
S["class_averages"] = f"""WITH {_BOTH}, {_REPORT} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM f"""


def _delta(spark, d):
    docs = sentiment.scored(read(spark, d, "documents")).select("doc_id", F.col("sentiment").alias("lexicon"))
    return ev.compared(_both(spark, d).join(docs, "doc_id"), "gold", "lexicon", "model").select(*[F.round(c, 6).alias(c) for c in ("baseline_accuracy", "tuned_accuracy", "accuracy_delta")])


Q["baseline_delta"] = _delta


def _gold_evaluation(spark, d):
    """Scored documents against their gold labels, as a report."""
    docs = sentiment.scored(read(spark, d, "documents")).select("doc_id", F.col("sentiment").alias("lexicon"))
    rows = _both(spark, d).select("doc_id", "gold").join(docs, "doc_id")
    return ev.report(ev.confusion(rows, "gold", "lexicon")).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


Q["gold_evaluation"] = _gold_evaluation


def _trained(spark, d):
    """A classifier fitted on four fifths of the gold labels, saved, loaded, and evaluated on the rest."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    rows = _gold(spark, d).where("gold is not null").groupBy("doc_id").agg(F.min("gold").alias("label")).join(docs.where("text is not null"), "doc_id")
    split = ev.stratified(rows, "doc_id", "label", {"train": 0.8, "test": 0.2})
    path = shared_dir(spark, "model")
    classifier.train(split.where("part = 'train'")).write().overwrite().save(path)
    tested = classifier.predict(PipelineModel.load(path), split.where("part = 'test'"))
    return ev.confusion(tested, "label", "sentiment")


Q["trained_classifier"] = _trained
from newsloom.plans.news_queries import S as _NS  # noqa: E402

S["gold_evaluation"] = f"""WITH {_GOLD}, x AS ({_NS['lexicon_labels']}), r AS (SELECT gold.doc_id, gold, x.sentiment AS model FROM gold JOIN x USING (doc_id) WHERE gold IS NOT NULL AND gold.model IS NOT NULL),
{_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f"""
S["baseline_delta"] = f"""WITH {_BOTH}, x AS ({_NS['lexicon_labels']}), j AS (SELECT r.*, x.sentiment AS lexicon FROM r JOIN x USING (doc_id))
SELECT round(avg((gold = lexicon)::INT), 6) AS baseline_accuracy, round(avg((gold = model)::INT), 6) AS tuned_accuracy, round(avg((gold = model)::INT) - avg((gold = lexicon)::INT), 6) AS accuracy_delta FROM j"""


def _split(parts):
    return lambda spark, d: ev.stratified(read(spark, d, "gold_labels").dropDuplicates(["doc_id"]).select("doc_id").join(read(spark, d, "documents").select("doc_id", "doc_kind"), "doc_id"), "doc_id", "doc_kind", parts)


def _split_sql(case):
    return f"""WITH k AS (SELECT DISTINCT g.doc_id, doc_kind, ('0x' || md5('42:' || g.doc_id)[:12])::BIGINT AS o FROM gold_labels g JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY o % 256, o, doc_id) / count(*) OVER (PARTITION BY doc_kind)::DOUBLE AS place FROM k)
SELECT doc_id, doc_kind, {case} AS part FROM r"""


Q["stratified_split"] = _split({"train": 0.8, "val": 0.2})
S["stratified_split"] = _split_sql("CASE WHEN place <= 0.8 + 1e-12 THEN 'train' ELSE 'val' END")
Q["three_way_split"] = _split({"train": 0.81, "val": 0.09, "test": 0.10})
S["three_way_split"] = _split_sql("CASE WHEN place <= 0.81 + 1e-12 THEN 'train' WHEN place <= 0.9 + 1e-12 THEN 'val' ELSE 'test' END")

Q["synthetic_generate"] = lambda spark, d: ev.generate(spark, 500)


def _pick(size, of):
    return f"(('0x' || md5('42:{of}:' || n)[:8])::BIGINT % {size})"


def _choose(items, of):
    return f"[{', '.join(repr(x) for x in items)}][{_pick(len(items), of)} + 1]"


_TEMPLATE = "CASE " + " ".join(f"WHEN n % 3 = {k} THEN {_choose(v, 'template')}" for k, v in enumerate(ev.TEMPLATES.values())) + " END"
for _name, _value in (("COMPANY", _choose(ev.NAMES, "company")), ("TARGET", _choose(ev.TARGETS, "target"))):
    _TEMPLATE = f"replace({_TEMPLATE}, '{{{_name}}}', {_value})"
_RANGE = lambda k: f"({_pick(ev.RANGES[k][1] - ev.RANGES[k][0] + 1, 'x')} + {ev.RANGES[k][0]})"
_PERCENT = f"CASE WHEN regexp_matches(t, '{'|'.join(ev.RISING)}') THEN {_RANGE(0)} WHEN regexp_matches(t, '{'|'.join(ev.FALLING)}') THEN {_RANGE(1)} ELSE {_RANGE(2)} END"
_FILLED = "t"
for _name, _value in (("X", f"({_PERCENT})::VARCHAR"), ("AMT", f"({_pick(4901, 'amount')} + 100)::VARCHAR"), ("PERIOD", f"({_pick(4, 'period')} + 1)::VARCHAR")):
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', {_value})"
S["synthetic_generate"] = f"SELECT n, {_FILLED} AS text, ['positive', 'neutral', 'negative'][n % 3 + 1] AS label FROM (SELECT n, {_TEMPLATE} AS t FROM range(1500) AS r(n)) AS u"


def _pseudo(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return ev.pseudo_labelled(docs, sentiment.scored(docs), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


Q["pseudo_label"] = _pseudo
S["pseudo_label"] = f"SELECT sentiment AS label, count(*) AS n FROM ({_NS['lexicon_labels']}) GROUP BY sentiment"


def _combined(spark, d):
    """Generated and pseudo-labelled texts together, shuffled by key, by label and part."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    real = ev.pseudo_labelled(docs, sentiment.scored(docs), "doc_id").select((F.col("doc_id") + 1_000_000_000).alias("n"), "text", "label")
    both = ev.generate(spark, 500).unionByName(real)
    return ev.stratified(both, "n", "label", {"train": 0.8, "val": 0.2}).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


Q["combined_dataset"] = _combined
S["combined_dataset"] = f"""WITH b AS (SELECT label FROM ({S['synthetic_generate']}) UNION ALL SELECT sentiment FROM ({_NS['lexicon_labels']})), c AS (SELECT label, count(*) AS k FROM b GROUP BY label)
SELECT label, 'train' AS part, floor(k * 0.8 + 1e-9)::BIGINT AS n FROM c UNION ALL SELECT label, 'val', k - floor(k * 0.8 + 1e-9)::BIGINT FROM c"""


def _json_report(spark, d):
    path = shared_dir(spark, "report")
    Q["class_report"](spark, d).select(F.to_json(F.struct("label", "precision", "recall", "f1", "support")).alias("value")).coalesce(1).write.text(path)
    return spark.read.schema("label string, precision double, recall double, f1 double, support bigint").json(path)


Q["json_report"] = _json_report
S["json_report"] = S["class_report"]


def _stream_ingest(spark, d):
    """Events as articles through the ingest stream until all is read: the first of each link."""
    path, check, drop = (shared_dir(spark, x) for x in ("stream", "stream-check", "stream-in"))
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://e.example/"), F.col("event_id").cast("string")).alias("link"), F.col("event_type").alias("company_symbol"))
    rows.union(rows.where("company_symbol = 'click'")).write.parquet(drop)
    streams.to_table(streams.ingest(spark, drop, rows.schema, late="60 days"), path, check).awaitTermination()
    return spark.read.parquet(path).groupBy("company_symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("link").alias("links"))


Q["stream_ingest"] = _stream_ingest
S["stream_ingest"] = "SELECT event_type AS company_symbol, count(*) AS n, count(*) AS links FROM events GROUP BY event_type"


def _stream_replace(spark, d):
    """Two collections through the stream into a cache: the second brings clicks again, of which only those with even ids are left."""
    path, check, drop = (shared_dir(spark, x) for x in ("cache", "cache-check", "cache-in"))
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("company_symbol"))
    for some in (rows, rows.where("company_symbol = 'click' and event_id % 2 = 0")):
        some.write.mode("append").parquet(drop)
        streams.replacing(spark.readStream.schema(rows.schema).parquet(drop), path, check).awaitTermination()
    return spark.read.parquet(path).groupBy("company_symbol").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_id"))


Q["stream_replace"] = _stream_replace
S["stream_replace"] = "SELECT event_type AS company_symbol, count(*) AS n, min(event_id) AS least_id FROM events WHERE event_type <> 'click' OR event_id % 2 = 0 GROUP BY event_type"
