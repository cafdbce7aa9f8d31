import json
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import collect, dedupe, evaluation as ev, search, sentiment, sessions, verdict
from newsloom.schemas import CACHE, COMPANY
from newsloom.session import broadcast_if_small, materialise, shared_dir
from newsloom.sources import answers, cache, feeds, master
from newsloom.streaming import news as streams


@pytest.fixture(scope="module")
def companies(spark):
    rows = [
        ("TCS", "Tata Consultancy Services Limited", "EQ", None, 1.0, 1, "IN1", 1.0), ("TATAMOT", "Tata Motors Limited", "EQ", None, 1.0, 1, "IN2", 1.0), ("XTATA", "Best Tata Ltd", None, None, None, None, None, None),
        ("TATA", "Tata Tata Steel", "BE", None, 1.0, 1, "IN4", 1.0), ("ALPHA", "All 100% Foods", "BE", None, 1.0, 1, "IN5", 1.0)]
    return spark.createDataFrame(rows, COMPANY)


def q(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


def test_tiers_budget_before_repeats(spark, companies):
    got = search.tiered(companies, q(spark, "tata"), 10).orderBy("place").select("symbol", "priority").collect()
    assert [tuple(r) for r in got] == [("TATA", 1), ("TATAMOT", 2), ("TCS", 3), ("XTATA", 4)]
    # the symbol-prefix row that holds the query in its name as well uses up two places
    two = spark.createDataFrame([("AB", "x AB", "EQ"), ("ABC", "y ABC", "EQ"), ("ZZ", "z ab", "EQ")], "symbol string, company_name string, series string")
    got = search.tiered(two, q(spark, "AB"), 4).orderBy("place").collect()
    assert [r.symbol for r in got] == ["AB", "ABC"]


def test_search_takes_signs_literally(spark, companies):
    assert {r.symbol for r in search.ranked(companies, q(spark, "100%")).collect()} == {"ALPHA"}
    assert search.ranked(companies, q(spark, "%")).collect()[0].symbol == "ALPHA"
    assert search.tiered(companies.limit(0), q(spark, "a")).count() == 0


def test_autocomplete_gate_and_fallback(spark, companies):
    got = search.autocomplete(companies, q(spark, " t ", "tc s", "TC"))
    assert {r["query"] for r in got.collect()} == {"TC"}
    assert {r["query"] for r in search.fallback(companies, q(spark, "TATAZZZ")).collect()} == {"TAT"}


def test_similar_and_context(spark, companies):
    got = search.similar(companies, spark.createDataFrame([("tcs",)], "symbol string")).collect()
    assert [r.symbol for r in got] == ["TATAMOT", "TATA"]
    row = search.context(companies).where("symbol = 'TCS'").first()
    assert row.primary_search_term == "TCS" and row.news_config.max_articles == 50


def test_similar_of_all_companies(spark):
    rng = random.Random(3)
    names = [f"{rng.choice(['A', 'AB', 'ABC', 'Abc', 'B', 'A B', 'Ü'])}{rng.choice(['', 'x', 'y z'])} {rng.choice(['Ltd', 'Foods', ''])}".strip() for _ in range(80)]
    rows = [(f"S{k}", n) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "symbol string, company_name string")
    want = {(s, i + 1, *x) for s, n in rows for i, x in enumerate(sorted(((t, m) for t, m in rows if t != s and m.startswith(n.split(" ")[0])), key=lambda x: (x[1], x[0]))[:5])}
    similar = search.similar(df, df.select("symbol"))
    assert {tuple(r) for r in similar.collect()} == want
    assert "NestedLoop" not in similar._jdf.queryExecution().executedPlan().toString()


def test_master_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(' SYMBOL,NAME OF COMPANY , SERIES, DATE OF LISTING, PAID UP VALUE, MARKET LOT, ISIN NUMBER, FACE VALUE\n" tcs ","Tata, Ltd ",eq,06-OCT-2008,10,1,IN1,x\nTCS,Zweite,EQ,bad,,one,,1\n,No symbol,EQ,,,,,\nA,,EQ,,,,,\nB,Beta,,2019-05-12,1.5,7,,2\n', encoding="utf-8")
    got = {r.symbol: r for r in master.clean(master.read_csv(spark, str(path))).collect()}
    assert set(got) == {"TCS", "B"} and got["TCS"].company_name == "Tata, Ltd" and str(got["TCS"].listing_date) == "2008-10-06" and got["TCS"].face_value is None
    assert got["B"].market_lot == 7 and got["B"].series is None
    master.write(master.clean(master.read_csv(spark, str(path))), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        master.read_csv(spark, str(tmp_path / "bad.csv"))


def test_answers(spark):
    ok = [{"title": "A", "url": "https://www.x.example/1", "date": "2025-01-02", "summary": "s"}, {"title": " ", "url": "https://x.example"}, {"title": "B", "url": "nowhere"}, {"title": "C", "url": "https://evil-x.example/", "date": ""}]
    bodies = ["```json\n" + json.dumps(ok) + "\n```", "json " + json.dumps(ok[:1]), json.dumps({"articles": ok}), "[{\"title\": \"cut", None, "", "[]"]
    rows = spark.createDataFrame([(k, "S", b) for k, b in enumerate(bodies)], "response_id long, company_symbol string, body string").withColumn("fetched_at", F.lit("2025-03-04 05:06:07").cast("timestamp"))
    got = answers.normalise(rows)
    assert [(r.response_id, r.title, r.published) for r in got.orderBy("response_id", "place").collect()] == [(0, "A", "2025-01-02"), (0, "C", "2025-03-04"), (1, "A", "2025-01-02")]
    listed = spark.createDataFrame([("x.example",)], "domain string")
    assert {r.title for r in answers.credible(got, listed, "link").collect()} == {"A"}


def test_feeds(spark):
    xml = ["<item><title>A &amp; b</title><link>l</link><summary>s</summary><description><![CDATA[<p>d</p>]]></description><category>x</category><category>y</category><pubDate>Wed, 01 Jan 2025 08:17:03 +0530</pubDate></item>", "<item><title>no link</title></item>", "not xml", None]
    items = feeds.parse_items(spark.createDataFrame([(k, x) for k, x in enumerate(xml)], "k int, xml string"))
    got = feeds.to_articles(items, F.lit("description"), F.lit("pubDate")).collect()
    assert len(got) == 1 and got[0].title == "A & b" and got[0].description == "<p>d</p>" and got[0].category == ["x", "y"] and str(got[0].published_ts) == "2025-01-01 02:47:03"
    waits, calls = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 4:
            raise OSError("down")
        return b"body"

    assert feeds.fetch(["p", "b"], get, sleep=waits.append) == (b"body", "") and calls == ["p", "b", "p", "b"] and waits == [1.0]
    assert feeds.fetch(["p"], lambda u: b"", sleep=waits.append)[0] is None


def test_feed_source(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss/>")
    spark.dataSource.register(feeds.FeedSource)
    got = spark.read.format("newsfeed").option("sources", f"one=file:///nowhere|file://{tmp_path}/f.xml\ntwo=file:///nowhere").option("timeout", "2").load().collect()
    assert {(r.source, r.document) for r in got} == {("one", "<rss/>"), ("two", None)}


def test_fetch_summary(spark):
    sources = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "source_name string, active boolean")
    arts = spark.createDataFrame([("a",), ("a",)], "source_name string")
    row = feeds.failure_summary(feeds.fetch_report(sources, arts)).first()
    assert (row.attempted, row.successful, row.failed, row.articles, row.success_rate, row.severity) == (2, 1, 1, 2, 50.0, "low")
    assert feeds.failure_summary(feeds.fetch_report(sources, arts.limit(0))).first().severity == "critical"


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "t", "c", "u", "s", None, 0.1, "2025-01-01", "2025-01-02T00:00:00Z"), (2, "A", "t", "c", "u", "s", None, None, "2025-01-01", "2025-01-03T00:00:00Z"), (3, None, "t", "c", "u", "s", None, 0.1, None, None)], CACHE)
    at = "2025-01-02 00:00:00"
    assert [r.id for r in cache.valid(rows, at).collect()] == [2]
    assert sorted(r.id for r in cache.purge(rows, at).collect()) == [1, 2, 3]
    assert cache.stamped(rows, at).first().expires_date == "2025-01-05T00:00:00"
    path = str(tmp_path / "c")
    cache.replace_by_key(rows.where("id < 3").select("id", F.concat(F.lit("K"), F.col("id").cast("string")).alias("company_symbol")), path)
    cache.replace_by_key(spark.createDataFrame([(9, "K2")], "id int, company_symbol string"), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "company_symbol").collect()} == {(1, "K1"), (9, "K2")}


def test_age_by_instant(spark):
    dates = ["2025-06-01 05:30:00", "2025-06-01 05:29:59", "1748736000000", "Mon, 02 Jun 2025 10:00:00 GMT", "Fri, 30 May 2025 10:00:00 GMT", "yesterday", "", None]
    rows = spark.createDataFrame(list(enumerate(dates)), "id int, cached_date string")
    got = {r.id: str(r.at) for r in cache.not_older(rows, "2025-06-01", "2025-07-01 00:00:00").select("id", F.col("at").cast("string").alias("at")).collect()}
    assert got == {0: "2025-06-01 00:00:00", 2: "2025-06-01 00:00:00", 3: "2025-06-02 10:00:00", 5: "2025-07-01 00:00:00"}


def test_collection(spark, companies):
    rows = spark.createDataFrame([(1, "TCS", "Tata  motors", "x services of consultancy", "u1", "rss"), (2, "TCS", None, None, "u1", "gemini"), (3, "TCS", "tcs", "", "", "rss"), (4, None, "tcs", "", "u", "rss")], "id int, company_symbol string, article_title string, article_content string, article_url string, source_name string")
    got = {r.id: r.matched_terms for r in collect.relevant(rows, companies).collect()}
    assert set(got) == {1, 3} and "tata consultancy" in got[1]
    about = {(r.id, r.symbol) for r in collect.about_companies(rows, companies).collect()}
    assert (1, "TCS") in about and (1, "TATAMOT") in about and (3, "TCS") in about and not any(i == 2 for i, _ in about)
    assert [r.id for r in collect.first_per_link(rows, "gemini").orderBy("id").collect()] == [2, 4]
    assert collect.capped(rows, 1).count() == 2
    assert collect.about_companies(rows, companies.limit(0)).count() == 0


def test_headline_pairs_and_greedy(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(40)]
    rows = []
    for k in range(120):
        base = rng.sample(words, rng.randint(6, 12)) if k % 4 == 0 or not rows else rows[-1][2].split()
        w = list(base)
        if rng.random() < 0.6 and len(w) > 1:
            w.pop()
        rows.append((k, "AB"[k % 2], " ".join(w), rng.random()))
    rows += [(200, "A", None, 0.5), (201, "A", "", None), (202, None, rows[0][2], 0.1)]
    df = spark.createDataFrame(rows, "id int, company_symbol string, article_title string, relevance_score double")
    sets = {i: (g, frozenset(t.split()) if t else frozenset()) for i, g, t, _ in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(i for (g, s), i in first.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) > 0.85 * len(sets[a][1] | sets[b][1])}
    assert {(r.id_a, r.id_b) for r in dedupe.headline_pairs(df).collect()} == want
    kept = {r.id for r in dedupe.greedy(df).collect()}
    want = set()
    for g in ("A", "B", None):
        own = []
        for i, gg, t, score in rows:
            if gg != g:
                continue
            w, s = sets[i][1], score or 0.0
            hit = next((k for k, x in enumerate(own) if w and len(w & x[1]) > 0.85 * len(w | x[1])), None)
            if hit is None:
                own.append((i, w, s))
            elif s > own[hit][2]:
                own[hit] = (i, w, s)
        want |= {x[0] for x in own}
    assert kept == want and {200, 201, 202} <= kept and len(kept) < len(rows)
    assert dedupe.greedy(df.limit(0)).count() == 0


def test_sentiment_and_verdict(spark):
    rows = spark.createDataFrame([(1, "A", "It rose and JUMPED"), (2, "A", "nothing"), (3, "A", " \n"), (4, "B", "it sank"), (5, "B", None)], "doc_id int, company_symbol string, text string")
    got = {r.doc_id: r.sentiment for r in sentiment.scored(rows).collect()}
    assert got == {1: "positive", 2: "neutral", 4: "neutral"}  # equal scores: the first label in order
    by = {r.company_symbol: r for r in verdict.summary(sentiment.scored(rows), ["company_symbol"]).collect()}
    assert by["A"].bullish == 1 and by["A"].chunk_count == 2 and by["A"].sentiment_label == "bullish"
    assert verdict.shares(verdict.summary(sentiment.scored(rows), ["company_symbol"])).where("company_symbol = 'A'").first().bullish_pct == 50.0
    modelled = sentiment.scored_by_model(rows, lambda: lambda texts: [[0.0, 0.0, float(len(t))] for t in texts])
    assert {r.sentiment for r in modelled.collect()} == {"negative"}
    edges = spark.createDataFrame([(0.2,), (-0.2,), (0.19,), (0.0,)], "s double").select(verdict.verdict_of(F.col("s")).alias("v")).collect()
    assert [r.v for r in edges] == ["bullish", "bearish", "neutral", "neutral"]


def test_evaluation_golden(spark):
    cells = {("positive", "positive"): 308, ("positive", "neutral"): 26, ("neutral", "positive"): 79, ("neutral", "neutral"): 255, ("negative", "positive"): 38, ("negative", "neutral"): 264, ("negative", "negative"): 32}
    rows = spark.createDataFrame([(a, p) for (a, p), n in cells.items() for _ in range(n)], "gold string, model string")
    rep = ev.report(ev.confusion(rows, "gold", "model"))
    recall = {r.label: r.recall for r in rep.collect()}
    assert recall["positive"] == pytest.approx(308 / 334) and recall["negative"] == pytest.approx(32 / 334)
    avg = ev.averages(rep).first()
    assert avg.accuracy == pytest.approx(0.593812375249501) and avg.weighted_f1 == pytest.approx(0.5222207896778964)
    assert ev.confusion(rows.limit(0), "gold", "model").count() == 3 and ev.averages(ev.report(ev.confusion(rows.limit(0), "gold", "model"))).first().accuracy == 0.0


def test_split_is_exact_and_whole(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 990, "b").alias("label"))
    got = ev.stratified(rows, "id", "label", {"train": 0.8, "val": 0.1, "test": 0.1})
    counts = {(r.label, r.part): r["count"] for r in got.groupBy("label", "part").count().collect()}
    assert sum(counts.values()) == 1000 and counts["a", "train"] == 560 and counts["b", "val"] == 29 and counts[None, "train"] == 8
    assert ev.stratified(rows.limit(0), "id", "label", {"train": 1.0}).count() == 0


def test_generator_is_repeatable(spark):
    a = [tuple(r) for r in ev.generate(spark, 50).orderBy("n").collect()]
    assert a == [tuple(r) for r in ev.generate(spark, 50).repartition(3).orderBy("n").collect()] and len(a) == 150 and not any("{" in r[1] for r in a)


def test_sessions_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "A", "2025-01-01 00:00:00.000"), (2, 1, "AB", "2025-01-01 00:00:00.200"), (3, 1, "A", "2025-01-01 00:00:01"), (4, 2, "Z", "2025-01-01 00:00:00"), (5, 9, "Q", "2025-01-01 00:10:00")], "event_id long, user_id long, symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.event_id for r in sessions.debounced(rows).collect()) == [2, 3, 4, 5]
    assert [(r.user_id, r.symbol) for r in sessions.recent(rows, "user_id", "symbol", "ts").orderBy("user_id", "rank").collect()] == [(1, "A"), (1, "AB"), (2, "Z"), (9, "Q")]
    drop = str(tmp_path / "in")
    rows.withColumnRenamed("symbol", "query").write.parquet(drop)
    read = spark.readStream.schema("event_id long, user_id long, query string, ts timestamp").parquet(drop)
    s = streams.debounced(read).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    s.awaitTermination()
    assert {(r.user_id, r["query"]) for r in spark.table("deb").collect()} == {(1, "AB"), (1, "A"), (2, "Z")}
    recent = streams.recent(read.withColumnRenamed("query", "symbol"))
    s = recent.writeStream.format("memory").queryName("rec").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    s.awaitTermination()
    assert {r.user_id: r["items"] for r in spark.table("rec").collect()} == {1: ["A", "AB"], 2: ["Z"], 9: ["Q"]}


def test_helpers(spark):
    df = spark.range(10)
    assert materialise(df, "x").count() == 10 and shared_dir(spark, "x").startswith("file:")
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 5)._jdf.queryExecution().logical().toString().lower()
