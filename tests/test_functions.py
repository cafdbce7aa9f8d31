import pytest
from pyspark.sql import functions as F

from newsloom.functions import scores, text as T
from newsloom.operators import chunks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.strip, " \t x y　\n", "x y"), (T.strip, None, None), (T.strip, "", ""),
    (T.squeeze, "a \t  b", "a b"),
    (T.clean_query, "  m&m  ltd. ", "MM LTD."), (T.clean_query, "a_b%c", "ABC"),
    (T.without_suffix, "Tata Consultancy Services Limited", "Tata Consultancy Services"), (T.without_suffix, "Foo Corp Ltd", "Foo Corp"), (T.without_suffix, "Limited", "Limited"),
    (T.replace_all_suffixes, "Foo Corporation", "Foooration"),
    (T.clean_for_model, "<p>Rs</p> ₹ 5 and  $ 7\n", "Rs INR 5 and USD 7"), (T.clean_for_training, None, ""), (T.clean_for_training, " a <b>c</b> ", "a c"),
    (T.clean_url, "HTTP://A.b/c?utm_source=x&k=1/#", "http://a.b/c&k=1"), (T.clean_url, "https://a/?ref=z", "https://a"),
    (T.safe_id, "é-a b_c/₹", "é-a_b_c__"),
    (T.unfence, "```json\n[1]\n```", "[1]"), (T.unfence, "json [1]", "[1]"), (T.unfence, None, None),
    (T.html_text, "<p>a &amp; b<script>x</script> c</p>", "a & b c"), (T.html_text, None, None),
    (T.clean_for_filter, " ﬁ <b>x</b> ", "fi x"),
])
def test_text(spark, f, given, want):
    assert one(spark, f(F.col("a")), a=given) == want


def test_terms_keep_their_order(spark):
    assert one(spark, T.search_terms(F.col("a"), F.col("b")), a="FOO", b="Foo Corporation") == ["FOO", "Foo Corporation", "Foooration"]
    assert one(spark, T.search_terms(F.col("a"), F.col("b")), a="TCS", b="Tata Consultancy Services Limited") == ["TCS", "Tata Consultancy Services Limited", "Tata Consultancy Services", "Tata Consultancy"]


def test_highlight_quotes_signs(spark):
    assert one(spark, T.highlight(F.col("a"), F.col("b")), a="A.B and a.b, axb", b="a.b") == "**A.B** and **a.b**, axb"
    assert one(spark, T.highlight(F.col("a"), F.col("b")), a="x", b="") == "x"


def test_jaccard_of_nothing_is_zero(spark):
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), a="") == 0.0


@pytest.mark.parametrize(("text", "want"), [("we like tata consultancy services limited", 1.0), ("tata consultancy services grew", 0.8), ("the tata group", 0.3), ("nothing", 0.0)])
def test_company_match(spark, text, want):
    rows = spark.createDataFrame([(text, "", "Tata Consultancy Services Limited", "TCS")], "t string, d string, n string, s string")
    got = scores.prepared(rows, F.col("t"), F.col("d"), F.col("n"), F.col("s")).select(scores.simple_company_match().alias("x")).first().x
    assert got == pytest.approx(want)


def test_scores_of_nulls_and_hits(spark):
    rows = spark.createDataFrame([("TCS profit", "tata consultancy services", "Tata Consultancy Services Limited", "TCS"), (None, None, None, None), ("weather", "", "Foo Ltd", "FOO")], "t string, d string, n string, s string")
    got = [tuple(r) for r in scores.prepared(rows, *(F.col(c) for c in "tdns")).select(scores.relevance().alias("a"), scores.weighted_relevance().alias("b")).collect()]
    assert got[0][0] == 1.0 and 0.4 < got[0][1] <= 1.0
    assert got[1] == (0.0, 0.0) and got[2] == (0.0, 0.0)


def fold(text, most=400, words=12):
    """The rules of chunking, stated once more in plain Python."""
    import re

    if len(text) / 4 <= most:
        return [text]
    cur, tok, out = "", 0.0, []
    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)]:
        if len(s) <= 10:
            continue
        if tok + len(s) / 4 > most and cur:
            out.append(cur.strip())
            parts = cur.split(" ")
            lead = " ".join(parts[-words:]) if len(parts) > words else ""
            cur = f"{lead} {s}" if lead else s
            tok = len(cur) / 4
        else:
            cur = f"{cur} {s}" if cur else s
            tok += len(s) / 4
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks_follow_the_rules(spark):
    texts = ["x" * 1600, "x" * 1601, "Short one. " * 400, "A sentence of some length here. " * 120, ("Tiny. " * 300).strip(), "One " + "y" * 3000 + ". Next sentence follows it. " * 80, "", "é₹😀 ends. Then more words come here! " * 90]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.c for r in rows.select("k", chunks.chunk_texts(F.col("t")).alias("c")).collect()}
    assert all(got[k] == fold(t) for k, t in enumerate(texts))


def test_counts_hold_long_articles(spark):
    texts = ["x" * 1600, "x" * 1601, "Short one. " * 400, "A sentence of some length here. " * 120, "One " + "y" * 3000 + ". Next sentence follows it. " * 80]
    rows = spark.createDataFrame([(t,) for t in texts], "full_text string")
    want = {}
    for t in texts:
        n = len(fold(t))
        want[len(t) <= 1600] = [a + b for a, b in zip(want.get(len(t) <= 1600, [0] * 4), (1, n >= 1, n == 1, n))]
    assert {r[0]: list(r[1:]) for r in chunks.counts(rows).collect()} == want and want[False][3] > want[False][0]


def test_prepared_drops_empty_and_chunks_number(spark):
    schema = "id int, title string, description string, link string, published string, source string"
    rows = spark.createDataFrame([(1, None, "", "l", None, None), (2, "T", "d" * 10, "l", "p", "S é"), (3, "<b></b>", None, None, None, None)], schema)
    got = chunks.chunks(chunks.prepared(rows.withColumnRenamed("id", "key")), ["key"]).collect()
    assert [(r.key, r.id, r.chunk_id, r.text, r.metadata.chunk_position) for r in got] == [(2, "S_é_T_0", 0, "T. dddddddddd", "1/1")]
    assert chunks.prepared(rows.limit(0)).count() == 0
