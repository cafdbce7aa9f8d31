import os

import pytest
from pyspark.sql import functions as F

from newsloom.api import News
from newsloom.functions import display
from newsloom.operators import classifier

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_points(spark):
    news = News(spark, SF)
    first = news.autocomplete("KI")
    assert first and all("KI" in r["display_text"].upper() for r in first)
    assert news.autocomplete(first[0]["value"] + "ZZZ") and news.autocomplete("K") == []
    symbol = first[0]["value"]
    got = news.run([symbol.lower(), "NOSUCH"])
    assert got["NOSUCH"] == {"status": "not_found", "error": display.ERRORS["not_found"]}
    assert got[symbol]["status"] in ("ok", "no_articles")
    news.run([symbol])
    assert [r["symbol"] for r in news.recent()] == [symbol]


def test_display(spark):
    row = spark.createDataFrame([("BULLISH", 1, 0, "other")], "label string, part int, whole int, code string")
    got = row.select(display.percent(F.col("part"), F.col("whole")), display.label_text(F.col("label")), display.label_text(F.col("code")), display.error_message(F.col("code")), display.band(F.lit(0.5))).first()
    assert tuple(got) == (0.0, "Bullish", "Neutral", display.OTHER_ERROR, "yellow")


def test_classifier(spark):
    rows = spark.createDataFrame([(f"good gain {k}", "positive") for k in range(20)] + [(f"bad loss {k}", "negative") for k in range(20)] + [(f"same as before {k}", "neutral") for k in range(20)] + [(None, "positive"), ("x", None)], "text string, label string")
    got = classifier.predict(classifier.train(rows, 256), rows)
    assert got.count() == 61 and got.where("label = sentiment").count() >= 58
