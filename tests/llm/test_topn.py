import random

from newsloom.functions.timestamps import parse_instant
from newsloom.llm.topn import top_n

SCHEMA = "id int, g string, score double, d string, _zone string, _day boolean, rank int"


def test_against_sorting(spark):
    rng = random.Random(2)
    scores = [None, float("nan"), 0.0, -0.0, 0.5, 0.5, 0.9, -1.0, float("inf")]
    dates = [None, "", "soon", "2025-01-01", "01/02/2025", "2025-01-01T00:00:00Z"]
    rows = [(i, rng.choice(["A"] * 6 + ["B", "C", None]), rng.choice(scores), rng.choice(dates), rng.choice([None, "Asia/Kolkata"]), rng.choice([None, False]), 0) for i in range(900)]
    rows += [(1, "D", 0.1, None, None, None, 0), (1, "D", 0.1, None, None, None, 0)]
    got = {}
    for r in top_n(spark.createDataFrame(rows, SCHEMA).repartition(7), "g", "id", "score", "d", 5).orderBy("rank").collect():
        got.setdefault(r.g, []).append(r.id)

    def key(r):
        known = r[2] is not None and r[2] == r[2]
        t = parse_instant(r[3], r[4] or "UTC", True if r[5] is None else r[5])
        return (not known, -r[2] if known else 0, t is None, -t if t is not None else 0, r[0])

    for g in {r[1] for r in rows}:
        assert got[g] == [r[0] for r in sorted((r for r in rows if r[1] == g), key=key)[:5]]


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "id", "score", "d").count() == 0
