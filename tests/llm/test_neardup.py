import random
from collections import defaultdict

import pyarrow as pa
import pytest

from newsloom.llm import neardup as n
from newsloom.operators.components import components
from newsloom.llm.words import find_words

SCHEMA = "id int, t string, c string, cls string, shingles int"


def made(seed=4, families=40):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "al", "er", "on", "us", "is")]
    common = ["the quarterly report of the company says that", "as crews returned to the site", "on the back of demand"]
    rows, i = [], 0
    for _ in range(families):
        words = []
        while len(words) < rng.randint(35, 200):
            words += rng.choice(common).split() if rng.random() < 0.3 else [rng.choice(vocabulary) + str(rng.randrange(900))]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [own[k], "extra"], ["other"]])
            rows.append((i, rng.choice(["A title", None, ""]), " ".join(own), "x", 1))
            i += 1
    rows += [(i + k, None, t, None, None) for k, t in enumerate([None, "", "too short", rows[0][2], rows[0][2], "one " * 40, "word " * 29])]
    return rows


def brute(rows, least=0.5):
    sets = {}
    for i, t, c, *_ in rows:
        if c is not None and len(find_words(c.lower())) >= 30:
            w = find_words(f"{t or ''} {c}".lower())
            sets[i] = frozenset(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}, set(ids)


def test_pairs_and_groups(spark):
    rows = made()
    want, ids = brute(rows)
    members, links = n.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "t", "c")
    got = {tuple(r) for r in n.pairs_of(members, links).collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    groups = {r.id: r.group_id for r in n.groups_of(members, links).collect()}
    assert groups == {i: root(i) for i in ids}


def test_one_large_family(spark):
    rng = random.Random(7)
    base, size = [f"w{k}" for k in range(150)], 1500
    rows = []
    for i in range(size):
        own = list(base)
        for k in rng.sample(range(0, 150, 3), 8):
            own[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, None, " ".join(own), "x", 1))
    want, _ = brute(rows)
    assert len(want) > 0.9 * size * (size - 1) / 2
    members, links = n.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "t", "c")
    got = {tuple(r) for r in n.pairs_of(members, links).collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want), len(want - got) / len(want)
    assert n.groups_of(members, links).select("group_id").distinct().count() == 1


@pytest.mark.parametrize(("heavy", "rows_a_batch"), [(2000, 10_000), (5, 10_000), (5, 7), (1, 3)])
def test_signatures_shared_by_many(spark, monkeypatch, heavy, rows_a_batch):
    monkeypatch.setattr(n, "PAIRS", 50)
    rng = random.Random(heavy)
    rows = [(rng.choice([1, 1, 1, 2, 3, 40 + k % 30]), rng.randrange(60)) for k in range(300)] + [(9, 5), (9, 5)]
    of = defaultdict(set)
    for s, c in rows:
        of[s].add(c)
    want = sorted((a, b) for cs in of.values() for a in cs for b in cs if a < b)
    # batches that end inside groups, in process
    batches = [sorted(rows)[k : k + rows_a_batch] for k in range(0, len(rows), rows_a_batch)]
    made = [r for b in n._pair_up((pa.RecordBatch.from_arrays([pa.array([x[k] for x in b], pa.int64()) for k in (0, 1)], names=["sig", "cls"]) for b in batches), heavy) for r in b.to_pylist()]
    single = sorted((r["sig"], r["cls_a"]) for r in made if r["block"] is not None)
    assert single == sorted((s, c) for s, cs in of.items() if len(cs) > heavy for c in cs)
    assert sorted((r["cls_a"], r["cls_b"]) for r in made if r["block"] is None) == sorted((a, b) for cs in of.values() if len(cs) <= heavy for a in cs for b in cs if a < b)
    if rows_a_batch > 100:
        got = n.sharing(spark.createDataFrame(rows, "sig long, cls long"), None, heavy)
        assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("copies", [1000, 2])
def test_pairs_of_classes_with_many_copies(spark, monkeypatch, copies):
    monkeypatch.setattr(n, "COPIES", copies)
    cls = {1: range(0, 9), 2: range(10, 14), 3: [20]}
    members = spark.createDataFrame([(i, c) for c, own in cls.items() for i in own], "id long, cls long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "cls_a long, cls_b long")
    want = {(a, b) for own in cls.values() for a in own for b in own if a < b} | {(a, b) for x, y in ((1, 2), (2, 3)) for a in cls[x] for b in cls[y]}
    got = [tuple(r) for r in n.pairs_of(members, links).collect()]
    assert len(got) == len(want) and set(got) == want


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    members, links = n.near_duplicates(empty, "id", "t", "c")
    assert n.pairs_of(members, links).count() == 0 and n.groups_of(members, links).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, None), (2, "t", " ".join(f"w{k}" for k in range(50)), None, None)], SCHEMA)
    members, links = n.near_duplicates(alone, "id", "t", "c")
    assert n.pairs_of(members, links).count() == 0 and n.groups_of(members, links).count() == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (5, 5), (101, 100), (7, 3)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.root].add(r.node)
    assert got == {0: set(range(41)), 100: {100, 101}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
