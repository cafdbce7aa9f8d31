import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from newsloom.functions.timestamps import parse_instant
from newsloom.llm import bloom, history as h, prints

SCHEMA = "id int, company_symbol string, article_url string, article_title string, cached_date string"


@pytest.mark.parametrize(("a", "b", "same"), [
    ("https://www.x.example/a/", "http://X.example:80/a", True), ("https://x.example:443/a#p", "http://m.x.example/a/amp", True), ("http://x.example:443/a", "http://x.example/a", False),
    ("https://x.example/a?b=1&a=2&utm_source=z", "http://amp.x.example/a?a=2&b=1&gclid=9", True), ("https://x.example/a?b=1", "https://x.example/a?b=2", False),
    ("https://x.example/A", "https://x.example/a", False), ("https://x.example/a?reference=1", "https://x.example/a", False), ("https://x.example/a?", "https://x.example/a", True),
    ("https://x.example", "https://x.example/", True), ("https://x.example/a/amp/", "https://x.example/a", True), ("https://www.example/", "https://www.example/", True),
])
def test_addresses(a, b, same):
    assert (h.address_key(a) == h.address_key(b)) is same


def test_blank_addresses_match_nothing():
    assert h.address_key(None) is None and h.address_key("  ") is None


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**62), min_size=1, max_size=90), st.data())
def test_alike_sets_share_a_fingerprint(words, data):
    order = np.random.default_rng(3).integers(0, 50, 1 << h.ORDER_BITS)
    a = sorted(words)
    drop = data.draw(st.integers(0, len(a) // 5))
    add = data.draw(st.integers(0, len(a) // 5))
    b = sorted(set(a[drop:]) | {2**62 + k + 1 for k in range(add)})
    common = len(set(a) & set(b))
    if 9 * common >= 4 * (len(a) + len(b)) and a != b:
        of = lambda s, g: set(h.fingerprints(np.array([0, len(s)]), np.array(s, np.int64), np.array([g]), order)[2].tolist())
        assert of(a, 7) & of(b, 7)
        assert not of(a, 7) & of(b, 8)


def brute(rows):
    cases = set()
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for own in by.values():
        own.sort(key=lambda r: (h.LAST if (t := parse_instant(r[4], "Asia/Kolkata")) is None else t, r[0]))
        kept = []
        for i, _, url, title, _ in own:
            key, words = h.address_key(url), frozenset(h.find_words(title.lower())) if title else frozenset()
            if any(key is not None and key == k or words and w and len(words & w) * 9 >= 4 * (len(words) + len(w)) for k, w in kept):
                cases.add(i)
            else:
                kept.append((key, words))
    return cases


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows, titles = [], []
    for i in range(n):
        if titles and rng.random() < 0.5:
            t = rng.choice(titles).split()
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            title = " ".join(t)
        else:
            title = " ".join(rng.sample(words, rng.randint(1, 14)))
        titles.append(title)
        title = rng.choice([title, title.upper(), None, "", " - "]) if rng.random() < 0.2 else title
        url = rng.choice([None, "", f"https://a.example/{rng.randrange(150)}", f"http://www.a.example/{rng.randrange(150)}/?utm_x=1"])
        date = rng.choice([f"2025-01-{rng.randint(1, 9):02d}T10:00:00Z", f"2025-01-{rng.randint(1, 9):02d}", None]) if rng.random() < 0.3 else f"2025-01-0{rng.randint(1, 9)}T0{rng.randrange(9)}:00:00Z"
        rows.append((i, rng.choice(["A", "A", "A", "B", None]), url, title, date))
    return rows


COLUMNS = ("id", "company_symbol", "article_url", "article_title", "cached_date")


@pytest.mark.parametrize(("small", "one_task"), [(50_000, 1), (60, 1), (-1, 1), (-1, 0)])
def test_against_brute_force(spark, monkeypatch, small, one_task):
    if not one_task:
        monkeypatch.setattr(h, "ONE_TASK", 0)
    monkeypatch.setattr(h, "SMALL", small)
    rows = made(11 + small, 400 if one_task else 250)
    asked = []
    real = h.AcceptedStore.add_all
    monkeypatch.setattr(h.AcceptedStore, "add_all", lambda self, batches, items: asked.extend(b for b, _ in batches) or real(self, batches, items))
    got = {r.id for r in h.repeats(spark.createDataFrame(rows, SCHEMA), *COLUMNS).collect()}
    assert got == brute(rows)
    days = {(h.LAST if (t := parse_instant(r[4], "Asia/Kolkata")) is None else t) // h.DAY for r in rows if h.address_key(r[2]) or r[3] and h.find_words(r[3].lower())}
    assert asked == sorted(days)  # a batch is one UTC day


def test_store_takes_later_batches(spark):
    rows = [r for r in made(5, 240) if r[4]]
    day = lambda r: parse_instant(r[4], "Asia/Kolkata") // h.DAY
    days = sorted({day(r) for r in rows})
    path = h.shared_dir(spark, "store")
    found = set()
    for some in (days[:3], days[3:6], days[6:]):
        # a new store object each time: what it knows comes from its folder
        part = [r for r in rows if day(r) in some]
        found |= {r.id for r in h.repeats(spark.createDataFrame(part, SCHEMA), *COLUMNS, store=h.AcceptedStore(spark, path)).collect()}
    assert found == brute(rows)
    store = h.AcceptedStore(spark, path)
    assert store.done == days
    items = spark.createDataFrame([], h.ITEM)
    assert {r.id for r in store.add(days[-1], items).collect()} == {r.id for r in store.killed(days[-1]).collect()}  # done already: not taken again
    with pytest.raises(ValueError):
        store.add(days[0] - 1, items)


def one_day(store, batch, titles, first_id, order, previous=None):
    """A batch of one part without Spark: the ids that the store knows as repeats, and the rows looked up."""
    ids = np.arange(first_id, first_id + len(titles))
    sets = [np.sort(h.WordHashes().of(t.split()).view(np.int64)) for t in titles]
    offset, words = np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets)
    item, _, value = h.fingerprints(offset, words, np.zeros(len(sets), np.int64), order)
    part = prints.Part(store, batch, previous)
    own = prints.Sets(ids, offset, words)
    none = np.empty(0, np.int64)
    hit, _ = part.hits(value, item, own, none, none)
    part.keep(batch, value, item, own, none, none)
    part.publish()
    return set(ids[hit].tolist()), part.rows_read, len(part.runs)


def test_history_is_not_read_again(tmp_path):
    store, order = f"file://{tmp_path}/part", np.zeros(1 << h.ORDER_BITS, np.int64)
    read, runs = [], []
    for d in range(60):
        titles = [f"w{d}a{k} w{d}b{k} w{d}c{k} w{d}d{k} w{d}e{k} w{d}f{k}" for k in range(40)]
        if d:
            titles[:5] = [f"w{d - 1}a{k} w{d - 1}b{k} w{d - 1}c{k} w{d - 1}d{k} w{d - 1}e{k} w{d - 1}f{k}" for k in range(10, 15)]
        hit, n, r = one_day(store, d, titles, 1000 * d, order, d - 1 if d else None)
        assert hit == (set(range(1000 * d, 1000 * d + 5)) if d else set())
        read.append(n)
        runs.append(r)
    assert max(read[30:]) <= 2 * max(read[2:10])  # rows looked up follow the repeats, not the history
    assert max(runs) <= 8


def test_pairs_compared_follow_the_repeats(tmp_path, monkeypatch):
    """Each headline has the two rarest words of all, so that all share a fingerprint; word sets are compared only where the marks let them."""
    store, order = f"file://{tmp_path}/part", np.ones(1 << h.ORDER_BITS, np.int64)
    order[h.WordHashes().of(["name", "place"]).view(np.int64) & ((1 << h.ORDER_BITS) - 1)] = 0
    compared = []
    real = prints.common_words
    monkeypatch.setattr(prints, "common_words", lambda a, i, b, j: compared.append(len(i)) or real(a, i, b, j))
    title = lambda d, k: "name place " + " ".join(f"{x}{d}q{k}" for x in "abcdefghij")
    for d in range(12):
        titles = [title(d, k) for k in range(50)]
        if d:
            titles[:5] = [title(d - 1, k).replace(f"a{d - 1}q", f"z{d}q") for k in range(10, 15)]
        hit, read, _ = one_day(store, d, titles, 1000 * d, order, d - 1 if d else None)
        assert hit == (set(range(1000 * d, 1000 * d + 5)) if d else set())
    assert read >= 50 * 500 and sum(compared) <= 500


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 30), (3, 200)])
def test_marks_keep_all_alike(seed, n):
    rng = np.random.default_rng(seed)
    words = [np.sort(rng.choice(2**40, n, replace=False)) for _ in range(60)]
    for k in range(0, 60, 2):
        kept = words[k][rng.permutation(n)[: n - rng.integers(0, n // 5 + 1)]]
        words[k + 1] = np.unique(np.concatenate([kept, rng.integers(0, 2**40, rng.integers(0, n // 5 + 1))]))
    sets = prints.Sets(np.arange(60), np.concatenate([[0], np.cumsum([len(w) for w in words])]), np.concatenate(words))
    i, j = (x.ravel() for x in np.mgrid[:60, :60])
    alike = 9 * prints.common_words(sets, i, sets, j) >= 4 * (sets.size(i) + sets.size(j))
    assert alike[i != j].any() and prints.maybe_alike(sets, i, sets, j)[alike].all()


@pytest.mark.parametrize("small", [60, 25])
def test_shards_of_companies(spark, monkeypatch, small):
    """One company has half of all articles. A shard's task takes as much as one task may, and a day that is too large for that is shuffled by part."""
    monkeypatch.setattr(h, "SMALL", small)
    monkeypatch.setattr(h, "PART_ITEMS", 40)
    rows = [(i, f"C{i % 40}" if i % 2 else "A", *rest) for i, _, *rest in made(small, 400)]
    path = h.shared_dir(spark, "sharded")
    ready, items, store = h.replay(spark.createDataFrame(rows, SCHEMA), *COLUMNS, path)
    n = items.count()
    assert len(store.shards) == n // 40 and store.shards.max() >= 2
    assert len(store._stretches) < n / small or small < 60  # as the largest shard needs, not as all together
    accepted = {r.id for r in items.join(store.killed(), ["batch", "id"], "left_anti").collect()} | {r.id for r in ready.where("addr is null and tset is null").collect()}
    assert {r[0] for r in rows} - accepted == {r.id for r in h.repeats(spark.createDataFrame(rows, SCHEMA), *COLUMNS).collect()} == brute(rows)
    assert h.AcceptedStore(spark, store.path).shards.tolist() == store.shards.tolist()


def test_a_task_may_be_repeated(tmp_path):
    store, order = f"file://{tmp_path}/part", np.zeros(1 << h.ORDER_BITS, np.int64)
    titles = [[f"x{d}{k} y{d}{k} z{d}{k} v{d}{k} u{d}{k}" for k in range(20)] for d in range(4)]
    titles[3][0], titles[3][1] = titles[0][5], titles[2][7]
    for d in range(4):
        first, again = (one_day(store, d, titles[d], 100 * d, order, d - 1 if d else None)[0] for _ in range(2))
        assert first == again == ({300, 301} if d == 3 else set())


def test_one_hot_address_and_empty(spark):
    rows = [(i, "A", "https://a.example/x", f"title number {i} of its own kind {i * 7}", f"2025-01-01T00:{i % 60:02d}:00Z") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert h.repeats(df, *COLUMNS).count() == 499
    assert h.repeats(df.limit(0), *COLUMNS).count() == 0


def test_bloom(spark):
    keys = np.arange(1000, dtype=np.int64) * 7919
    table = bloom.build(keys, bloom.size_for(1000))
    assert bloom.contains(table, keys).all() and bloom.contains(table, keys + 1).mean() < 0.05
    joint = bloom.distributed(spark.range(1000).selectExpr("id * 7919 as k"), 1000)
    assert bloom.contains(joint, keys).all()
