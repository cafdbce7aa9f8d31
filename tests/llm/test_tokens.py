import os
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from newsloom.llm import encode, lexicon, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabulary files")
TEXTS = [None, "", " ", "Hello  world, it's 42!", "<|endoftext|>", "मानसून में देरी", "a\x00b\x1c c", "😀👨‍👩", "x" * 3000, "don't   stop\n\n\n", "₹1,234.50 “quoted” — naïve", "tab\tand nbsp\xa0"]


def load(words):
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(lexicon.pack(lexicon.build(words)))
    return lexicon.Lexicon(f.name)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=8), st.lists(st.integers(0, 50_000), min_size=1, max_size=4), max_size=60), st.lists(st.text(max_size=8), max_size=30))
def test_the_automaton_knows_its_words_and_no_others(words, others):
    by = {w.encode("utf-8", "ignore"): ids for w, ids in words.items() if w.encode("utf-8", "ignore")}
    lex = load(by)
    asked = list(by) + [x.encode("utf-8", "ignore") for x in others]
    for w, at in zip(asked, lex.find(asked).tolist()):
        assert (at >= 0) == (w in by)
        if at >= 0:
            assert lex.ids[lex.offset[at] : lex.offset[at + 1]].tolist() == by[w]


def test_suffixes_are_shared():
    built = lexicon.build({w: [1] for w in (b"walking", b"talking", b"stalking")})
    assert len(built["begin"]) - 1 < 12


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab Z9'.,\n\t\r “”₹éÀ-_’ store's'll  "), max_size=60))
def test_plain_texts_split_alike(text):
    import regex

    assert tokens.splitter()(text) == regex.findall(tokens.PATTERN, text)


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_ids_are_those_of_the_tokenizer(spark, size):
    df = spark.createDataFrame([(k, t, "ids") for k, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, ids string")
    enc = tokens.encoding()
    got = {r.doc_id: r.ids for r in encode.encode(df, size=size).collect()}
    assert got == {k: enc.encode_ordinary(t) if t else [] for k, t in enumerate(TEXTS + TEXTS)}
    assert encode.encode(df.limit(0)).count() == 0


def least_padding(sizes, counts, k):
    best = {0: 0}
    for _ in range(k):
        new = {}
        for done, cost in best.items():
            for to in range(done + 1, len(sizes) + 1):
                c = cost + sum((sizes[to - 1] - sizes[i]) * counts[i] for i in range(done, to))
                new[to] = min(new.get(to, c), c)
        best = {**new, **{d: min(c, new.get(d, c)) for d, c in best.items()}}
    return best[len(sizes)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=14), st.integers(1, 5))
def test_buckets_pad_least(counts, k):
    histogram = np.array([0, *counts])
    sizes = np.flatnonzero(histogram)
    bounds = packing.bucket_bounds(histogram, k)
    if not len(sizes):
        assert bounds == []
        return
    assert len(bounds) <= k and bounds[-1] == sizes[-1]
    padding = sum((min(b for b in bounds if b >= s) - s) * histogram[s] for s in sizes)
    assert padding == least_padding(sizes.tolist(), histogram[sizes].tolist(), min(k, len(sizes)))


@pytest.mark.parametrize("ranked", [200_000, 3])
def test_containers(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    texts = TEXTS + ["word " * k for k in range(0, 3000, 61)] + ["same text"] * 40 + ["long " * 9000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, container int")
    enc = tokens.encoding()
    got = packing.pack(df).toPandas()
    want = {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    held = got.groupby("container").n_tokens.sum()
    assert held.max() <= 2048 and len(held) <= 1.1 * sum(want.values()) / 2048 + 1
    for k, n in want.items():
        own = got[got.doc_id == k].sort_values("piece")
        assert len(own) == max(1, -(-n // 2048)) and own.token_start.tolist() == [2048 * i for i in range(len(own))]
    assert packing.pack(df.limit(0)).count() == 0
    filled = got[got.n_tokens > 0]
    assert (filled[~filled.mixed].groupby("container").bucket.nunique() == 1).all() and (filled.n_tokens <= filled.bucket).all()
    assert filled.groupby("container").mixed.nunique().max() == 1


def test_the_program_decides_and_batches_stay_in_their_bucket(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(20, 500, 20_000), rng.integers(500, 2049, 1500)])
    counts = np.bincount(sizes, minlength=packing.CAPACITY + 1)
    assert packing.BUCKETS < (counts > 0).sum() / 10
    asked = []
    real = packing.bucket_bounds
    monkeypatch.setattr(packing, "bucket_bounds", lambda c, k: asked.append(k) or real(c, k))
    bounds, segments, containers = packing.plan(counts)
    assert asked == [packing.BUCKETS] and len(bounds) == packing.BUCKETS
    low = dict(zip(bounds, [0, *bounds]))
    for size, _, _, _, of in segments.tolist():
        assert not of or low[of] < size <= of
    # all items are placed once, and no container holds more than it can
    room = np.zeros(containers, np.int64)
    placed = np.zeros_like(counts)
    by_size: dict = {}
    for size, first, container, per, of in segments.tolist():
        by_size.setdefault(size, []).append((first, container, per))
    for size, own in by_size.items():
        for (first, container, per), (end, *_) in zip(own, own[1:] + [(int(counts[size]),)]):
            ranks = np.arange(end - first)
            np.add.at(room, container + ranks // per, size)
            placed[size] += end - first
    assert (placed == counts).all() and room.max() <= packing.CAPACITY
    tokens_in = int((counts * np.arange(len(counts))).sum())
    assert containers <= 1.002 * tokens_in / packing.CAPACITY + 1
    alone = {c for size, first, c, per, of in segments.tolist() if of}
    assert len(alone) > 10
