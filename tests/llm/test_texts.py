import pytest
from hypothesis import given, settings, strategies as st

from newsloom.llm import lookalike as look, splitting as sp, truncation as tr

BODY = "The board approved the plan on Monday. “We doubled the yield in March,” the filing states. "


@pytest.mark.parametrize(("ending", "cut"), [
    ("The margin rose 5 per cent.", False), ("“We shelved it,” an official added.", False), ("Will it hold?", False), ("It did! ", False), ("The mar", True), ("The margin rose 5 per cent, and", True),
    ("The margin rose… Read more", True), ("The margin ro... more", True), ("The margin [...]", True), ("The margin, … [+2837 chars]", True), ("The margin rose to 5… Continue reading", True), ("the margin ro�", True),
    ("the margin ro</p>", True), ("the margin rose.</p>", False), ("the margin rose <a hre", True), ("the margin rose &am", True), ("the sal</", True), ("as spreads narro...", True),
    ("It rose.\n\n(With inputs from agencies)", False), ("It rose. [Bureau report]", False), ("It rose. — Markets Desk", False), ("It rose.\nENDS", False), ("It rose.\n***", False), ("It rose.\n#markets #results", False),
    ("It rose.\nTags: Foo Agro, earnings, outlook", False), ("It rose.\nAlso read: Foo Agro in five charts", False), ("It rose.\nRead the filing: https://filings.example/111", False),
    ("It rose.\n- Capacity: 563 MW\n- Completion: March 2028", False), ("It rose.\nOpen: 580 High: 1702 Low: 13 Close: 811", False), ("By its own account, the mill", True), ("It rose.\n\nBy Asha Rao", False),
])
def test_endings(ending, cut):
    assert tr.is_cut(BODY + ending, False) is cut


@pytest.mark.parametrize(("ending", "cut"), [
    ('See <a href="https://site.example/' + "a" * 300, True), ('See <img alt="" src="https://site.example/' + "a" * 900, True), ("The margin rose." + "</p>" * 300, False), ("the margin ro" + "</p>" * 300, True),
    ("The margin rose." + " " * 1000, False), ("The margin ro" + " " * 1000 + "</p>" + " " * 1000, True), ('The margin rose.<img src="' + "a" * 900 + '">', False),
])
def test_far_markup(ending, cut):
    assert tr.is_cut(BODY + ending, False) is cut


@pytest.mark.parametrize("text", ["", " \n", "Log in to read the full article.", "Content not available in your region.", "…"])
def test_no_text_is_not_cut(text):
    assert not tr.is_cut(text, False)


def test_a_limit_opens_a_number():
    assert tr.is_cut(BODY + "It stood at ₹84.", True) and not tr.is_cut(BODY + "It stood at ₹84.", False)
    assert not tr.is_cut(BODY + "The turnover was " + "7" * 60 + ".", True)


def test_lengths_under_encodings():
    got = dict(zip(tr.VARIANTS, tr.lengths('₹ & <b> "x"\r\n\n😀')))
    text = '₹ & <b> "x"\r\n\n😀'
    import html
    import json

    assert got["characters"] == len(text) and got["utf8_bytes"] == len(text.encode()) and got["utf16_units"] == len(text) + 1
    assert got["html_escaped"] == len(html.escape(text, quote=False).replace('"', "&quot;")) and got["json_escaped"] == len(json.dumps(text, ensure_ascii=False)) - 2
    assert got["json_ascii"] == len(json.dumps(text)) - 2 and got["crlf"] == len(text) + 1 and got["lf"] == len(text) - 1


def test_hidden_limits_and_shares(spark):
    rows = [(k, ("x" * 37 + " word is cut he" * 30)[: 200 if k % 2 else 150 + k % 90] + ("" if k % 2 else "."), "A" if k < 300 else None, 1) for k in range(400)] + [(900, None, "A", 1), (901, " ", "B", 1), (901, " ", "B", 1)]
    df = spark.createDataFrame(rows, "id int, t string, s string, cut int")
    limits = {(r.source, r.variant, r.length) for r in tr.hidden_limits(df, "t", "s").collect()}
    assert ("A", 0, 200) in limits and (None, 1, 200) in limits and all(x[2] == 200 for x in limits)
    got = tr.find_cut(df, "id", "t", "s")
    assert got.count() == 403 and got.where("cut").count() == 200
    assert tr.find_cut(df.limit(0), "id", "t", "s").count() == 0


def sufficient(text, limit=1600):
    """The statement, part by part."""
    parts = sp._BLANK.split(text)
    if all(len(p.strip()) <= limit for p in parts):
        return "paragraph"
    cut = [p[a:b] for p in parts for a, b in zip([0, *(m.end() for m in sp._END.finditer(p))], [*(m.end() for m in sp._END.finditer(p)), len(p)])]
    if all(len(s.strip()) <= limit for s in cut):
        return "sentence"
    return "word" if all(len(w) <= limit for w in text.split()) else "none"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "cccccccc", "d.", "e!” ", "\n\n", " \r\n \n", "\n", " ", "  ", "x" * 15, "f?) "]), max_size=40), st.integers(6, 30), st.integers(0, 3))
def test_the_boundary_that_suffices_comes_from_the_bisection(parts, limit, words):
    text = "".join(parts)
    cut, suffices = sp.pieces(text, limit, words)
    assert suffices == sufficient(text, limit)
    assert "".join(text[a:b] for _, a, b, _ in cut) == text and all(b - o <= limit for o, _, b, _ in cut)


def test_only_the_limit_tells_cut_from_whole(spark):
    filler = "The unit grew on the back of demand from abroad and at home. " * 9
    of = lambda n: (filler + "It stood at ₹84.")[-n:]
    rows = [(k, of(300), "cuts at 300 characters") for k in range(40)] + [(100 + k, of(200 + 3 * k), "cuts nowhere") for k in range(40)]
    # of different numbers of characters, but all of 320 bytes
    tail, size = "It stood at ₹84.", lambda t: len(t.encode())
    rows += [(200 + k, "é" * k + filler[-(320 - 2 * k - size(tail)) :] + tail, "cuts at 320 bytes") for k in range(40)]
    assert {size(t) for i, t, _ in rows if i >= 200} == {320} and len({len(t) for i, t, _ in rows if i >= 200}) == 40
    got = {r.id: r for r in tr.find_cut(spark.createDataFrame(rows, "id int, t string, s string"), "id", "t", "s").collect()}
    assert all(got[k].cut and got[k].limit_only for k in (*range(40), *range(200, 240)))
    assert not any(got[100 + k].cut for k in range(40))


def check(text, limit=1600):
    cut, suffices = sp.pieces(text, limit)
    assert suffices == sufficient(text, limit)
    assert "".join(text[a:b] for _, a, b, _ in cut) == text and all(b - o <= limit and b > a for o, a, b, _ in cut)
    for (o0, a0, b0, _), (o, a, b, _) in zip(cut, cut[1:]):
        lead, before = text[o:a].split(), text[o0:b0].split()
        assert lead == before[len(before) - len(lead) :] and (len(lead) == 12 or len(before) < 12 or len(text[o:a]) > limit // 3 or any(len(w) > limit // 14 for w in before[-12:]))
    return cut


def test_pieces():
    prose = " ".join(f"Sentence number {k} says a little about nothing much at all." for k in range(200))
    assert {x[3] for x in check(prose)} == {"sentence", "end"}
    paragraphs = "\n\n".join(prose[k * 700 : k * 700 + 690] for k in range(12))
    assert {x[3] for x in check(paragraphs)} <= {"paragraph", "end"}
    assert {x[3] for x in check("word " * 2000)} == {"word", "end"}
    assert "none" in {x[3] for x in check("x" * 5000)}
    check("é" * 1500 + "́" * 3 + " " + "y" * 4000 + " z" * 900)
    assert sp.pieces("short") == ([(0, 0, 5, "end")], "paragraph")


@pytest.mark.parametrize(("text", "kind"), [
    ("a " * 900 + "\n\n" + "b " * 790, "word"), (("a " * 700 + "\n\n") * 3, "paragraph"), (("a" * 100 + ". ") * 30, "sentence"), (("a " * 100 + "b.” ") * 30, "sentence"), ("x" * 1601, "none"),
    ("a " * 700 + "\r\n \r\n" + "b " * 700, "paragraph"), ("x" * 1600 + " y", "word"),
])
def test_sufficient(text, kind):
    assert sp.pieces(text)[1] == kind == sufficient(text)


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x " * 800, 5), (4, "x " * 801, 5), (4, "x " * 801, 5)], "id int, t string, piece int")
    got = sp.split(df, "id", "t")
    assert {r.id for r in got.collect()} == {4} and got.where("piece = 0").count() == 2
    assert sp.split(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize(("a", "b", "same"), [
    ("ABC", "ＡＢＣ", True), ("cash buﬀer", "cash buffer", True), ("é", "é", True), ("K", "K", True), ("оре", "ope", True), ("Տօ", "So", True), ("ΑΒΕ", "ABE", True), ("a b", "a b", True), ("a​b‎", "ab", True),
    ("ё", "ë", True), ("a\r\nb", "a\nb", True), ("\x07a", "a", True), ("e​́", "é", True), ("a", "A", False), ("²", "2", False), ("é", "e", False), ("a.", "a,", False), ("a b", "ab", False), ("½", "1⁄2", False),
    ("👨‍👩", "👨👩", False), ("क्‍ष", "क्ष", False), ("ﬃ", "ffi", True), ("１２％", "12%", True), ("Ⅳ", "IV", True), ("ſ", "s", False),
])
def test_looks(a, b, same):
    assert (look.canonical(a) == look.canonical(b)) is same


def test_forms_are_stable():
    table = look.mapping()  # raises on a conflict
    for ch in list(table)[::7]:
        assert look.canonical(look.canonical(ch)) == look.canonical(ch)


def test_confusables_of_other_scripts(spark):
    more = look.confusables(spark)
    assert dict(more)["Ꮪ"] == "S" and dict(more)["ꓚ"] == "C" and dict(more)["ⲟ"] == "o" and dict(more)["ᴄ"] == "c" and len(more) > 60
    table = look.mapping(more)
    assert all(look.canonical(ch, more) == form for ch, form in more) and all(table[ch] == form for ch, form in more)
    df = spark.createDataFrame([(1, "ᏚᎪᏞE 5"), (2, "SAL" + "E 5"), (3, "Москва"), (4, "रजत")], "doc_id long, text string")
    assert [tuple(r) for r in look.alike_pairs(df).collect()] == [(1, 2)]


def test_alike_pairs(spark):
    rows = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, "ａｂｃ"), (5, None), (6, "​"), (7, " "), (8, "ABC"), (9, " "), (10, "x" * 50_000), (11, "x" * 50_000 + "​")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, look int")
    assert {tuple(r) for r in look.alike_pairs(df).collect()} == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (10, 11)}
    assert {(r.doc_id, r.class_id, r.spellings) for r in look.alike_classes(df).where("doc_id < 9").collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 3), (8, 8, 1)}
    assert {r.doc_id: r.text for r in look.canonical_text(df).collect()}[5] is None
    assert look.alike_pairs(df.limit(0)).count() == 0
