"""One consistent form for texts that look the same, by a longest-match transducer over grapheme clusters."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import materialise, spread

# Letters of other scripts and the Latin letters they look like, in the order of the scripts' alphabets.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХѴҮӀԚԜаеѕіјорсухѵүһӏԁԛԝ", "ABESIJKMHOPCTYXVYIQWaesijopcyxvyhldqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαινορυϲϳ", "ABEZHIKMNOPTYXCJaivopucj", strict=True))
ARMENIAN = dict(zip("ՏՕՍԼգհյոսօզ", "SOULqhjnuoq", strict=True))
LATIN = dict(zip("ɑɡ", "ag", strict=True))
#: Kinds of compatibility decomposition that look like what they decompose to. Raised and lowered figures, fractions, and circled signs aren't among them.
LOOKS_LIKE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<square>", "<small>"}
#: <compat> holds many things; only letters made of letters count: ligatures, digraphs, Roman numerals, letter-like signs.
_NOT_FOLDED = {"ſ", "…", "‥", "․"}
JOINERS = "‌‍"


def _shows_nothing(ch: str) -> bool:
    c = ord(ch)
    kind = unicodedata.category(ch)
    return (
        kind == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)
        or kind == "Cc" and ch not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85"
        or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0)
    )


def _letters(text: str) -> bool:
    return all(unicodedata.category(c)[0] in "LM" for c in text)


#: Scripts whose letters' look-alikes come from the public table of confusables, beside the tables above.
SCRIPTS = ("CHEROKEE", "COPTIC", "DESERET", "LISU", "LATIN LETTER SMALL CAPITAL")


def confusables(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """Letters of SCRIPTS that the Unicode table of confusables, which the engine's library for Unicode holds, draws as one Latin letter of the same case, with that letter."""
    letters = [ch for ch in map(chr, range(0x80, 0x20000)) if unicodedata.category(ch) in ("Lu", "Ll", "Lo") and unicodedata.name(ch, "").startswith(SCRIPTS)]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out = []
    for ch, form in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        form = "I" if form == "l" and not ch.islower() else form
        if len(form) == 1 and form.isascii() and form.isalpha() and not (ch.isupper() and form.islower() or ch.islower() and form.isupper()):
            out.append((ch, form))
    return tuple(out)


@lru_cache(maxsize=2)
def mapping(more: tuple[tuple[str, str], ...] = ()) -> dict[str, str]:
    """Every code point that has another form than itself, from the Unicode data and the tables above; checked for conflicts.

    A conflict is a form that is itself mapped on, or a letter that changes its case: both would let two forms of one text differ.
    """
    alike = {**dict(more), **CYRILLIC, **GREEK, **ARMENIAN, **LATIN}
    table: dict[str, str] = {}
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or 0xAC00 <= c <= 0xD7A3 or 0x4E00 <= c <= 0x9FFF:
            continue
        ch = chr(c)
        if ch in JOINERS:
            continue
        if _shows_nothing(ch):
            table[ch] = ""
        elif unicodedata.category(ch) == "Zs":
            table[ch] = " "
        elif ch in alike:
            table[ch] = alike[ch]
        elif (d := unicodedata.decomposition(ch)) and ch not in _NOT_FOLDED:
            kind = d.split()[0]
            form = None
            if kind in LOOKS_LIKE or kind == "<compat>" and unicodedata.category(ch)[0] in "LNS" and _letters(unicodedata.normalize("NFKC", ch)):
                # U+1F10x and the like are drawn with a frame, comma or full stop around them
                form = "".join(chr(int(x, 16)) for x in d.split()[1:])
                form = "".join(unicodedata.normalize("NFKC", x) if x not in _NOT_FOLDED else "s" for x in form)
            elif kind[0] != "<":
                form = unicodedata.normalize("NFC", ch)
                base = unicodedata.normalize("NFD", ch)
                if base[0] in alike:
                    form = unicodedata.normalize("NFC", alike[base[0]] + base[1:])
            if form is not None:
                form = unicodedata.normalize("NFC", "".join(alike.get(x, x) for x in form))
                if form != ch:
                    table[ch] = form
    table.pop(" ", None)
    for ch, form in list(table.items()):
        table[ch] = form = "".join(table.get(x, x) for x in form)
    for ch, form in table.items():
        again = "".join(table.get(x, x) for x in form)
        if again != form:
            raise ValueError(f"U+{ord(ch):04X} has the form {form!r}, which has the form {again!r}")
        if len(form) == 1 and ch.isupper() and form.islower() or ch.islower() and form.isupper():
            raise ValueError(f"U+{ord(ch):04X} changes its case")
    return table


def _class(chars: list[int]) -> str:
    """A character class of sorted code points, runs as ranges."""
    out, k = [], 0
    while k < len(chars):
        j = k
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        a, b = (f"\\U{x:08x}" for x in (chars[k], chars[j]))
        out.append(a if j == k else f"{a}-{b}")
        k = j + 1
    return "[" + "".join(out) + "]"


_MARK = "[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]"


@lru_cache(maxsize=2)
def transducer(more: tuple[tuple[str, str], ...] = ()):
    """The pattern of what may change, longest match first: line ends, clusters of a changing base with its marks, joiners; and the memo of clusters seen."""
    table = mapping(more)
    changing = _class(sorted(map(ord, table)))
    pattern = re.compile(rf"\r\n?|{changing}+{_MARK}*|.{_MARK}+|[{JOINERS}]", re.S)
    return pattern, table, {}


def _joins(text: str, at: int) -> bool:
    """Whether the joiner at text[at] shapes what stands around it: emoji sequences, letters of Indic and Arabic scripts."""
    before = text[at - 1] if at else ""
    after = text[at + 1] if at + 1 < len(text) else ""
    if not before or not after:
        return False
    b, a = ord(before), ord(after)
    if 0x600 <= b <= 0x8FF and 0x600 <= a <= 0x8FF or unicodedata.combining(before) == 9 or 0x900 <= b <= 0xDFF and 0x900 <= a <= 0xDFF:
        return True
    emoji = lambda c: c >= 0x1F000 or 0x2190 <= c <= 0x2BFF or c == 0xFE0F
    return text[at] == "‍" and emoji(b) and emoji(a)


_PLAIN = re.compile(r"[\x00-\x08\x0e-\x1b\x7f\r]")


def canonical(text: str, more: tuple[tuple[str, str], ...] = ()) -> str:
    """The one form of all texts that look like text. more: look-alikes beside the tables, what confusables gives.

    Widths, ligatures, kinds of space, letter-like signs, look-alike letters, composition of accents and characters that show
    nothing are brought to one form; case, accents, digits, words, punctuation and raised figures stay. A carriage return with or without a line feed is a line feed.
    """
    if text.isascii() and not _PLAIN.search(text):
        return text
    pattern, table, memo = transducer(more)

    def form(m: re.Match) -> str:
        cluster = m.group()
        if cluster in JOINERS:
            return cluster if _joins(text, m.start()) else ""
        out = memo.get(cluster)
        if out is None:
            if cluster[0] == "\r":
                out = "\n"
            else:
                out = "".join(table.get(c, c) for c in unicodedata.normalize("NFC", cluster))
                out = "".join(table.get(c, c) for c in unicodedata.normalize("NFC", out))
            if len(memo) < 200_000:
                memo[cluster] = out
        return out

    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    out = pattern.sub(form, text)
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its text in the one form; a null text stays null, an empty one empty. Repeated rows come out each; other columns are left out."""

    more = confusables(docs.sparkSession)

    @F.arrow_udf("string")
    def to_form(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else canonical(x, more) for x in t.to_pylist()], pa.string())

    return docs.select(F.col(doc_id).alias("doc_id"), to_form(F.col(text)).alias("text"))


def _keys(batches: Iterator[pa.RecordBatch], more: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        memo: dict = {}
        ids, look, exact = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text is None:
                continue
            if text not in memo:
                out = canonical(text, more)
                memo[text] = (_digest(out), _digest(text)) if out.strip() else None
            if memo[text]:
                ids.append(doc)
                look.append(memo[text][0])
                exact.append(memo[text][1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(look, pa.binary()), pa.array(exact, pa.binary())], names=["doc_id", "look", "exact"])


def look_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, look (key of the one form), exact (key of the text) of every text that shows something."""
    more = confusables(docs.sparkSession)
    return spread(docs.select(F.col(doc_id).cast("bigint"), F.col(text))).mapInArrow(lambda batches: _keys(batches, more), "doc_id bigint, look binary, exact binary")


def alike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_a < doc_b: all pairs of documents whose texts differ and look the same.

    Identical texts are no pair; null texts and texts that show nothing are left out. Pairs are found between the different spellings of a look, never between copies,
    and then joined with the documents of each spelling, so that a text with very many copies costs no more than the pairs it has.
    """
    keys = materialise(look_keys(docs, doc_id, text), "looks")
    spellings = keys.select("look", "exact").distinct()
    several = spellings.groupBy("look").agg(F.min("exact").alias("least"), F.max("exact").alias("most")).where("least <> most").select("look")
    members = keys.join(several, "look", "left_semi")
    spelled = spellings.join(several, "look", "left_semi")
    pairs = spelled.select("look", F.col("exact").alias("exact_a")).join(spelled.select("look", F.col("exact").alias("exact_b")), "look").where("exact_a < exact_b")
    a = members.select(F.col("look").alias("look_a"), F.col("exact").alias("exact_a"), F.col("doc_id").alias("a"))
    b = members.select(F.col("look").alias("look_b"), F.col("exact").alias("exact_b"), F.col("doc_id").alias("b"))
    both = pairs.join(a, ["exact_a"]).where("look = look_a").join(b, ["exact_b"]).where("look = look_b")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def alike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of its look), spellings (different texts of that look) of every text that shows something."""
    keys = materialise(look_keys(docs, doc_id, text), "looks")
    per_look = keys.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count_distinct("exact").alias("spellings"))
    return keys.join(per_look, "look").select("doc_id", "class_id", "spellings")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(_documents(spark, sf_dir))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text(_documents(spark, sf_dir))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_classes(_documents(spark, sf_dir))
