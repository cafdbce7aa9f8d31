"""Oversized texts cut into overlapping pieces at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import spread

LIMIT, OVERLAP_WORDS = 1600, 12
_BLANK = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_END = re.compile(r"[.!?]+[\"'”’»)\]}]*(?=\s)")
_RUN = re.compile(r"\S+")


def boundaries(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Where a piece may end: after blank lines, after sentences, before words; and where words begin."""
    paragraphs = [m.end() for m in _BLANK.finditer(text) if m.end() < len(text)]
    begins = [m.start() for m in _RUN.finditer(text)]
    sentences = []
    for m in _END.finditer(text):
        k = bisect_left(begins, m.end())
        if k < len(begins):
            sentences.append(begins[k])
    return paragraphs, sentences, begins[1:] if begins and begins[0] == 0 else begins, begins


KINDS = ("paragraph", "sentence", "word", "none")


def pieces(text: str, limit: int = LIMIT, words: int = OVERLAP_WORDS) -> tuple[list[tuple[int, int, int, str]], str]:
    """(start with overlap, start, end, boundary at the end) of each piece, and the boundary that suffices; the stretches start..end are the text without gap.

    Each range that is too long with its overlap is cut at its strongest boundary, of those at the one nearest to its middle: a blank line if there is one inside, else
    the end of a sentence, else the beginning of a word, and only inside a run without white space in the run. The overlap is the last words of the piece
    before, fewer where they would take more than half the limit.

    The boundary that suffices is the weakest at which a range had to be cut that was too long by itself, without overlap and outer white space: ranges
    are whole paragraphs until one alone is too long, then whole sentences, then whole words. It is 'paragraph' if there was none weaker.
    """
    paragraphs, sentences, starts, begins = boundaries(text)
    kinds = {**dict.fromkeys(starts, "word"), **dict.fromkeys(sentences, "sentence"), **dict.fromkeys(paragraphs, "paragraph"), len(text): "end"}

    def overlap(a: int) -> int:
        if not a:
            return 0
        k = bisect_left(begins, a)
        for j in range(max(0, k - words), k):
            if a - begins[j] <= limit // 2:
                return begins[j]
        return a

    def nearest(places: list[int], lo: int, hi: int, mid: int) -> int | None:
        i, j = bisect_left(places, lo), bisect_left(places, hi)
        if i >= j:
            return None
        k = bisect_left(places, mid, i, j)
        return min(places[max(i, k - 1) : min(j, k + 1)], key=lambda p: abs(p - mid))

    out, stack, weakest = [], [(0, len(text))], 0
    while stack:
        a, b = stack.pop()
        if b - overlap(a) <= limit:
            out.append((overlap(a), a, b, kinds.get(b, "none")))
            continue
        mid = (a + b) // 2
        for kind, places in enumerate((paragraphs, sentences, starts)):
            if (cut := nearest(places, a + 1, b, mid)) is not None:
                break
        else:
            kind, cut = 3, mid
            while cut > a + 1 and (unicodedata.category(text[cut])[0] == "M" or "‍" in text[cut - 1 : cut + 1]):
                cut -= 1
        if kind > weakest and len(text[a:b].strip()) > limit:
            weakest = kind
        stack += [(cut, b), (a, cut)]
    return out, KINDS[weakest]


def split(rows: DataFrame, row_id: str, text: str, limit: int = LIMIT, words: int = OVERLAP_WORDS) -> DataFrame:
    """row_id, piece (from 0), start, overlap (characters repeated), boundary at the end, suffices, content, for each row whose text is longer than limit.

    suffices, the same for all pieces of a row, is the weakest boundary that the bisection needed for its length alone (see pieces).

    start counts code points of the text, behind the overlap. Null and shorter texts give no rows; repeated rows come out each;
    other columns are left out. Pieces have at most limit characters, overlap included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (key, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                cut, enough = pieces(t, limit, words)
                n = len(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * n, b.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array([x[1] for x in cut], pa.int32()),
                    pa.array([x[1] - x[0] for x in cut], pa.int32()), pa.array([x[3] for x in cut], pa.string()), pa.array([enough] * n, pa.string()), pa.array([t[x[0] : x[2]] for x in cut], pa.string()),
                ], names=["id", "piece", "start", "overlap", "boundary", "suffices", "content"])

    kind = rows.select(row_id).schema[0].dataType.simpleString()
    long = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    return spread(long).mapInArrow(run, f"id {kind}, piece int, start int, overlap int, boundary string, suffices string, content string").withColumnRenamed("id", row_id)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "article_content"), "id", "article_content")


def p6_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each row are numbered without gap, within the limit, repeat what stands before them, and give the text again without their overlaps."""
    own = F.struct("piece", "start", "overlap", "content")
    per = p6_pieces(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    before = lambda x: F.get("p", x["piece"] - 1)
    repeats = F.forall("p", lambda x: (x["piece"] == 0) & (x["overlap"] == 0) | (x["piece"] > 0) & F.endswith(before(x)["content"], F.substring(x["content"], F.lit(1), x["overlap"])))
    whole = F.array_join(F.transform("p", lambda x: F.substring(x["content"], x["overlap"] + 1, F.length(x["content"]))), "")
    return per.select(
        "id", F.md5(whole).alias("text_md5"), F.forall("p", lambda x: F.length(x["content"]) <= LIMIT).alias("within"), repeats.alias("repeats"),
        (F.transform("p", lambda x: x["piece"]) == F.sequence(F.lit(0), F.size("p") - 1)).alias("numbered"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("piece = 0").select("id", F.col("suffices").alias("boundary"))
