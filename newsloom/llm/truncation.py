"""Texts cut off before their end: hidden storage limits by recomputed lengths, then the endings themselves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import broadcast_if_small, materialise, spread

#: A length is a hidden limit if so many rows of its source have it, and so many times the mean of the lengths around it.
SPIKE_ROWS, SPIKE_TIMES, AROUND = 20, 8.0, 25

# Signs that a text goes on elsewhere, behind which its last characters stand.
_OMISSION = re.compile(
    r"""\s*(?:…|\.\.\.+|&hellip;|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|\[\s*\+\s*\d+\s*(?:chars?|characters|words?)\s*\]|�+)\s*\Z""", re.I | re.X)  # fmt: skip
_LINK = re.compile(r"\s*(?:[\[(]?\s*(?:continue reading|read more|read on|full story|see more|more)\s*(?:»|›|→|>>|…|\.\.\.)?\s*[\])]?)\s*\Z", re.I)
_CLOSING_TAG = re.compile(r"\s*</[a-zA-Z][a-zA-Z0-9]*\s*>\s*\Z")
_OPEN_MARKUP = re.compile(r"<[/!]?(?:[a-zA-Z][^<>]*)?\Z|&(?:#?[a-zA-Z0-9]{1,10})?\Z")
_SINGLE_TAG = re.compile(r"\s*<(?:br|hr|img)\b[^<>]*>\s*\Z", re.I)
_TERMINATED = re.compile(r"[.!?।。؟]+[\"'”’»)\]}]*\Z")
#: Ends that look like a sentence's but, at a limit, are inside one: a short decimal number or a shortened word.
_OPEN_NUMBER = re.compile(r"(?:₹|\bRs )\d[\d,]*\.\Z|\b(?:Ltd|Rs|Inc|Mr|Mrs|Ms|Dr|vs)\.\Z")
_SEGMENT = re.compile(r"(?:[.!?।][\"'”’»)\]}]*\s+|\n)(?=[^\n]*\Z)")
# Lines that may stand behind a complete text.
_CLOSED_LINE = re.compile(r"(?:[\[(][^\[\]()]*[\])]\s*)+|ENDS?|-?30-|[*#\-_=~]{2,}|[•■◆]", re.I)
_CLOSING_LINE = re.compile(
    r"""(?:—|–|--?)\s*\w.{0,60}                          # byline behind a dash
    |(?:(?:reported|edited|written|writing)\s+)?by\s+(?-i:[A-Z][\w.'-]+)(?:\s+(?-i:[A-Z][\w.'-]+)){0,3}
    |source:.{1,60}
    |(?:\#\w+\s*)+                                        # tags
    |(?:tags?|topics?|keywords?|also\s+read|read|see|related|more|watch|follow|photos?|disclaimer|disclosure|contact|via)\b[\w ]{0,30}:\s.{1,200}
    |(?:[A-Z][\w ]{0,20}:\s*[^\s:]+\s*){2,}               # values of a table in one line
    |(?:[-*•]|\d+[.)])\s+.{1,200}                         # list item
    |.*\bhttps?://\S+                                     # link
    |.*\|.*                                               # table row
    |.*\t.*""", re.X | re.I)  # fmt: skip
_BEFORE_LINK = re.compile(r"(?:…|\.\.\.|[.!?\]]|\n)\s*\Z")
#: Characters of a last line or sentence and of a sign that are inspected; mark-up, white space and repeated signs are followed through the whole text, and all lengths
#: are those of whole texts.
TAIL = 400
BRACKETS = {"]": "[", ")": "("}
VARIANTS = ("characters", "utf8_bytes", "utf16_units", "html_escaped", "html_escaped_all", "json_escaped", "json_ascii", "crlf", "lf")


def lengths(text: str) -> tuple[int, ...]:
    """The text's length as stored and under other encodings, escapings and line ends, in the order of VARIANTS."""
    n = len(text)
    lf, crlf = text.count("\n"), text.count("\r\n")
    quotes = text.count('"')
    html = n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * quotes
    json = n + quotes + text.count("\\") + lf + text.count("\r") + text.count("\t")
    if text.isascii():
        return n, n, n, html, html + 4 * text.count("'"), json, json, n + lf - crlf, n - crlf
    units = len(text.encode("utf-16-le", "replace")) // 2
    ascii_n = len(text.encode("ascii", "ignore"))
    return n, len(text.encode("utf-8", "replace")), units, html, html + 4 * text.count("'"), json, json + 6 * (units - ascii_n) - (n - ascii_n), n + lf - crlf, n - crlf


def strip_signs(text: str) -> tuple[int, bool, bool]:
    """Length of the text without signs of omission, links to the rest and closing mark-up at its end; whether a sign of omission, whether a link was there."""
    omitted, linked = False, False
    body = text.rstrip()
    while body:
        last = body[-1]
        if last == ">" and (at := body.rfind("<")) >= 0 and (_CLOSING_TAG.match(body, at) or _SINGLE_TAG.match(body, at)):
            body = body[:at].rstrip()
            continue
        cut = max(0, len(body) - TAIL)
        if last in BRACKETS:
            cut = max(0, min(cut, body.rfind(BRACKETS[last]) - 1))
        tail = body[cut:]
        if last in "….])�;" and (m := _OMISSION.search(tail)):
            body, omitted = body[: cut + m.start()].rstrip(), True
        elif last in "egytGE»›→>]).…" and (m := _LINK.search(tail)) and (omitted or linked or _BEFORE_LINK.search(tail[: m.start()])):
            body, linked = body[: cut + m.start()].rstrip(), True
        else:
            break
    return len(body), omitted, linked


def is_cut(text: str, at_limit: bool) -> bool:
    """Whether text stops inside a word, a sentence or a piece of mark-up. at_limit: it has a length at which its source cuts."""
    end, omitted, _ = strip_signs(text)
    whole = text[:end].rstrip()
    body = whole[-TAIL:]
    if not body:
        return False
    if _TERMINATED.search(body[-12:]):
        return (at_limit or omitted) and bool(_OPEN_NUMBER.search(body[-16:]))
    if omitted or _OPEN_MARKUP.search(body[-200:]) or (at := whole.rfind("<")) >= 0 and _OPEN_MARKUP.match(whole, at):
        return True
    segment = _SEGMENT.split(body)[-1].strip()
    line = body.rsplit("\n", 1)[-1].strip()
    return not any(form.fullmatch(x) for x in (segment, line) for form in (_CLOSED_LINE, _CLOSING_LINE))


def measures(text: str) -> list[tuple[int, int, int]]:
    """(base, variant, length) of the text as stored and, where signs of omission close it, without them."""
    end, omitted, linked = strip_signs(text)
    out = [(0, v, n) for v, n in enumerate(lengths(text))]
    if omitted or linked:
        out += [(1, v, n) for v, n in enumerate(lengths(text[:end]))]
    return out


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for key in measures(text):
                counts[source, *key] += 1
    if counts:
        source, base, variant, n = zip(*counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(source, pa.string()), pa.array(base, pa.int32()), pa.array(variant, pa.int32()), pa.array(n, pa.int64()), pa.array(counts.values(), pa.int64()),
        ], names=["source", "base", "variant", "length", "n"])


def hidden_limits(rows: DataFrame, text: str, source: str) -> DataFrame:
    """source, base (0: as stored, 1: without signs of omission), variant, length, n: the lengths at which a source's texts pile up."""
    filled = rows.where(F.trim(text) != "").select(F.col(source).alias("source"), F.col(text).alias("text"))
    counts = spread(filled).mapInArrow(_histogram, "source string, base int, variant int, length bigint, n bigint")
    summed = counts.groupBy("source", "base", "variant", "length").agg(F.sum("n").alias("n"))
    around = W.partitionBy("source", "base", "variant").orderBy("length").rangeBetween(-AROUND, AROUND)
    usual = (F.sum("n").over(around) - F.col("n")) / (2 * AROUND)
    return summed.where(f"n >= {SPIKE_ROWS // 4}").withColumn("usual", usual).where((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= SPIKE_TIMES * F.greatest("usual", F.lit(1.0))))


def find_cut(rows: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """row_id, source, cut, at_limit, limit_only of every row: whether its text was cut off before its end, whether it has a length at which its source cuts, and whether that alone made it cut.

    Null and blank texts, stubs and complete texts that close with a byline, tags, link, list or table line aren't cut. A null source is a source of its own.
    Repeated rows come out each; other columns are left out; an empty table gives none. Lengths of all rows are counted per
    source and encoding; a row at one of its source's limits needs less of an ending to count as cut.
    """
    limits = materialise(hidden_limits(rows, text, source), "limits")
    per_source = limits.groupBy("source").agg(F.collect_list(F.struct("base", "variant", "length")).alias("limits"))  # at most a row in SPIKE_ROWS makes one
    kind = rows.select(row_id).schema[0].dataType.simpleString()
    keyed = spread(rows.select(F.col(row_id).alias("id"), F.col(source).alias("row_source"), F.col(text).alias("text")))
    joined = keyed.join(broadcast_if_small(per_source), F.col("row_source").eqNullSafe(F.col("source")), "left").select("id", "row_source", "text", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            cut, at, only = [], [], []
            for t, src, raw in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                if t is None:
                    for out in (cut, at, only):
                        out.append(False)
                    continue
                if src not in memo:
                    memo[src] = {(x["base"], x["variant"], x["length"]) for x in raw.as_py() or ()}
                known = memo[src]
                at.append(bool(known) and any(x in known for x in measures(t)))
                cut.append(is_cut(t, at[-1]))
                only.append(at[-1] and cut[-1] and not is_cut(t, False))
            columns = [b.column(0), b.column(1), *(pa.array(x, pa.bool_()) for x in (cut, at, only))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "source", "cut", "at_limit", "limit_only"])

    told = joined.mapInArrow(run, f"id {kind}, source string, cut boolean, at_limit boolean, limit_only boolean")
    return told.select(F.col("id").alias(row_id), F.col("source").alias(source), "cut", "at_limit", "limit_only")


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_cut(spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("id", "article_content", "source_name"), "id", "article_content", "source_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _news(spark, sf_dir).where("cut").select("id")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source_name cuts: rows, cut rows and their share; a null source is a row of its own."""
    per = _news(spark, sf_dir).groupBy("source_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cut").alias("n_cut"))
    return per.withColumn("cut_share", F.col("n_cut") / F.col("n_rows"))


def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each step decides: rows at one of their source's limits and others, how many of them are cut, and how many only the limit tells from whole ones."""
    return _news(spark, sf_dir).groupBy("at_limit").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cut").alias("n_cut"), F.count_if("limit_only").alias("n_limit_only"))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden limits of each source, by the encoding under which its texts have one length."""
    found = hidden_limits(spark.read.parquet(f"{sf_dir}/news_cache.parquet").select("article_content", "source_name"), "article_content", "source_name")
    name = F.get(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant"))
    return found.select(F.col("source").alias("source_name"), name.alias("encoding"), (F.col("base") == 1).alias("without_signs"), "length", "n")
