"""Text functions as columns: all of them stay in the JVM unless their docstring says otherwise.

White space and letters are those of Unicode. Null gives null unless stated.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters, spelled so that Java and RE2 read the same set.
WS = r"[\t-\r \x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_OR_WS = r"[^\p{L}\p{N}_\t-\r \x{85}\p{Z}]"

# Legal forms at the end of company names, in the order in which they are tried.
SUFFIXES = (" Ltd", " Limited", " Pvt", " Private", " Company", " Corp", " Corporation", " Inc", " Incorporated")
# Words that say nothing in a headline.
STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be",
    "have", "has", "had", "will", "would", "could", "should", "a", "an", "this", "that", "these", "those",
    "ltd", "limited", "pvt", "private", "company", "corp", "corporation", "inc",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, rf"{WS}+", " ")


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def clean_query(c: Column) -> Column:
    """A typed search text: stripped, squeezed, without signs other than - and ., upper case."""
    return F.upper(F.regexp_replace(squeeze(strip(c)), rf"[^a-zA-Z0-9\-.\t-\r \x{{85}}\p{{Z}}]", ""))


def like_literal(c: Column) -> Column:
    """The text as a LIKE pattern that matches only itself."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def highlight(text: Column, term: Column) -> Column:
    """Each match of term in text, whatever its case, between double asterisks. An empty term changes nothing."""
    pattern = F.concat(F.lit("(?i)("), F.regexp_replace(term, r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(")"))
    return F.when(term == "", text).otherwise(F.regexp_replace(text, pattern, F.lit("**$1**")))


def without_suffix(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The company name without the first of suffixes, in their order, that ends it."""
    name = strip(name)
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s), strip(F.substring(name, F.lit(1), F.length(name) - len(s)))).otherwise(out)
    return out


def replace_all_suffixes(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The name with every suffix removed wherever it stands, one after the other in their order."""
    for s in suffixes:
        name = F.replace(name, F.lit(s), F.lit(""))
    return strip(name)


def search_terms(symbol: Column, name: Column) -> Column:
    """symbol, name, cleaned name, and its first two words, each once, in this order; empty ones left out."""
    cleaned = replace_all_suffixes(name)
    words = F.split(squeeze(cleaned), " ")
    two = F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))
    return F.array_distinct(F.filter(F.array(symbol, name, cleaned, two), lambda t: t.isNotNull() & (t != "")))


def clean_for_model(c: Column) -> Column:
    """Without tags, white space squeezed, currency signs before numbers spelled out, stripped."""
    c = squeeze(drop_tags(c))
    c = F.regexp_replace(c, rf"₹{WS}*([0-9]+)", "INR $1")
    return strip(F.regexp_replace(c, rf"\${WS}*([0-9]+)", "USD $1"))


def clean_for_training(c: Column) -> Column:
    """White space squeezed, then without tags, stripped; null gives an empty text."""
    return strip(drop_tags(squeeze(F.coalesce(c, F.lit("")))))


def clean_for_filter(c: Column) -> Column:
    """Compatibility-decomposed, stripped, squeezed, then without tags. The decomposition runs in Arrow batches, as Spark has no such function."""

    @F.arrow_udf("string")
    def nfkd(x: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in x.to_pylist()], pa.string())

    return drop_tags(squeeze(strip(nfkd(c))))


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: scripts and styles dropped, pieces stripped and joined by one space, entities read. Parsed in Arrow batches."""

    @F.arrow_udf("string")
    def read(x: pa.Array) -> pa.Array:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.pieces, self.skipping = [], 0

            def handle_starttag(self, tag, attrs):
                self.skipping += tag in ("script", "style")

            def handle_endtag(self, tag):
                self.skipping -= tag in ("script", "style") and self.skipping > 0

            def handle_data(self, data):
                if not self.skipping and data.strip():
                    self.pieces.append(data.strip())

        def text(t: str) -> str:
            r = Reader()
            r.feed(t)
            r.close()
            return " ".join(r.pieces)

        return pa.array([None if t is None else text(t) for t in x.to_pylist()], pa.string())

    return read(c)


def headline_words(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of a headline that say something: lower case, signs as gaps, more than two characters, no stop words."""
    words = F.split(squeeze(strip(F.regexp_replace(F.lower(c), NOT_WORD_OR_WS, " "))), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def clean_url(c: Column) -> Column:
    """Without tracking parameters, closing slashes and number signs; lower case, stripped."""
    c = F.regexp_replace(c, r"[?&](utm_|ref=|source=|campaign=)[^&]*", "")
    return strip(F.lower(F.regexp_replace(c, r"[/#]+$", "")))


def article_hash(title: Column, description: Column) -> Column:
    """md5 of the lower-cased title and the first 200 characters of the description."""
    return F.md5(F.lower(F.concat(title, F.lit("|"), F.substring(description, 1, 200))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union of two arrays that both have; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def sentences(c: Column) -> Column:
    """Sentences of more than ten characters: split behind . ! ? before white space and a capital letter."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){WS}+(?=[A-Z])"), strip), lambda s: F.length(s) > 10)


def safe_id(c: Column) -> Column:
    """Every character that is no letter, digit, underscore or hyphen becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "_")


def estimated_tokens(c: Column) -> Column:
    return F.length(c) / 4


def unfence(c: Column) -> Column:
    """A model's answer without code fences, and without any of the letters j, s, o, n that lead it."""
    c = F.regexp_replace(strip(c), r"\A```(json)?", "")
    c = strip(F.regexp_replace(strip(c), r"```\z", ""))
    return strip(F.ltrim(c, F.lit("json")))


def mask(c: Column, secret: Column) -> Column:
    return F.when(secret == "", c).otherwise(F.replace(c, secret, F.lit("***")))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Each {NAME} of the template replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
