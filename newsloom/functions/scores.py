"""How much an article is about a company, by substrings, as columns without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import STOP_WORDS, squeeze, strip, without_suffix
from newsloom.session import spread

# Terms that make a text business news, and terms that make it something else.
BUSINESS = ("revenue", "profit", "loss", "earnings", "shares", "stock", "market", "business", "company", "financial", "investment", "growth", "results")
IRRELEVANT = ("weather", "rainfall", "temperature", "sports", "cricket", "football", "movie", "film", "celebrity", "entertainment", "recipe", "cooking")
# Financial keywords by weight.
KEYWORDS = {
    3: ("earnings", "results", "profit", "loss", "revenue", "turnover", "quarterly", "annual", "financial", "performance", "growth",
        "dividend", "bonus", "split", "ipo", "listing", "merger", "acquisition", "takeover", "buyback", "rights issue"),
    2: ("shares", "stock", "market", "trading", "volume", "price", "valuation", "investment", "investor", "fund", "portfolio",
        "analyst", "rating", "target", "recommendation", "upgrade", "downgrade", "outlook", "forecast", "guidance", "expansion"),
    1: ("company", "business", "corporate", "management", "board", "director", "ceo", "chairman", "announcement", "news",
        "update", "launch", "product", "service", "contract", "agreement", "deal", "partnership", "collaboration"),
}


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of terms is a substring: one pattern, one pass."""
    return text.rlike("|".join(terms))


def has(text: Column, term: Column) -> Column:
    """Whether a term that isn't empty is a substring of text."""
    return (term != "") & F.contains(text, term)


def prepared(rows: DataFrame, title: Column, description: Column, name: Column, ticker: Column) -> DataFrame:
    """rows with the columns that the scores below read: lower-cased texts and names, each computed once.

    Null titles, descriptions, names, tickers count as empty.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    base = spread(rows).withColumns({"_title": low(title), "_description": low(description), "_whole": low(name), "_short": F.lower(without_suffix(F.coalesce(name, F.lit("")))), "_ticker": low(ticker)})
    return base.withColumns({"_text": F.concat("_title", F.lit(" "), "_description"), "_words": F.split(squeeze(F.col("_short")), " ")})


def _has(term: str, text: str = "_text") -> Column:
    return has(F.col(text), F.col(term))


def simple_company_match() -> Column:
    """1 for the whole name, 0.8 without its suffix, 0.3 for a first word of more than three letters, else 0."""
    first = F.get(F.split("_short", " "), F.lit(0))
    return F.when(_has("_whole"), 1.0).when(_has("_short"), 0.8).when((F.length(first) > 3) & has(F.col("_text"), first), 0.3).otherwise(0.0)


def relevance() -> Column:
    """The permissive score: 0.8 for the ticker, 0.6 of the name match, 0.1 for business terms, 0.05 if not obviously something else; at most 1.

    A text with the ticker has at least 0.1, one with the whole name at least 0.08; a blank text has 0.
    """
    text = F.col("_text")
    score = F.when(_has("_ticker"), 0.8).otherwise(0.0) + simple_company_match() * 0.6 + F.when(any_of(text, BUSINESS), 0.1).otherwise(0.0) + F.when(~any_of(text, IRRELEVANT), 0.05).otherwise(0.0)
    floor = F.when(_has("_ticker"), 0.1).when(_has("_whole"), 0.08).otherwise(0.0)
    return F.when(strip(text) == "", 0.0).otherwise(F.least(F.lit(1.0), F.greatest(score, floor)))


def boosted(score: Column, text: Column, terms: Column, by: float = 0.25) -> Column:
    """The score, raised where one of the search terms is a substring of the lower-cased text; at most 1."""
    return F.when(F.exists(terms, lambda t: F.contains(text, F.lower(t))), F.least(F.lit(1.0), score + by)).otherwise(score)


def company_name_score() -> Column:
    """1 for the whole name, 0.8 without suffix, else 0.5 for the first two words and up to 0.3 for the share of its significant words; at most 1."""
    text, words = F.col("_text"), F.col("_words")
    two = F.array_join(F.slice(words, 1, 2), " ")
    significant = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))
    share = F.coalesce(F.try_divide(F.size(F.filter(significant, lambda w: F.contains(text, w))), F.size(significant)), F.lit(0.0))
    part = F.when((F.size(words) >= 2) & F.contains(text, two), 0.5).otherwise(0.0) + share * 0.3
    return F.least(F.lit(1.0), F.when(_has("_whole"), 1.0).when(_has("_short"), 0.8).otherwise(part))


def keyword_score() -> Column:
    """Shares of the keyword lists that occur, weighted 3, 2, 1, over the sum of weights."""
    total = F.lit(0.0)
    for weight, words in KEYWORDS.items():
        found = F.lit(0)
        for w in words:
            found = found + F.contains("_text", F.lit(w)).cast("int")
        total = total + found / len(words) * weight
    return total / sum(KEYWORDS)


def context_score() -> Column:
    """0.6 for the ticker or 0.4 for the name in the title, 0.3 or 0.2 in the description; at most 1."""
    t = F.when(_has("_ticker", "_title"), 0.6).when(_has("_whole", "_title"), 0.4).otherwise(0.0)
    d = F.when(_has("_ticker", "_description"), 0.3).when(_has("_whole", "_description"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), t + d)


def weighted_relevance() -> Column:
    """The weighted score: 0.4 ticker, 0.3 name, 0.2 keywords, 0.1 context; at most 1; 0 without a company name or text."""
    score = F.when(_has("_ticker"), 0.4).otherwise(0.0) + company_name_score() * 0.3 + keyword_score() * 0.2 + context_score() * 0.1
    return F.when((F.col("_whole") == "") | (strip(F.col("_text")) == ""), 0.0).otherwise(F.least(F.lit(1.0), score))


def identifiers_found(text: Column, ticker: Column, name: Column, terms: Column | None = None) -> Column:
    """Tagged identifiers that occur in the lower-cased text: symbol:X, company:Y, and search_term:Z for each of terms in their order."""
    found = F.array_compact(F.array(F.when(has(text, F.lower(ticker)), F.concat(F.lit("symbol:"), ticker)), F.when(has(text, F.lower(name)), F.concat(F.lit("company:"), name))))
    if terms is None:
        return found
    hit = F.filter(terms, lambda t: has(text, F.lower(t)))
    return F.concat(found, F.transform(hit, lambda t: F.concat(F.lit("search_term:"), t)))


def matched_terms(text: Column, terms: Column) -> Column:
    """The terms, sorted, of which every word occurs in the lower-cased text; a term that occurs as a whole is among them."""
    hit = lambda t: F.forall(F.split(F.lower(t), " +"), lambda w: F.contains(text, w))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: (t != "") & hit(t))))


def filter_stats(spark: SparkSession) -> DataFrame:
    """What each version of the filter goes by: a row for each, with its threshold, limits, keywords and stop words."""
    keywords = sum(map(len, KEYWORDS.values()))
    rows = [(1, 0.05, 50, 30, 0, len(STOP_WORDS)), (0, 0.2, 50, 7, keywords, len(STOP_WORDS))]
    return spark.createDataFrame(rows, "version int, relevance_threshold double, max_articles int, max_days int, total_keywords int, stop_words int")
