"""Articles to texts for a model: cleaned, and long ones folded into overlapping chunks of whole sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_for_model, estimated_tokens, safe_id, sentences, strip
from newsloom.session import spread

MOST_TOKENS, OVERLAP_WORDS = 400, 12


def prepared(articles: DataFrame) -> DataFrame:
    """Articles with cleaned title and content and full_text, 'title. content'; rows without any text are dropped, null fields are empty, a null source is unknown."""
    title, content = (clean_for_model(F.coalesce(c, F.lit(""))) for c in ("title", "description"))
    staged = spread(articles).withColumns({"_t": title, "_c": content})
    full = strip(F.concat(F.when(F.col("_t") != "", F.concat("_t", F.lit(". "))).otherwise(""), "_c"))
    # a generator keeps the filter on the cleaned text from being pushed below it, where the text would be cleaned a second time
    out = staged.select("*", F.inline(F.array(F.struct(full.alias("full_text"))))).where("full_text <> ''")
    return out.withColumns({"title": F.col("_t"), "content": F.col("_c"), "source": F.coalesce("source", F.lit("unknown")), "published_date": F.coalesce("published", F.lit(""))}).drop("_t", "_c")


def overlap_of(chunk: Column, words: int = OVERLAP_WORDS) -> Column:
    """Its last words, if it has more than so many, else an empty text."""
    parts = F.split(chunk, " ")
    return F.when(F.size(parts) > words, F.array_join(F.slice(parts, -words, words), " ")).otherwise("")


def chunk_texts(text: Column, most_tokens: int = MOST_TOKENS, words: int = OVERLAP_WORDS) -> Column:
    """The chunks of a text in order: the text itself if it has at most most_tokens estimated tokens, else a fold over its sentences.

    A sentence that doesn't fit any more opens a new chunk behind the last words of the one before. Sentences of at most ten characters are left
    out, so that a long text of such sentences gives no chunk; one sentence that is too long stays whole.
    """
    begin = F.struct(F.lit("").alias("cur"), F.lit(0.0).alias("tok"), F.array().cast("array<string>").alias("out"))

    def merge(acc: Column, s: Column) -> Column:
        t = estimated_tokens(s).cast("double")
        full = (acc["tok"] + t > most_tokens) & (acc["cur"] != "")
        lead = overlap_of(acc["cur"], words)
        opened = F.when(lead != "", F.concat(lead, F.lit(" "), s)).otherwise(s)
        longer = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(" "), s)).otherwise(s)
        return F.struct(
            F.when(full, opened).otherwise(longer).alias("cur"),
            F.when(full, estimated_tokens(opened).cast("double")).otherwise(acc["tok"] + t).alias("tok"),
            F.when(full, F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.when(strip(acc["cur"]) != "", F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])

    return F.when(estimated_tokens(text) <= most_tokens, F.array(text)).otherwise(F.aggregate(sentences(text), begin, merge, finish))


def counts(articles: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Of prepared articles that fit most_tokens and of those that don't: how many there are, have chunks, have one chunk, and their chunks."""
    listed = articles.select((estimated_tokens(F.col("full_text")) <= most_tokens).alias("single"), F.size(chunk_texts(F.col("full_text"), most_tokens)).alias("n"))
    return listed.groupBy("single").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("n") >= 1).alias("with_chunks"), F.count_if(F.col("n") == 1).alias("one_chunk"), F.sum("n").alias("chunks"))


def chunks(articles: DataFrame, keys: list[str], most_tokens: int = MOST_TOKENS) -> DataFrame:
    """One row per chunk of prepared articles: keys, chunk_id from 0, total_chunks, text, a readable id and metadata.

    The readable id isn't unique; keys and chunk_id are.
    """
    listed = articles.withColumn("_chunks", chunk_texts(F.col("full_text"), most_tokens))
    rows = listed.select(*keys, "title", "source", "published_date", "link", F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_id", "text"))
    rows = rows.where("text is not null")  # an outer generator, as the inner one would compute the chunks once more to filter by their number
    readable = F.concat_ws("_", safe_id(F.col("source")), F.substring(safe_id(F.col("title")), 1, 50), F.col("chunk_id").cast("string"))
    meta = F.struct("source", "published_date", "title", F.concat_ws("/", (F.col("chunk_id") + 1).cast("string"), F.col("total_chunks").cast("string")).alias("chunk_position"), F.col("link").alias("url"))
    return rows.select(*keys, "chunk_id", "total_chunks", readable.alias("id"), "text", meta.alias("metadata"))
