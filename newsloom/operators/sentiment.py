"""Sentiment of texts: a scorer gives three logits, the rest is columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import strip

LABELS = ("positive", "neutral", "negative")
#: Cue words of the default scorer, which needs no model. A parameter, like the scorer itself.
POSITIVE_CUES = ("rose", "jumped", "climbed", "swelled", "recovered", "edged up", "wins", "raised", "doubled", "record")
NEGATIVE_CUES = ("fell", "sank", "eased", "slipped", "narrowed", "contracted", "drifted lower", "cuts", "shelved", "halved")


def occurrences(text: Column, cue: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(cue), F.lit("")))) / len(cue)).cast("int")


def lexicon_logits(text: Column, positive: tuple[str, ...] = POSITIVE_CUES, negative: tuple[str, ...] = NEGATIVE_CUES) -> Column:
    """Logits of positive, neutral, negative of a lower-cased text: counts of cue words, and a constant for neutral."""
    count = lambda cues: sum((occurrences(text, c) for c in cues), F.lit(0)).cast("double")
    return F.array(count(positive), F.lit(1.0), count(negative))


def with_softmax(rows: DataFrame, logits: Column, into: str = "_p") -> DataFrame:
    """rows with the softmax of logits. Each step is a column of its own, so that none is computed again for every element."""
    rows = rows.withColumn("_logits", logits).withColumn("_top", F.array_max("_logits"))
    rows = rows.withColumn("_powers", F.transform("_logits", lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_total", F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x))
    return rows.withColumn(into, F.transform("_powers", lambda x: x / F.col("_total"))).drop("_logits", "_top", "_powers", "_total")


def label_of(scores: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label of the highest score; of equal ones the first."""
    return F.get(F.array(*[F.lit(x) for x in labels]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def scored(rows: DataFrame, logits: Column | None = None, text: str = "text") -> DataFrame:
    """rows with scores{positive, neutral, negative} and sentiment; rows with a blank text are skipped."""
    filled = rows.where(strip(F.col(text)) != "")
    if logits is None:
        filled = filled.withColumn("_low", F.lower(text))
        logits = lexicon_logits(F.col("_low"))
    # the label comes from the logits, whose highest is the highest score: a filter on it then needs no softmax
    labelled = filled.withColumn("_raw", logits).withColumn("sentiment", label_of(F.col("_raw")))
    named = F.struct(*[F.get("_p", F.lit(k)).alias(name) for k, name in enumerate(LABELS)])
    return with_softmax(labelled, F.col("_raw")).withColumn("scores", named).drop("_p", "_low", "_raw")


def scored_by_model(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 16) -> DataFrame:
    """The same with a model: load runs once per worker and gives a function from texts to logits, called with batches of texts.

    A batch that fails gives null logits and its rows are dropped, so that one text doesn't end the job.
    """

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = []
            texts = part.tolist()
            for k in range(0, len(texts), batch):
                try:
                    out += [[float(x) for x in row] for row in model(texts[k : k + batch])]
                except Exception:  # noqa: BLE001
                    out += [None] * len(texts[k : k + batch])
            yield pd.Series(out)

    ready = rows.where(strip(F.col(text)) != "").withColumn("_model", run(F.col(text))).where("_model is not null")
    return scored(ready, F.col("_model"), text).drop("_model")


MOST_MODEL_TOKENS = 512


def token_batch(texts: list[str], most: int = MOST_MODEL_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a batch: words of letters a-z and digits in lower case as hashed ids, cut after `most` of them, padded to the longest text of the batch."""
    rows = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall("[a-z0-9]+", t.lower())[:most]] for t in texts]
    width = max([1, *map(len, rows)])
    ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), bool)
    for k, row in enumerate(rows):
        ids[k, : len(row)], mask[k, : len(row)] = row, True
    return ids, mask


def hashed_model() -> Callable[[list[str]], list[list[float]]]:
    """A classifier without trained weights, which goes the way of one: tokenised batch, look-up of a vector for each id, masked mean, one logit a label.

    The vectors are made from the ids, so that every engine can compute them: it stands in where a model's batches, padding and cutting are tested, not its judgement.
    """

    def forward(texts: list[str]) -> list[list[float]]:
        ids, mask = token_batch(texts)
        vectors = np.stack([(ids // 7919**k) % 1009 / 1009.0 for k in range(len(LABELS))], axis=-1)
        n = np.maximum(mask.sum(axis=1), 1)[:, None]
        return ((vectors * mask[:, :, None]).sum(axis=1) / n * 10).tolist()

    return forward
