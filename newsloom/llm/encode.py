"""The whole corpus as ids of a public tokenizer, through a lexicon of its frequent words."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import lexicon, tokens
from newsloom.session import materialise, shared_dir, spread, write_bytes

#: Words of the lexicon: a bound on its size, not on the words that are encoded.
LEXICON_WORDS = 16_384
#: Different words that a worker remembers before it starts afresh.
MEMO_WORDS = 400_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts; repeated texts of a batch are split once."""
    split = tokens.splitter()
    words: Counter = Counter()
    for b in batches:
        texts = Counter(t for t in b.column(0).to_pylist() if t)
        for text, n in texts.items():
            if n == 1:
                words.update(split(text))
            else:
                for w, k in Counter(split(text)).items():
                    words[w] += k * n
        if len(words) > MEMO_WORDS:
            yield _pairs(words)
            words = Counter()
    if words:
        yield _pairs(words)


def _pairs(words: Counter) -> pa.RecordBatch:
    # a word longer than this is a rare run; it is merged where it stands
    kept = {w: n for w, n in words.items() if len(w) <= 40}
    return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])


def build_lexicon(texts: DataFrame, size: int = LEXICON_WORDS, folder: str = tokens.TOKENIZERS) -> str:
    """Counts the words of all texts, compiles the `size` most frequent with their ids, and gives every executor the file.

    Returns the file's name for SparkFiles. Counts are summed per partition before they are shuffled, so that a word held
    by a third of the corpus costs one row a partition.
    """
    spark = texts.sparkSession
    counted = materialise(texts.mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # how many words have at least 2^k occurrences: a few rows, by which only candidates for the lexicon go to the last sort
    scale = sorted(((int(k), int(c)) for k, c in counted.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()), reverse=True)
    least, held = 1, 0
    for k, c in scale:
        least, held = 2**k, held + c
        if held >= size:
            break
    top = [r[0] for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).select("word").collect()]
    enc = tokens.encoding(folder)
    block = lexicon.pack(lexicon.build({w.encode(): enc.encode_ordinary(w) for w in top}))
    path = shared_dir(spark, "lexicon") + ".bin"
    write_bytes(spark, path, block)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class Encoder(dict):
    """A worker's memory of words: word -> place in one growing table of ids. Lexicon words come from the automaton, others are merged exactly."""

    def __init__(self, lex: lexicon.Lexicon, enc):
        self.lex, self.enc, self.split = lex, enc, tokens.splitter()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids: list[np.ndarray] = []
        self.table = np.empty(0, np.int32)
        self.length = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        place = self.lex.find([w.encode() for w in words])
        known = place >= 0
        off = self.lex.offset
        fresh = [None if k else self.enc.encode_ordinary(w) for w, k in zip(words, known.tolist())]
        length = np.where(known, off[np.maximum(place, 0) + 1] - off[np.maximum(place, 0)] if len(off) > 1 else 0, [len(x) if x is not None else 0 for x in fresh]).astype(np.int64)
        flat = [self.lex.ids[off[p] : off[p + 1]] if x is None else np.array(x, np.int32) for p, x in zip(place.tolist(), fresh)]
        base = len(self)
        for k, w in enumerate(words):
            self[w] = base + k
        start = len(self.table) + np.concatenate([[0], np.cumsum(length)[:-1]])
        self.table = np.concatenate([self.table, *flat])
        self.length = np.concatenate([self.length, length])
        self.start = np.concatenate([self.start, start.astype(np.int64)])

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. Null and empty texts have none; equal texts are encoded once."""
        if len(self) > MEMO_WORDS:
            self.reset()
        index: dict = {}
        which = np.fromiter((index.setdefault(t or "", len(index)) for t in texts), np.int64, len(texts))
        pieces: list[str] = []
        ends = []
        for t in index:
            if t:
                pieces += self.split(t)
            ends.append(len(pieces))
        unseen = set(pieces).difference(self)
        if unseen:
            self.learn(list(unseen))
        words = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        del pieces
        flat, per_word = ragged(self.table, self.start[words], self.length[words])
        total = np.concatenate([[0], np.cumsum(per_word)])
        ends = np.array(ends, np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        start, count = total[begins], total[ends] - total[begins]
        if len(index) == len(texts):
            return flat, count
        out, n = ragged(flat, start[which], count[which])
        return out, n


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[start:start+length] one after the other."""
    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    at = np.arange(n, dtype=np.int64) + np.repeat(start - (ends - length), length)
    return values[at], length


_worker: dict = {}


def encoder(name: str, folder: str) -> Encoder:
    """The encoder of this worker process, loaded once."""
    if (name, folder) not in _worker:
        _worker.clear()
        _worker[name, folder] = Encoder(lexicon.Lexicon(SparkFiles.get(name)), tokens.encoding(folder))
    return _worker[name, folder]


#: Texts that are encoded together; bounds a worker's memory.
GROUP_CHARS = 4_000_000


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t or "")
        if chars > GROUP_CHARS:
            yield begin, k + 1
            begin, chars = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = LEXICON_WORDS, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs, by byte_bpe_50k without special tokens.

    A null, an empty text: an empty list. The spelling of a special token is ordinary text. Repeated rows come out each. A
    very long text is encoded whole. Other columns of docs are left out; an empty table gives none. Frequent words take their ids from the
    automaton, all others are merged by the vocabulary's ranks, so that the ids are those of the public tokenizer whatever the lexicon holds.
    """
    docs = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    name = build_lexicon(docs.select("text"), size, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for begin, end in groups(texts):
                flat, count = enc.batch(texts[begin:end])
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
