"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A document's features are hashed uni- and bigrams of its words and uni- to trigrams of its words' shapes (letter case,
digits, marks; a word that repeats the one before it has a shape of its own), as shares of its words. Training takes at
most MAX_TRAIN labelled documents, those with the smallest hash of doc_id, in PARTS groups that each learn a model in a
task of their own; the models are averaged. Scoring is a sparse dot product over every whole text.

Defined results: a null text has no words and scores the bias alone; without labelled documents every score is 0.5;
labels that are null are ignored, of repeated labels the largest counts, of repeated doc_ids one text is learned from;
a null doc_id is never learned from nor held out; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tokens import Kept, hold, released

BITS = 18
MAX_TRAIN = 8000
PARTS = 8
EPOCHS = 3
SCALE = 8.0
THRESHOLD = 0.3
FOLDS = 5
GROUP_WORDS = 1 << 18


def shape(word: str) -> str:
    """Runs of lower case, upper case and digits as a, A and 0; other characters once a run."""
    out = ""
    for c in word:
        c = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if out[-1:] != c:
            out += c
    return out


def word_code(word: str) -> int:
    return zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape(word).encode())


_codes = Kept(word_code, 100_000)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SALTS = np.arange(8, dtype=np.uint64) * _ODD[1]


def _alone() -> None:
    hold(_codes)


def features(words: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram indices of the words of several documents, and the number of each document's words.

    Row k of the indices is one n-gram kind, column i the n-gram that begins at word i; n-grams that would cross a
    document's end hash what they have.
    """
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    n = len(codes)
    word, kind = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    starts = np.concatenate([[0], ends[:-1]])
    inner = np.ones(n, bool)
    inner[starts[starts < n]] = False
    again = np.zeros(n, bool)
    again[1:] = (word[1:] == word[:-1]) & inner[1:]
    kind = np.where(again, kind + np.uint64(1), kind)

    def after(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if by < n:
            out[:-by] = x[by:]
        for k in range(1, by + 1):
            at = ends[ends >= k] - k
            out[at] = 0
        return out

    kinds = [word, word * _ODD[0] + after(word, 1), kind, kind * _ODD[1] + after(kind, 1), (kind * _ODD[1] + after(kind, 1)) * _ODD[2] + after(kind, 2)]
    rows = np.empty((len(kinds), n), np.int32)
    for k, x in enumerate(kinds):
        rows[k] = ((x * _ODD[0] + _SALTS[k]) * _ODD[2] >> np.uint64(64 - BITS)).astype(np.int32)
    return rows, np.diff(ends, prepend=0)


class Ftrl:
    """FTRL-proximal for logistic loss on sparse rows."""

    def __init__(self, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.z, self.n = np.zeros(dims), np.zeros(dims)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ value) - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Weights (part, at, w) of a model of one group's rows, and a row at -1."""
    found = []
    for row in rows.sort_values(["key", "doc_id"]).itertuples():
        words = (row.text or "").split()
        grams, _ = features(words, np.array([len(words)]))
        at, counts = np.unique(grams, return_counts=True)
        found.append((np.append(at, 1 << BITS), np.append(counts * (SCALE / max(1, len(words))), 1.0), row.label))
    model = Ftrl((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for row in found:
            model.learn(*row)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return pd.DataFrame({"part": key[0], "at": np.append(at, -1), "w": np.append(w[at], 1.0)})


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows are broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> np.ndarray | None:
    """Weights by hash, the bias last; None without labelled documents."""
    rows = training_rows(docs, labels, most).withColumn("key", F.xxhash64("doc_id"))
    found = rows.groupBy(F.pmod("key", F.lit(PARTS)).alias("part")).applyInPandas(_train, "part long, at long, w double")  # most / PARTS rows each
    # PARTS numbers at most are summed for each weight, in the order of their parts, so that reruns agree to the last bit.
    each = F.transform(F.array_sort(F.collect_list(F.struct("part", "w"))), lambda x: x["w"])
    table = found.groupBy("at").agg(F.aggregate(each, F.lit(0.0), lambda a, b: a + b).alias("w")).toPandas()  # at most 2^BITS + 2 rows
    models = table.w[table["at"] == -1].sum()
    if not models:
        return None
    weights = np.zeros((1 << BITS) + 1)
    table = table[table["at"] >= 0]
    weights[table["at"]] = table.w / models
    return weights


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """docs with a column quality_score."""
    held = docs.sparkSession.sparkContext.broadcast(np.zeros((1 << BITS) + 1) if weights is None else weights)  # of fixed size
    names = docs.columns

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(np.float32)
        bias = float(held.value[-1])
        _alone()
        for batch in batches:
            sums = []
            words: list[str] = []
            ends: list[int] = []

            def flush() -> None:
                if ends:
                    found, sizes = features(words, np.array(ends))
                    total = np.concatenate([[0.0], np.cumsum(w[found].sum(0, dtype=np.float64))])
                    stop = np.array(ends)
                    sums.append((total[stop] - total[stop - sizes]) * SCALE / np.maximum(sizes, 1))
                    words.clear()
                    ends.clear()

            for text in batch.column("text"):
                words += (text.as_py() or "").split()
                ends.append(len(words))
                if len(words) > GROUP_WORDS:
                    flush()
            flush()
            scores = sigmoid(np.concatenate([*sums, []]) + bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, "quality_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", F.col("quality_score").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels)).where(F.col("quality_score") >= threshold).drop("quality_score")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    scored = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
