"""Near copies by exact similarity of five-word shingles, with candidates from MinHash bands.

Texts of one shingle set form a class and meet only as one. Each class has BANDS keys of ROWS minima; two classes with
a Jaccard similarity of THRESHOLD share a key with probability 1 - (1 - THRESHOLD ** ROWS) ** BANDS (0.9993), more above
it. Classes of a key are compared on their whole shingle sets, so that no link is below the threshold, and only as far
as earlier links haven't joined them: first the classes of the first band's keys, in blocks of BLOCK; then of a key in
one of the next bands one class of each group so far; then all classes of every key that still has several groups, and
of such keys with more classes than BLOCK all pairs of blocks. The last two rounds alone would find every link; the
first two leave them little. A task returns a spanning forest of its links instead of all pairs.

SimHash segments can't serve here: at this threshold fingerprints differ in up to 11 of 64 bits and more, and radius 11
takes segments of 5 bits, each of which a thirty-second of all texts share.

Defined results: a null text has no words, and texts without words are copies of each other; with fewer than SHINGLE
words the whole text is the shingle; letter case (ASCII) and white space don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tokens import hold, released
from loomspark.operators.components import connected_components
from loomspark.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 24
SEED = 42
BLOCK = 512
#: Bands of the second round.
LEADING = 4
PIECE = 4096


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factor, shift = (rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) for _ in range(2))
    return factor | np.uint64(1), shift


_FACTOR, _SHIFT = _multipliers()


def band_keys(own: np.ndarray) -> list[int]:
    """Keys of a shingle set's bands, as signed numbers; none of an empty set."""
    if not len(own):
        return []
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), PIECE):
        low = np.minimum(low, (own[None, i : i + PIECE] * _FACTOR + _SHIFT).min(1))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(low.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of THRESHOLD or more."""
    small, large = sorted((len(a), len(b)))
    if small < THRESHOLD * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same >= THRESHOLD * (small + large - same)


@released
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold()
    for batch in batches:
        kinds, keys = [], []
        for text in batch.column("text"):
            own = shingles(text.as_py())
            kinds.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
            keys.append(band_keys(own))
        made = [pa.array(kinds, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "kind", "keys"])


class Groups:
    """Groups that links have joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.top(x)] = self.top(y)


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between the groups (root) of classes (root, text) that connect them as all similar pairs would."""
    roots, texts, groups, edges = pdf.root.tolist(), pdf.text.tolist(), Groups(), []
    sets: list[np.ndarray | None] = [None] * len(texts)

    def own(i: int) -> np.ndarray:
        if sets[i] is None:
            sets[i] = shingles(texts[i])
        return sets[i]

    for i, root in enumerate(roots):
        for j in range(i - 1, -1, -1):
            if groups.top(root) != groups.top(roots[j]) and similar(own(i), own(j)):
                groups.join(root, roots[j])
                edges.append((root, roots[j]))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _classes(docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, band, kind, n) of the keys that n classes share, n > 1; (kind, text) of their classes)."""
    classes = marked.groupBy("kind").agg(F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys"))
    held = materialize(classes.select("kind", "text_hash", F.posexplode("keys").alias("band", "key")), "near-keys")
    sizes = held.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("kind")).alias("mark"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    # Keys with the same classes compare the same pairs: the first band's is enough.
    live = sizes.where("n > 1").groupBy("n", "mark", "low", "high").agg(F.min(F.struct("band", "key")).alias("k")).select("k.key", "n")
    shared = materialize(held.join(live, "key").select("key", "band", "kind", "text_hash", "n"), "near-shared")
    wanted = shared.select(F.col("text_hash").alias("hash"), "kind").distinct()
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text").join(wanted, "hash").groupBy("kind").agg(F.min("text").alias("text"))
    return shared.drop("text_hash"), materialize(texts, "near-texts")


def grouped(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(kind, root) of the classes of marked (text_hash, kind, keys) that share keys: root names the group that similar
    classes form."""
    shared, texts = _classes(docs, marked)
    roots = materialize(texts.select("kind", F.col("kind").alias("root")), "near-roots")
    block = lambda n: F.pmod(F.xxhash64("kind"), F.ceil(F.col(n) / BLOCK))

    def open_keys(bands: int) -> DataFrame:
        """(key, kind, root, n) of the keys of the first bands that several groups share."""
        rows = shared.where(F.col("band") < bands).join(roots, "kind")
        several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return materialize(rows.join(several, "key"), "near-open")

    def joined(rows: DataFrame) -> DataFrame:
        """roots after the comparison of rows (key, i, j, kind, root) within each (key, i, j)."""
        met = rows.select("key", "i", "j", "kind", "root").join(texts, "kind")
        edges = materialize(met.groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long"), "near-edges")
        if edges.isEmpty():
            return roots
        step = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("new"))
        return materialize(roots.join(step, "root", "left").select("kind", F.coalesce("new", "root").alias("root")), "near-roots")

    none = F.lit(0).cast("long")
    rows = open_keys(1)
    roots = joined(rows.withColumn("i", block("n")).withColumn("j", none))
    rows = open_keys(LEADING)
    firsts = rows.groupBy("key", "root").agg(F.min("kind").alias("kind"))
    firsts = firsts.join(firsts.groupBy("key").agg(F.count("*").alias("m")), "key")
    roots = joined(firsts.withColumn("i", block("m")).withColumn("j", none))
    rows = open_keys(BANDS)
    roots = joined(rows.withColumn("i", block("n")).withColumn("j", none))
    rows = open_keys(BANDS).where(F.col("n") > BLOCK).withColumn("own", block("n"))
    if not rows.isEmpty():
        blocks = rows.groupBy("key", "own").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        other = blocks.select("key", F.col("own").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
        pairs = blocks.withColumnRenamed("own", "i").join(other, "key").where("i < j and not (low = high and low_j = high_j and low = low_j)")
        pairs = pairs.select("key", "i", "j", F.explode(F.array("i", "j")).alias("own"))
        roots = joined(rows.join(pairs, ["key", "own"]))
    return roots


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root) of every row: root names the group that similar texts, directly or through others, form."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    marked = materialize(rows.mapInArrow(_signatures, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, kind long, keys array<long>"), "near-signatures")
    roots = grouped(docs, marked)
    return marked.join(roots, "kind", "left").select("doc_id", "text_hash", F.coalesce("root", "kind").alias("root"))
