"""Language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one. Filters of
several widths run over byte embeddings, each keeps its largest response in the window, and a softmax over those gives
the window's languages; a document's are the mean over its windows by length. Convolutions are sums of table rows, one
table per tap, as embedding and filter are both linear. Training takes every language, of each at most PER_LANGUAGE
documents, fewer where languages are many: TRAIN_DOCS in all, but at least one of each. WINDOWS_EACH windows come from
each document; those with the smallest hash of doc_id are taken.

Defined results: a text that is null or has no letter is `und` with score 0, as is everything if nothing is labelled;
null languages are not learned from; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
PER_LANGUAGE = 400
TRAIN_DOCS = 25_600
WINDOWS_EACH = 3
SPARE = 4
EPOCHS = 6
BATCH = 64
FOLDS, HELD_OUT = 4, 2
SEED = 5
BLOCK = 512
UNKNOWN = "und"


def windows(raw: bytes, size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """(windows, lengths): fixed-length windows of all bytes, zero-padded, and the bytes that each adds."""
    step = size - overlap
    n = max(1, -(-max(0, len(raw) - overlap) // step))
    padded = np.zeros((n - 1) * step + size, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    cut = np.lib.stride_tricks.as_strided(padded, (n, size), (step, 1))
    lengths = np.minimum(step, len(raw) - np.arange(n) * step)
    return cut, np.maximum(lengths, 1)


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": np.zeros((len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages)), "shift": np.zeros(len(WIDTHS) * FILTERS)}
        self.p |= {f"w{w}": rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS}

    def tables(self) -> dict[int, np.ndarray]:
        """Per width the response of each tap to each byte; byte 0, the padding, responds with nothing."""
        return {w: (self.p["embed"] @ self.p[f"w{w}"]).astype(np.float32) for w in WIDTHS}

    @staticmethod
    def responses(cut: np.ndarray, tables: dict[int, np.ndarray]) -> list[np.ndarray]:
        out = []
        for w in WIDTHS:
            n = cut.shape[1] - w + 1
            y = tables[w][0].take(cut[:, :n], axis=0)
            for j in range(1, w):
                y += tables[w][j].take(cut[:, j : j + n], axis=0)
            out.append(y)
        return out

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["shift"], 0) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, cut: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        return self._softmax(np.concatenate([y.max(1) for y in self.responses(cut, tables)], 1))

    def fit(self, cut: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01) -> None:
        """Adam on cross entropy, classes weighted alike; gradients reach the places of the largest responses only."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        weight = len(labels) / k / np.maximum(np.bincount(labels, minlength=k), 1)
        m, v = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                grad = self.gradients(cut[part], labels[part], weight[labels[part]])
                t += 1
                for n, g in grad.items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    self.p[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
        self.p["embed"][0] = 0

    def gradients(self, x: np.ndarray, own: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy of windows x with labels own, by parameter."""
        found = self.responses(x, self.tables())
        tops = [y.argmax(1) for y in found]
        pooled = np.concatenate([y.max(1) for y in found], 1) + self.p["shift"]
        hidden, probs = np.maximum(pooled, 0), self._softmax(pooled - self.p["shift"])
        probs[np.arange(len(own)), own] -= 1
        d = probs * weight[:, None] / len(own)
        grad = {"out": hidden.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = (d @ self.p["out"].T) * (pooled > 0)
        grad["shift"] = dh.sum(0)
        for a, w in enumerate(WIDTHS):
            part, kernel = dh[:, a * FILTERS : (a + 1) * FILTERS], self.p[f"w{w}"]
            grad[f"w{w}"] = np.zeros_like(kernel)
            for j in range(w):
                seen = x[np.arange(len(x))[:, None], tops[a] + j]
                grad[f"w{w}"][j] = np.einsum("bfe,bf->ef", self.p["embed"][seen], part)
                np.add.at(grad["embed"], seen, part[:, :, None] * kernel[j].T[None])
        grad["embed"][0] = 0
        return grad


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, lang, key in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("key").to_pylist()):
            cut, _ = windows(text.as_py().encode())
            at = np.unique(np.linspace(0, len(cut) - 1, min(WINDOWS_EACH, len(cut))).astype(int))
            rows += [{"key": key, "lang": lang, "bytes": cut[i].tobytes()} for i in at]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("lang", pa.string()), ("bytes", pa.binary())]))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame | None:
    """(doc_id, own, key) of the documents to learn from, own being the language: of each the smallest hashes key outside
    the held-out fold, at most TRAIN_DOCS in all or one of each language; None if nothing is labelled."""
    rows = _known(docs).select("doc_id", "lang", F.xxhash64("doc_id").alias("key")).distinct()
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language, as the model has
    if not sizes:
        return None
    per_language = max(1, min(per_language, TRAIN_DOCS // len(sizes)))
    # About SPARE times as many rows as wanted lie below a language's bound, whatever its size, so that no task sorts it whole.
    bounds = [(r["lang"], min(1.0, (SPARE * per_language + 64) / r["n"])) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(bounds, "own string, bound double")
    rows = rows.join(F.broadcast(bounds), F.col("lang") == F.col("own")).where(F.col("key").cast("double") / 2.0**64 + 0.5 <= F.col("bound"))
    chosen = rows.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))).where(F.col("place") <= per_language)
    return chosen.select("doc_id", "own", "key")


def _known(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """A network for the languages of docs outside the held-out fold; None if nothing is labelled."""
    chosen = training_rows(docs, per_language)
    if chosen is None:
        return None
    texts = _known(docs).select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").where("lang = own").groupBy("doc_id", "lang", "key").agg(F.min("text").alias("text"))
    sample = texts.select("text", "lang", "key").mapInArrow(_sample, "key long, lang string, bytes binary").toPandas()
    sample = sample.sort_values(["key", "lang", "bytes"])
    languages = sorted(sample["lang"].unique())
    network = ByteNetwork(languages)
    cut = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW)
    network.fit(cut, np.searchsorted(languages, sample["lang"]))
    return network


def predict(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(network and (network, network.tables()))  # a few tables of fixed size
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if held.value:
                net, tables = held.value
                sums, total = np.zeros((n, len(net.languages))), np.zeros(n)
                cuts: list = []

                def flush() -> None:
                    if cuts:
                        all_cut, all_len = np.concatenate([c for _, c, _ in cuts]), np.concatenate([x for _, _, x in cuts])
                        own = np.repeat([i for i, _, _ in cuts], [len(c) for _, c, _ in cuts])
                        for i in range(0, len(own), BLOCK):
                            np.add.at(sums, own[i : i + BLOCK], net.predict(all_cut[i : i + BLOCK], tables) * all_len[i : i + BLOCK, None])
                        np.add.at(total, own, all_len)
                        cuts.clear()

                held_rows = 0
                for i, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    if text is None or not letter.search(text):
                        continue
                    cuts.append((i, *windows(text.encode())))
                    held_rows += len(cuts[-1][1])
                    if held_rows >= 8 * BLOCK:
                        flush()
                        held_rows = 0
                flush()
                seen = np.flatnonzero(total)
                probs = sums[seen] / total[seen, None]
                best = probs.argmax(1)
                scores[seen] = np.minimum(probs[np.arange(len(seen)), best], 1.0)
                for i, b in zip(seen, best):
                    names[i] = net.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def op5_language(spark, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
