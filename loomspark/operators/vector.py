"""Cosine search and joins: Spark deals out groups of vectors, each task multiplies one pair of bounded blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.session import materialize

#: Rows of a group at most and, unless there are fewer, at least.
GROUP_ROWS, LEAST_ROWS = 16_384, 1024
TINY = 1e-12


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norm > TINY, m / np.maximum(norm, TINY), 0.0)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def first(scored: DataFrame, k: int | None, column: str) -> DataFrame:
    """The k highest rows of each qid (all if None) with rank from 0, ties to the smaller doc_id. The limit is on row_number()
    itself, so that Spark keeps k rows of each qid before it shuffles."""
    order = W.partitionBy("qid").orderBy(F.desc(F.round(column, 9)), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).withColumn("rank", F.col("rank").cast("long") - 1)


#: Columns of which only the largest is looked at first, and what rounding to nine places may move.
STRIPE, ROUNDED = 64, 1e-8


def nearest_columns(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k highest entries, rounded to nine places, ties to the smaller column; -inf is none. Only
    entries that reach the kth highest of the stripes' largest are sorted: the kth highest of all is no lower."""
    stripes = sims.shape[1] // STRIPE
    if stripes >= max(4, k):
        tops = sims[:, : stripes * STRIPE].reshape(len(sims), stripes, STRIPE).max(2)
        i, j = np.nonzero(sims >= np.maximum(np.partition(tops, -k, axis=1)[:, -k] - ROUNDED, -2.0)[:, None])
    else:
        i, j = np.nonzero(sims > -np.inf)
    order = np.lexsort((j, -np.round(sims[i, j], 9), i))
    i, j = i[order], j[order]
    start = np.searchsorted(i, np.arange(len(sims)))
    keep = np.arange(len(i)) - start[i] < k
    return i[keep], j[keep]


def best_of(q: pd.DataFrame, v: pd.DataFrame, k: int, threshold: float | None, skip_self: bool) -> pd.DataFrame:
    """(qid, doc_id, sim) of the k nearest of a block of vectors for each of a block of queries; a document's best vector counts."""
    out = [pd.DataFrame({"qid": q["qid"][:0] if "qid" in q else [], "doc_id": v["doc_id"][:0] if "doc_id" in v else [], "sim": np.zeros(0)})]
    if len(q) and len(v):
        v = v.sort_values("doc_id")
        ids, m, qm = v.doc_id.to_numpy(), unit(v.vec), unit(q.qvec)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids = ids[first]
        for at in range(0, len(q), 512):
            sims = qm[at : at + 512] @ m.T
            sims = sims if len(first) == len(m) else np.maximum.reduceat(sims, first, axis=1)
            own = q.qid.to_numpy()[at : at + 512]
            i, j = nearest_columns(sims, k + skip_self)
            best, keep = sims[i, j], np.abs(qm[at : at + 512]).any(1)[i]
            if skip_self:
                keep &= ids[j] != own[i]
            if threshold is not None:
                keep &= best >= threshold
            out.append(pd.DataFrame({"qid": own[i][keep], "doc_id": ids[j][keep], "sim": best[keep]}))
    return pd.concat(out)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, skip_self: bool = False) -> DataFrame:
    """(qid, doc_id, sim, rank) of each query's k most similar vectors, rank from 0; ties go to the smaller doc_id.

    vectors has (doc_id, vec), queries (qid, qvec); of several vectors of a document (its chunks) the nearest counts.
    Zero queries find nothing; null vectors take no part. Queries go to
    every group of vectors in slabs of GROUP_ROWS, vectors to every slab; each pair of blocks keeps k per query.
    """
    vectors, queries = vectors.where("vec is not null"), queries.where("qvec is not null")
    n = vectors.count()
    groups, slabs = max(n // GROUP_ROWS + 1, min(_partitions(vectors), n // LEAST_ROWS + 1)), queries.count() // GROUP_ROWS + 1
    q_kind, v_kind = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["doc_id"]

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return best_of(q, v, k, threshold, skip_self)

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("qid", "qvec", F.pmod(F.xxhash64("qid"), F.lit(slabs)).alias("slab"), every(groups).alias("group"))
    right = vectors.select("doc_id", "vec", every(slabs).alias("slab"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"))
    found = left.groupBy("group", "slab").cogroup(right.groupBy("group", "slab")).applyInPandas(search, f"qid {q_kind}, doc_id {v_kind}, sim double")
    return first(found, k, "sim")


def mean_vectors(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, vec): the mean of each key's vectors, those of a document's chunks, as doubles; nulls take no part."""
    rows = vectors.where("vec is not null").groupBy(key).agg(F.collect_list(F.transform("vec", lambda x: x.cast("double"))).alias("all"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), add)
    return rows.select(key, F.transform(total, lambda x: x / F.size("all")).alias("vec"))


def similar_pairs(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, class_id) puts equal vectors under their smallest doc_id; pairs (a, b, sim)
    are classes a < b with sim of threshold or more. Blocks of classes meet pairwise, so that no pair is lost."""
    members = materialize(vectors.where("vec is not null").select("doc_id", "vec", F.xxhash64("vec").alias("h")), "vectors")
    classes = materialize(members.groupBy("h", "vec").agg(F.min("doc_id").alias("class_id")), "classes")
    n = classes.count() // GROUP_ROWS + max(2, int(_partitions(vectors) ** 0.5))
    rows = classes.select("class_id", "vec", F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int").alias("own"))
    left = rows.select("class_id", "vec", F.col("own").alias("i"), F.explode(F.sequence("own", F.lit(n - 1))).alias("j"))
    right = rows.select(F.col("class_id").alias("b_id"), F.col("vec").alias("b_vec"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})]
        if len(a) and len(b):
            ia, ib, mb = a.class_id.to_numpy(), b.b_id.to_numpy(), unit(b.b_vec)
            same = a.i.iloc[0] == a.j.iloc[0]
            for s in range(0, len(a), 512):
                sims = unit(a.vec.iloc[s : s + 512]) @ mb.T
                x, y = np.nonzero(sims >= threshold)
                p, q = ia[s : s + 512][x], ib[y]
                keep = p < q if same else p != q
                out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "sim": sims[x, y][keep]}))
        return pd.concat(out)

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, "a long, b long, sim double")
    own = members.join(classes.select("h", F.col("vec").alias("c_vec"), "class_id"), "h").where("vec = c_vec").select("doc_id", "class_id")
    return own, pairs


def without_near(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Rows with no row of smaller doc_id at similarity of threshold or more."""
    own, pairs = similar_pairs(vectors, threshold)
    first = own.where("doc_id = class_id").select("doc_id")
    return vectors.join(first, "doc_id", "left_semi").join(pairs.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")


def without_near_greedy(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """As if rows came in doc_id order and each were dropped if a kept one is near: rounds that keep what has no open
    smaller neighbour and drop what has a kept one."""
    own, pairs = similar_pairs(vectors, threshold)
    pairs = materialize(pairs.select("a", "b"), "near")
    state = materialize(own.where("doc_id = class_id").select("doc_id"), "open")
    kept = None
    while not state.isEmpty():
        live = pairs.join(state.select(F.col("doc_id").alias("a")), "a", "left_semi").join(state.select(F.col("doc_id").alias("b")), "b", "left_semi")
        fresh = materialize(state.join(live.select(F.col("b").alias("doc_id")), "doc_id", "left_anti"), "kept")
        near = pairs.join(fresh.select(F.col("doc_id").alias("a")), "a", "left_semi").select(F.col("b").alias("doc_id"))
        state = materialize(state.join(fresh, "doc_id", "left_anti").join(near, "doc_id", "left_anti"), "open")
        kept = fresh if kept is None else kept.union(fresh)
    return vectors.join(kept, "doc_id", "left_semi") if kept is not None else vectors.limit(0)


def hash_embed(terms: str | Column, dims: int = 64) -> Column:
    """Deterministic embedding of an array of terms: signed feature hashing, of unit length."""

    def one(words) -> np.ndarray:
        out = np.zeros(dims)
        for w in words:
            h = zlib.crc32(w.encode())
            out[h % dims] += 1.0 if h >> 31 else -1.0
        return (out / max(np.linalg.norm(out), TINY)).astype(np.float32)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield series.map(one, na_action="ignore")

    return F.pandas_udf(run, "array<float>")(terms)
