"""Vectors in cells around centroids: exact and approximate cosine search that leaves out cells too far away.

Centroids come from a bounded sample; every vector is in the cell of its nearest one. A cell's radius is the largest angle
between its centroid and a member. Angles obey the triangle inequality, so no member of a cell is nearer to a query than the
angle to the centroid less the radius. A query first meets its nearest cells that hold k vectors, which gives a floor, and
then the cells whose bound reaches it: what is left out can't be among the k. Cells of any size are many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.vector import GROUP_ROWS, LEAST_ROWS, best_of, first, nearest_columns, unit
from loomspark.session import materialize

#: Vectors of the sample that centroids are fitted to, rounds of fitting, cells at most, and bytes of their centroids at most.
SAMPLE, ROUNDS, MOST_CELLS, MOST_BYTES = 20_000, 8, 4096, 8 << 20
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """centroids (one row each, unit length), radii and sizes by cell; vectors (doc_id, vec, cell, part) as a table."""

    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    vectors: DataFrame


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by spherical k-means from evenly spread rows of the sample, which is in the order of a hash."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def cell_index(vectors: DataFrame, cells: int | None = None) -> Cells:
    """Index of vectors (doc_id, vec), all of one length; nulls take no part, zero vectors are near nothing. As many cells
    as the square root of the number of vectors, within MOST_CELLS and MOST_BYTES, if not given."""
    rows = vectors.where("vec is not null").select("doc_id", "vec")
    kind = dict(rows.dtypes)["doc_id"]
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("doc_id", "vec")).limit(SAMPLE).toPandas()
    if not n:
        return Cells(np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), rows.withColumn("cell", F.lit(0)).withColumn("part", F.lit(0)))
    points = unit(sample.vec)
    most = max(1, min(MOST_CELLS, MOST_BYTES // (8 * points.shape[1]), len(points)))
    centroids = _fitted(points, min(most, cells or max(1, int(n**0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sims = unit(batch.vec) @ centroids.T
            own = sims.argmax(1)
            yield batch.assign(cell=own.astype(np.int32), angle=np.arccos(np.clip(sims[np.arange(len(own)), own], -1, 1)))

    placed = materialize(rows.mapInPandas(assign, f"doc_id {kind}, vec {dict(rows.dtypes)['vec']}, cell int, angle double"), "cells")
    found = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row per cell
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in found:
        radii[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    parts = F.element_at(F.array(*[F.lit(int(-(-s // GROUP_ROWS) or 1)) for s in sizes]), F.col("cell") + 1)
    return Cells(centroids, radii, sizes, placed.select("doc_id", "vec", "cell", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part")))


def _groups(sizes: np.ndarray, rows: int) -> np.ndarray:
    """The group of each cell's first part: parts of large cells have one each, small cells share groups of about `rows` vectors."""
    parts, out, at, held = np.maximum(1, -(-sizes // GROUP_ROWS)), np.zeros(len(sizes), np.int64), 0, 0
    for cell, size in enumerate(sizes):
        if held and (held + size > rows or parts[cell] > 1):
            at, held = at + 1, 0
        out[cell] = at
        if parts[cell] > 1:
            at += parts[cell]
        else:
            held += size
    return out


def _asked(index: Cells, queries: DataFrame, groups: np.ndarray, choose) -> DataFrame:
    """(qid, qvec, group, cells): queries with every group that has parts of the cells that choose(bounds, order, row) picks, and
    which cells these are; bounds are the largest cosines that members of cells can have, order the cells by them."""
    centroids, radii, sizes = index.centroids, index.radii, index.sizes
    parts = np.maximum(1, -(-sizes // GROUP_ROWS))
    kinds = dict(queries.dtypes)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.iloc[at : at + 256]
                q = unit(rows.qvec)
                bounds = np.cos(np.maximum(0.0, np.arccos(np.clip(q @ centroids.T, -1, 1)) - radii[None, :]))
                bounds[:, sizes == 0] = -np.inf
                order = np.argsort(-bounds, axis=1, kind="stable")
                who, group, cells = [], [], []
                for i in range(len(rows)):
                    picked = np.sort(np.asarray(choose(bounds[i], order[i], rows.iloc[i]) if q[i].any() else [], np.int32))
                    for own in np.split(picked, np.flatnonzero(np.diff(groups[picked])) + 1) if len(picked) else []:
                        for p in range(parts[own[0]]):
                            who.append(i)
                            group.append(groups[own[0]] + p)
                            cells.append(own)
                if who:
                    taken = rows.iloc[who]
                    yield pd.DataFrame({"qid": taken.qid.to_numpy(), "qvec": taken.qvec.to_numpy(), "group": np.array(group, np.int64), "cells": pd.Series(cells, dtype=object)})

    return queries.mapInPandas(deal, f"qid {kinds['qid']}, qvec {kinds['qvec']}, group long, cells array<int>")


def _nearest_of(q: pd.DataFrame, v: pd.DataFrame, k: int, threshold: float | None, skip_self: bool) -> pd.DataFrame:
    """(qid, doc_id, sim) of the k nearest for each query (qid, qvec, cells) among vectors (doc_id, vec, cell) of its cells.
    Queries that ask for alike cells are multiplied with all of these at once; what one of them didn't ask for is left out."""
    if not len(q) or not len(v):
        return best_of(q, v, k, threshold, skip_self)
    v = v.sort_values("doc_id")
    names, own = np.unique(v.cell.to_numpy(), return_inverse=True)
    asked = np.zeros((len(q), len(names)), bool)
    flat, counts = np.concatenate(q.cells.to_numpy()), q.cells.map(len).to_numpy()
    place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    held = names[place] == flat  # a part of a cell may hold none
    asked[np.repeat(np.arange(len(q)), counts)[held], place[held]] = True
    ids, qids, m, qm = v.doc_id.to_numpy(), q.qid.to_numpy(), unit(v.vec), unit(q.qvec)
    out, order = [best_of(q[:0], v, k, threshold, skip_self)], np.lexsort(asked.T)
    for at in range(0, len(q), 512):
        rows = order[at : at + 512]
        cells = asked[rows].any(0)
        cols = np.flatnonzero(cells[own])
        if not len(cols):
            continue
        sims = qm[rows] @ (m if len(cols) == len(m) else m[cols]).T
        if not asked[rows][:, cells].all():
            sims[~asked[rows][:, own[cols]]] = -np.inf
        found = ids[cols]
        heads = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        if len(heads) < len(found):
            found, sims = found[heads], np.maximum.reduceat(sims, heads, axis=1)
        i, j = nearest_columns(sims, k + skip_self)
        best, who = sims[i, j], qids[rows][i]
        keep = best >= (-2.0 if threshold is None else threshold)
        if skip_self:
            keep &= found[j] != who
        out.append(pd.DataFrame({"qid": who[keep], "doc_id": found[j][keep], "sim": best[keep]}))
    return pd.concat(out)


def cell_topk(index: Cells, queries: DataFrame, k: int, threshold: float | None = None, skip_self: bool = False, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, met). hits: (qid, doc_id, sim, rank), as vector_topk of the indexed vectors, for queries (qid, qvec). met:
    (qid, cell), the pairs that were compared. With probes, each query meets that many cells and no more, which is faster and
    may miss some. A query is written once for each group of cells and not for each cell; queries come to a group in slabs."""
    queries = queries.where("qvec is not null").select("qid", "qvec")
    sizes, need = index.sizes, k + skip_self
    q_kind, v_kind = dict(queries.dtypes)["qid"], dict(index.vectors.dtypes)["doc_id"]

    def nearest(bounds, order, row):
        """Cells in order until they hold enough vectors; at least those whose bound is no less than the first's."""
        held = np.cumsum(sizes[order])
        return order[: min(int(np.searchsorted(held, need)) + 1, int((sizes > 0).sum()))] if probes is None else order[: min(probes, int((sizes > 0).sum()))]

    if not len(index.centroids):
        none = queries.select("qid", F.lit(None).cast(v_kind).alias("doc_id"), F.lit(0.0).alias("sim"), F.lit(0).cast("long").alias("rank")).limit(0)
        return none, none.select("qid", F.lit(0).alias("cell"))
    spread = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = _groups(sizes, int(min(GROUP_ROWS, max(LEAST_ROWS, sizes.sum() // spread))))
    slabs = queries.count() // GROUP_ROWS + 1
    base = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), F.col("cell") + 1)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab")
    vectors = index.vectors.select("doc_id", "vec", "cell", (base + F.col("part")).cast("long").alias("group"), every)

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _nearest_of(q, v, k, threshold, skip_self)

    def compared(asked: DataFrame) -> DataFrame:
        dealt = asked.withColumn("slab", F.pmod(F.xxhash64("qid"), F.lit(slabs)))
        return dealt.groupBy("group", "slab").cogroup(vectors.groupBy("group", "slab")).applyInPandas(search, f"qid {q_kind}, doc_id {v_kind}, sim double")

    cells_of = lambda asked: asked.select("qid", F.explode("cells").alias("cell")).distinct()
    start = materialize(_asked(index, queries, groups, nearest), "cells-first")
    near = materialize(compared(start), "cells-near")
    met = cells_of(start)
    if probes is not None:
        return first(near, k, "sim"), met
    floor = first(near, k, "sim").where(F.col("rank") == k - 1).select("qid", (F.col("sim") - SLACK).alias("floor"))
    least = -2.0 if threshold is None else threshold - SLACK
    open_ = queries.join(floor, "qid", "left").select("qid", "qvec", F.greatest(F.coalesce("floor", F.lit(-2.0)), F.lit(least)).alias("floor"))

    def reachable(bounds, order, row):
        done = nearest(bounds, order, row)
        fresh = order[: int((bounds >= row.floor).sum())]
        return fresh[(sizes[fresh] > 0) & ~np.isin(fresh, done)]

    rest = _asked(index, open_, groups, reachable)
    return first(near.unionByName(compared(rest)), k, "sim"), met.unionByName(cells_of(rest))
