"""Exact top-k inner products by block-at-a-time pruning.

Rows are dealt to clusters around centroids of a bounded sample, so that blocks of BLOCK rows hold alike vectors; the
order of rows is free, as every row is covered by some block. A block has a forward index (its integer matrix) and, per
dimension, its largest and smallest component; the summed per-dimension maxima of a query's products bound all scores
of a block. A query first takes the blocks of its own cluster's first group, which gives it a floor for its kth score;
then every other group takes its blocks by falling bound and stops at the first bound below floor and kth score. A task
holds a group of blocks, of bounded size, and a slab of queries. A last merge keeps k of the groups' results.

Bounds prune where vectors form clusters; among vectors without structure every block may hold a hit, and all are scored.

Defined results: vectors that are null or hold null or non-finite components take no part, nor does a null vec_id;
shorter vectors count as padded with zeros; of several vectors under one vec_id the smallest counts; ties go to the
smaller vec_id; extra columns are ignored; components must keep inner products within a signed long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.session import materialize

BLOCK = 64
#: Components of a group's rows, times the mean cluster that a group may hold, and rows of a slab of queries.
GROUP_VALUES = 1 << 22
UNEVEN = 4
SLAB_ROWS = 65_536
CHUNK = 2048
#: Clusters at most, rows for each, and the sample that their centroids are fitted on (rows and components at most).
CLUSTERS, CLUSTER_ROWS, SAMPLE_ROWS, SAMPLE_VALUES = 256, 256, 4096, 1 << 21
EXACT, ROUNDING = 1 << 53, 1e-9
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of every component; one row per vec_id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(values: list, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims), np.int64)
    for row, v in zip(out, values):
        row[: len(v)] = v
    return out


def _small(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integer type that holds them."""
    kind = next(t for t in (np.int16, np.int32, np.int64) if not matrix.size or np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max)
    return matrix.astype(kind)


def _centroids(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids by a few rounds of spherical k-means over the sample."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    out = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (unit @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), out)
    return out


def clustered(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v) with `cluster`, the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix([v.values.to_numpy() for v in batch.column("v")], centroids.shape[1]).astype(float)
            near = (matrix @ centroids.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], ["vec_id", "v", "cluster"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, cluster long")


PACKED = "cluster long, bucket long, first long, ids binary, floors binary, matrix binary, dims int, width int"


def pack(rows: DataFrame, rows_each: int) -> DataFrame:
    """Rows (vec_id, v, cluster, bucket, floor) in order, as rows of PACKED: rows_each at most, of one cluster and bucket."""
    schema = pa.schema([("cluster", pa.int64()), ("bucket", pa.int64()), ("first", pa.int64()), ("ids", pa.binary()), ("floors", pa.binary()), ("matrix", pa.binary()), ("dims", pa.int32()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("cluster", "bucket")], 1)
            cuts = np.flatnonzero((np.diff(group, axis=0) != 0).any(1)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                for i in range(low, high, rows_each):
                    part = batch.slice(i, min(rows_each, high - i))
                    values = [v.values.to_numpy() for v in part.column("v")]
                    matrix = _small(_matrix(values, max(map(len, values), default=0)))
                    ids, floors = (part.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "floor"))
                    row = {"cluster": int(group[i, 0]), "bucket": int(group[i, 1]), "first": int(ids[0]), "ids": ids.tobytes(), "floors": floors.tobytes(), "matrix": matrix.tobytes(), "dims": matrix.shape[1], "width": matrix.dtype.itemsize}
                    yield pa.RecordBatch.from_pylist([row], schema)

    return rows.select("vec_id", "v", "cluster", "bucket", "floor").mapInArrow(run, PACKED)


def _unpacked(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(row.matrix, f"<i{row.width}").reshape(-1, row.dims) if row.dims else np.zeros((len(row.ids) // 8, 0), np.int64)
    matrix = np.zeros((len(found), dims), np.int64)
    matrix[:, : row.dims] = found
    return np.frombuffer(row.ids, np.int64), matrix


def best_of(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, scored): each query's k best rows of blocks of its floor or more, by score and then id, missing ones
    with id -1; and how many pairs of a query and a block were scored."""
    high, low = np.array([m.max(0) for _, m in blocks]), np.array([m.min(0) for _, m in blocks])
    sizes = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))), 1) for m in (np.concatenate([high, low]), queries)]
    kind = np.float64 if sizes[0] * sizes[1] * max(queries.shape[1], 1) < EXACT else np.int64  # float products are exact below 2^53, and fast
    q, wide = queries.astype(kind), queries.astype(np.float64)
    tops, bottoms = high.T.astype(np.float64), low.T.astype(np.float64)
    bounds = np.maximum(wide, 0) @ tops + np.minimum(wide, 0) @ bottoms
    if kind is np.int64:  # a bound may pass the range of longs where no product does: as a float, rounded up
        bounds += np.abs(wide) @ np.maximum(np.abs(tops), np.abs(bottoms)) * ROUNDING
    order = np.argsort(-bounds, axis=1, kind="stable")
    forward = [m.T.astype(kind) for _, m in blocks]
    scores, ids = np.full((len(q), k), NONE), np.full((len(q), k), -1, np.int64)
    floors = np.full(len(q), NONE) if floors is None else floors
    live, scored = np.arange(len(q)), 0
    for r in range(len(blocks)):
        b = order[live, r]
        least = np.maximum(scores[live, -1], floors[live])
        open_ = (least == NONE) | (bounds[live, b] >= least)
        live, b = live[open_], b[open_]
        if not len(live):
            break
        scored += len(live)
        for block in np.unique(b):
            own = live[b == block]
            block_ids = blocks[block][0]
            found = (q[own] @ forward[block]).astype(np.int64)
            found[(block_ids[None, :] == query_ids[own, None]) | (found < floors[own, None])] = NONE
            hit = ((found >= scores[own, -1:]) & (found > NONE)).any(1)  # the other queries' best stay as they are
            own, found = own[hit], found[hit]
            if not len(own):
                continue
            s = np.concatenate([scores[own], found], 1)
            i = np.concatenate([ids[own], np.broadcast_to(block_ids, found.shape)], 1)
            top = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
            scores[own], ids[own] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    return scores, np.where(scores == NONE, -1, ids), scored


FOUND = "query_id long, vec_id long, score long"


def _search(k: int, seeding: bool):
    """Searches a group's blocks for its queries; a row without query_id holds the pairs scored and all pairs."""

    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("Int64")]
        dims = max([*queries.dims, *blocks.dims, 0])
        held = [_unpacked(b, dims) for b in blocks.sort_values("first").itertuples()]
        scored = pairs = 0
        own = [(*_unpacked(row, dims), np.frombuffer(row.floors, np.int64)) for row in queries.itertuples() if seeding or not (row.own == row.cluster and row.bucket == 0)]  # that group gave the floor
        if held and own:
            ids, matrix, floors = (np.concatenate(x) for x in zip(*own))
            for i in range(0, len(ids), CHUNK):
                part = slice(i, i + CHUNK)
                scores, found, n = best_of(ids[part], matrix[part], held, k, None if seeding else floors[part])
                scored, pairs = scored + n, pairs + len(scores) * len(held)
                n = (scores > NONE).sum(1)
                keep = np.arange(k)[None, :] < n[:, None]
                out.append(pd.DataFrame({"query_id": np.repeat(ids[part], n), "vec_id": found[keep], "score": scores[keep]}).astype("Int64"))
        out.append(pd.DataFrame({"query_id": [None], "vec_id": [scored], "score": [pairs]}).astype("Int64"))
        return pd.concat(out)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): candidates that hold the k best rows of vectors for every row of queries but its own
    vec_id; rows without query_id hold numbers of pairs of a query and a block, those scored and all.

    Both inputs have vec_id and v (integer arrays). Queries are sent to every group of blocks, in slabs of bounded
    size; blocks go to every slab.
    """
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dims:
        dims = 1
    sample_rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dims))
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample_rows).collect()]  # of bounded size
    k_means = max(1, min(CLUSTERS, n // CLUSTER_ROWS, len(sample)))
    centroids = _centroids(_matrix(sample, dims).astype(float), k_means) if sample else np.zeros((1, dims))
    rows = materialize(clustered(vectors, centroids), "clustered")
    sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # CLUSTERS rows at most
    most = max(BLOCK, min(GROUP_VALUES // dims, UNEVEN * n // k_means + BLOCK))  # a large cluster is many groups
    buckets = {c: size // most + 1 for c, size in sizes.items()}
    table = F.create_map(*[F.lit(x) for pair in (buckets or {0: 1}).items() for x in pair])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.element_at(table, F.col("cluster")))).withColumn("floor", F.lit(NONE))
    parts = max(1, sum(buckets.values()))
    order = ["cluster", "bucket", "vec_id"]
    blocks = materialize(pack(rows.repartition(parts, "cluster", "bucket").sortWithinPartitions(*order), BLOCK), "blocks")

    total = queries.count()
    slabs = total // SLAB_ROWS + 1
    asked = materialize(clustered(queries, centroids).withColumn("bucket", F.lit(0).cast("long")), "queries")
    dealt = lambda df: pack(df.repartition(max(1, total // (CHUNK * 8)), "cluster").sortWithinPartitions(*order), CHUNK)
    slab = lambda df: df.withColumn("slab", F.pmod(F.xxhash64("first"), F.lit(slabs)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long")))
    seeds = slab(dealt(asked.withColumn("floor", F.lit(NONE))))
    first = seeds.groupBy("cluster", "slab").cogroup(blocks.where("bucket = 0").withColumn("slab", every).groupBy("cluster", "slab")).applyInPandas(_search(k, True), FOUND)
    first = materialize(first, "seeded")
    floors = first.where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    ready = asked.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
    groups = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("cluster"), F.lit(b).cast("long").alias("bucket")) for c, n_ in (buckets or {0: 1}).items() for b in range(n_)]))
    left = slab(dealt(ready).withColumnRenamed("cluster", "own").drop("bucket")).withColumn("g", groups).select("own", "first", "ids", "floors", "matrix", "dims", "width", "slab", "g.*")
    right = blocks.withColumn("slab", every)
    keys = ["cluster", "bucket", "slab"]
    return first.unionByName(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k, False), FOUND))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for every row of queries but its own vec_id."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = search(vectors, queries, k).where("query_id is not null")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruned_share(vectors: DataFrame, queries: DataFrame, k: int) -> float:
    """Share of the pairs of a query and a block that bounds kept from being scored."""
    scored, pairs = search(vectors, queries, k).where("query_id is null").agg(F.sum("vec_id"), F.sum("score")).first()
    return 1 - scored / pairs if pairs else 0.0


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "quantised")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
