"""Similarity joins by random hyperplanes: tables of sign bits bring alike vectors together, cosines decide.

Two vectors at an angle of t radians lie on one side of a random hyperplane with probability 1 - t / pi. With `bits` planes a
table and tables_for(threshold, bits, recall) tables, a pair at the threshold shares a bucket with the probability `recall`
or more, and nearer pairs with a higher one. Vectors enter once for all equal ones; those alone in a bucket carry no vector
on. Buckets of any size are compared in pairs of blocks, each of which returns a spanning forest of the links it found, so
that a bucket of n vectors gives no more than n links a block. exact=True compares all blocks of all vectors instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.components import connected_components
from loomspark.operators.vector import unit
from loomspark.session import materialize

#: Vectors of a block; most tables; vectors that a bucket has on average; vectors of a batch of buckets.
BLOCK, MOST_TABLES, BUCKET, BATCH = 1024, 64, 64, 8192
SEED = 11


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables of `bits` planes in which a pair at the threshold meets with the probability `recall`."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def bits_for(n: int, threshold: float, recall: float) -> int:
    """Planes of a table: as many as leave BUCKET vectors in a bucket, fewer where that takes more than MOST_TABLES."""
    bits = max(1, min(48, round(math.log2(max(2, n / BUCKET)))))
    while bits > 1 and tables_for(threshold, bits, recall) > MOST_TABLES:
        bits -= 1
    return bits


def forest(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(row, column) links that connect what near, rows by columns, connects; rows are the columns if same."""
    rows = np.zeros(near.shape[0], bool)
    cols = rows if same else np.zeros(near.shape[1], bool)
    out = []
    for start in np.flatnonzero(near.any(1)):
        if rows[start]:
            continue
        rows[start] = True
        stack = [(int(start), True)]
        while stack:
            at, is_row = stack.pop()
            if is_row:
                fresh = np.flatnonzero(near[at] & ~cols)
                cols[fresh] = True
                out += [(at, int(c)) for c in fresh]
                stack += [(int(c), same) for c in fresh]
            else:
                fresh = np.flatnonzero(near[:, at] & ~rows)
                rows[fresh] = True
                out += [(int(r), at) for r in fresh]
                stack += [(int(r), True) for r in fresh]
    return out


def _keys(classes: DataFrame, bits: int, tables: int, dims: int) -> DataFrame:
    """(table, key, class_id) of every vector in every table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(SEED).normal(size=(dims, tables * bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                signs = (unit(part.vec) @ planes > 0).reshape(len(part), tables, bits)
                yield pd.DataFrame({"table": np.tile(np.arange(tables, dtype=np.int32), len(part)), "key": (signs @ weights).ravel(), "class_id": np.repeat(part.class_id.to_numpy(), tables)})

    return classes.select("class_id", "vec").mapInPandas(run, "table int, key long, class_id long")


def near_links(vectors: DataFrame, threshold: float, recall: float = 0.99, bits: int | None = None, exact: bool = False, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, class_id) puts equal vectors under their smallest doc_id (a long); links (a, b, sim)
    are classes a < b with a cosine of threshold or more, connected as all such pairs that met would be. every=True returns
    all pairs that met. Null vectors take no part; zero vectors have no links."""
    members = materialize(vectors.where("vec is not null").select("doc_id", "vec", F.xxhash64("vec").alias("h")), "vectors")
    classes = materialize(members.groupBy("h", "vec").agg(F.min("doc_id").alias("class_id")), "classes")
    own = members.join(classes.select("h", F.col("vec").alias("c_vec"), "class_id"), "h").where("vec = c_vec").select("doc_id", "class_id")
    n, dims = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if exact or not n:
        keyed = classes.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("key"), "class_id")
    else:
        bits = bits or bits_for(n, threshold, recall)
        keyed = materialize(_keys(classes, bits, tables_for(threshold, bits, recall), dims), "keys")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").select("table", "key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = materialize(sizes, "bucket-sizes")
    batches = (sizes.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // BATCH + 1
    rows = keyed.join(sizes.drop("n"), ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("class_id"), "blocks").cast("int")).join(classes.select("class_id", "vec"), "class_id")
    # A vector meets a pair of blocks once: buckets of one block share batches, the others have a group for each pair of blocks.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    single = F.col("blocks") == 1
    dealt = [F.when(single, -1).otherwise(F.col("table")).alias("of"), F.when(single, F.pmod(F.xxhash64("table", "key"), F.lit(batches))).otherwise(F.col("key")).alias("at")]
    rows = rows.select("table", "key", "class_id", "vec", "own", *dealt, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["table", "key", "class_id"])
        ids, m, own = group.class_id.to_numpy(), unit(group.vec), group.own.to_numpy()
        i, j = group.i.iloc[0], group.j.iloc[0]
        if i == j:
            table, key = group.table.to_numpy(), group.key.to_numpy()
            starts = np.flatnonzero(np.append(True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])))
            sides = [(slice(x, y),) * 2 for x, y in zip(starts, np.append(starts[1:], len(ids)))]
        else:
            sides = [(np.flatnonzero(own == i), np.flatnonzero(own == j))]
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sim": np.zeros(0)})]
        for left, right in sides:
            sims = m[left] @ m[right].T
            near = sims >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            if near.any():
                found = np.argwhere(np.triu(near) if i == j else near).tolist() if every else forest(near, i == j)
                x, y = np.array(found).T
                a, b = ids[left][x], ids[right][y]
                out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sims[x, y]}))
        return pd.concat(out)

    met = rows.groupBy("of", "at", "i", "j").applyInPandas(meet, "a long, b long, sim double")
    return own, materialize(met.groupBy("a", "b").agg(F.max("sim").alias("sim")), "near-links")


def near_groups(vectors: DataFrame, threshold: float, **options) -> DataFrame:
    """(doc_id, class_id, root): root is the smallest class that a vector's class reaches over links of near_links."""
    members, links = near_links(vectors, threshold, **options)
    roots = connected_components(links.select("a", "b"))
    return members.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "class_id", F.coalesce("root", "class_id").alias("root"))
