"""Connected components by min-label contraction on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import materialize

def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges: one task joins them one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.a.tolist(), batch.b.tolist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                low, high = sorted((top(a), top(b)))
                up[high] = low
        if up:
            yield pd.DataFrame({"node": list(up), "root": [top(x) for x in up]})

    kind = dict(edges.dtypes)["a"]
    return edges.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's smallest node.

    Each round a node points to its smallest neighbour if that is smaller; pointers are followed to their roots, and
    edges are contracted to the roots. Rounds grow with the logarithm of the number of nodes. Nothing is gathered on
    the driver but whether edges are left. A caller that knows its edges to be few may let one task join up to `few` of
    them, with the same result.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if few and edges.count() <= few:
        return materialize(_in_one_task(edges), "roots")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("root"))
    live = edges
    while not live.isEmpty():
        # An edge's a is its larger end, so only a can point along it; nodes that are never an a are roots.
        parents = materialize(live.groupBy("a").agg(F.min("b").alias("to")), "parents")
        moved = True
        while moved:
            ahead = parents.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = materialize(parents.join(ahead, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            parents = jumped.select("a", "to")
        step = parents.select(F.col("a").alias("root"), F.col("to").alias("new"))
        nodes = materialize(nodes.join(step, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
        for end in ("a", "b"):
            live = live.join(step.withColumnsRenamed({"root": end, "new": f"{end}_new"}), end, "left").withColumn(end, F.coalesce(f"{end}_new", end)).drop(f"{end}_new")
        live = materialize(live.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return nodes
