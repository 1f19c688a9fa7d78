import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.operators import analytics as A
from loomspark.operators import graph as G
from loomspark.operators import records as R
from loomspark.operators.components import connected_components
from loomspark.operators.vector import similar_pairs, vector_topk, without_near_greedy

KINDS = "from_id string, to_id string, edge_type string, corpus string, weight double, valid_at timestamp, invalid_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def graph(spark, pairs, kind="related_to"):
    return spark.createDataFrame([(a, b, kind, "main", 1.0, DAY, None) for a, b in pairs], KINDS)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = as_dict(connected_components(edges, few), "node", "root")
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0), few).count() == 0
    names = connected_components(edges.selectExpr("concat('n', a) as a", "concat('n', b) as b"), few)
    assert as_dict(names, "node", "root") == {f"n{i}": "n0" for i in range(41)} | {f"n{i}": "n100" for i in (100, 101, 102)}


def test_betweenness_closed_forms(spark):
    path = as_dict(A.betweenness(graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])), "node", "betweenness")
    assert path["c"] == pytest.approx(2 * 4 / (4 * 3)) and path["a"] == 0
    star = as_dict(A.betweenness(graph(spark, [("m", x) for x in "abcde"])), "node", "betweenness")
    assert star["m"] == pytest.approx(1.0) and star["a"] == 0


def test_pagerank_sums_to_one(spark):
    rank = as_dict(A.pagerank(graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])), "node", "rank")
    assert sum(rank.values()) == pytest.approx(1.0) and rank["a"] > 0
    assert A.pagerank(graph(spark, [("a", "b")]).limit(0)).count() == 0


def test_fiedler_splits_a_barbell(spark):
    left, right = [("a", "b"), ("b", "c"), ("a", "c")], [("x", "y"), ("y", "z"), ("x", "z")]
    got = as_dict(A.fiedler(graph(spark, [*left, ("c", "x"), *right]), 40), "node", "value")
    assert len({got[n] > 0 for n in "abc"}) == 1 and len({got[n] > 0 for n in "xyz"}) == 1
    assert (got["a"] > 0) != (got["z"] > 0)


def test_rmt_marks_the_planted_direction(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(0, 0.1, (200, 6))
    m[:5, 0] += 3
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, vec array<double>")
    top = A.top_share(A.rmt_anomalies(rows), 0.025, "score").collect()
    assert {r["doc_id"] for r in top} == set(range(5))
    assert A.rmt_anomalies(rows.limit(5)).count() == 0


def test_surprisal_invariants(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i), 1.0]) for i in range(12)], "doc_id long, vec array<double>")
    got = A.surprisal(rows, k=3, rounds=5).collect()
    assert len(got) == 12 and min(r["normalized"] for r in got) == 0 and max(r["normalized"] for r in got) == 1
    assert A.surprisal(rows.limit(2)).count() == 0


def test_shortest_path(spark):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("q", "r")])
    pairs = spark.createDataFrame([(1, "a", "d"), (2, "a", "a"), (3, "a", "q")], "pid long, a string, b string")
    got = {}
    for r in G.shortest_paths(edges, pairs).orderBy("pid", "step").collect():
        got.setdefault(r["pid"], []).append((r["node"], r["via"]))
    assert got == {1: [("a", None), ("x", "related_to"), ("d", "related_to")], 2: [("a", None)]}


def plain_search(links, a, b, most, rounds=10):
    """Length of the path that a search from both ends finds, links being (from, to, weight)."""
    out, into = defaultdict(list), defaultdict(list)
    for x, y, w in links:
        out[x].append((-w, y))
        into[y].append((-w, x))
    near = lambda n: {y for _, y in sorted(out[n])[:most]} | {y for _, y in sorted(into[n])[:most]}
    seen, front, depth = ({a: 0}, {b: 0}), [{a}, {b}], [0, 0]
    if a == b:
        return 0
    for _ in range(rounds):
        if not front[0] or not front[1]:
            return None
        side = 0 if len(front[0]) <= len(front[1]) else 1
        depth[side] += 1
        front[side] = {y for n in front[side] for y in near(n)} - set(seen[side])
        seen[side].update(dict.fromkeys(front[side], depth[side]))
        met = [depth[side] + seen[1 - side][n] for n in front[side] if n in seen[1 - side]]
        if met:
            return min(met)
    return None


@pytest.mark.parametrize("most", [100, 2])
def test_paths_from_both_ends(spark, most):
    """Random graphs with hubs: lengths as by a plain search, steps that are edges, fewer rows than from one end."""
    rng = random.Random(most)
    links = {(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(420)} | {("hub", f"n{i}") for i in range(0, 300, 9)}
    links = [(a, b, 1 + i / 1000) for i, (a, b) in enumerate(sorted(links)) if a != b]
    edges = spark.createDataFrame([(a, b, "related_to", "main", w) for a, b, w in links], "from_id string, to_id string, edge_type string, corpus string, weight double").selectExpr("*", "timestamp'2024-01-01' as valid_at", "cast(null as timestamp) as invalid_at")
    ends = [(i, f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for i in range(40)] + [(90, "n1", "nowhere")]
    paths, reached = G.two_sided(edges, spark.createDataFrame(ends, "pid long, a string, b string"), per_node=most)
    got = defaultdict(list)
    for r in paths.collect():
        got[r["pid"]].append((r["step"], r["node"]))
    joined = {(a, b) for a, b, _ in links} | {(b, a) for a, b, _ in links}
    for pid, a, b in ends:
        length = plain_search(links, a, b, most)
        nodes = [n for _, n in sorted(got[pid])]
        assert (len(nodes) - 1 if nodes else None) == length
        assert not nodes or (nodes[0], nodes[-1]) == (a, b) and all(p in joined for p in zip(nodes, nodes[1:]))
    if most == 100:  # a search from a alone visits all nodes nearer than b
        near = defaultdict(set)
        for a, b in joined:
            near[a].add(b)
        one = 0
        for pid, a, b in ends:
            seen, front = {a}, {a}
            while front and b not in seen:
                front = {y for n in front for y in near[n]} - seen
                seen |= front
            one += len(seen)
        assert reached.count() < one / 2


def test_upsert_keeps_the_last_written(spark):
    old = graph(spark, [("a", "b")]).withColumn("invalid_at", F.col("valid_at"))
    fresh = graph(spark, [("a", "b")]).withColumn("weight", F.lit(0.3)).withColumn("seq", F.lit(7).cast("long"))
    row = G.upsert(old, fresh).collect()
    assert len(row) == 1 and row[0]["weight"] == 0.3 and row[0]["invalid_at"] is None


def test_greedy_dedup_keeps_the_chain_ends(spark):
    # 1 ~ 2 ~ 3 but not 1 ~ 3: 2 is dropped, 3 stays.
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.96, 0.28]), (3, [0.84, 0.54]), (4, [1.0, 0.0])], "doc_id long, vec array<double>")
    assert {r["doc_id"] for r in without_near_greedy(rows, 0.95).collect()} == {1, 3}
    own, pairs = similar_pairs(rows, 0.95)
    assert as_dict(own, "doc_id", "class_id")[4] == 1
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (2, 3)}


def test_topk_zero_and_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "doc_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid long, qvec array<double>")
    got = [(r["qid"], r["doc_id"]) for r in vector_topk(v, q, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (1, 4)]


def test_delete_cascades(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    left = R.delete_documents({"documents": docs, "vectors": docs}, docs.where("doc_id = 1"))
    assert [r["doc_id"] for r in left["documents"].collect()] == [r["doc_id"] for r in left["vectors"].collect()] == [2]
    edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert G.delete(edges, spark.createDataFrame([("b",)], "node string")).count() == 1
