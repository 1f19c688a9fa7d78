"""The whole-graph queries against dense and brute-force versions on given tables."""

from collections import defaultdict, deque

import numpy as np
import pytest

from loomspark.operators import analytics as A
from loomspark.plans import fixtures as X
from loomspark.plans import graph_queries as Q

SMALL = "/root/testdata/sf0.01"


def default_edges(spark, sf):
    rows = X.edges(spark, sf).where("invalid_at is null").collect()
    return [(r["from_id"], r["to_id"], r["weight"]) for r in rows if r["edge_type"] in A.DEFAULT_TYPES and r["from_id"] != r["to_id"]]


def largest(pairs):
    near = defaultdict(set)
    for a, b, _ in pairs:
        near[a].add(b)
        near[b].add(a)
    groups, seen = [], set()
    for node in sorted(near):
        if node not in seen:
            found, queue = {node}, deque([node])
            while queue:
                fresh = near[queue.popleft()] - found
                found |= fresh
                queue.extend(fresh)
            seen |= found
            groups.append(sorted(found))
    return max(groups, key=len), near


def dense(spark, sf):
    """(nodes, second eigenvalue, second eigenvector) of the largest component."""
    pairs = default_edges(spark, sf)
    nodes, _ = largest(pairs)
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in pairs:
        if a in at:
            m[at[a], at[b]] -= w
            m[at[b], at[a]] -= w
    values, vectors = np.linalg.eigh(m - np.diag(m.sum(1)))
    return nodes, values[1], vectors[:, 1]


def test_fiedler_equals_the_dense_eigenvector(spark):
    nodes, _, want = dense(spark, SMALL)
    got = {r["node"]: r["value"] for r in Q.fiedler(spark, SMALL).collect()}
    assert sorted(got) == nodes
    mine = np.array([got[x] for x in nodes])
    want = want * np.sign(mine @ want)
    assert np.abs(mine - want).max() < 2e-6
    clear = np.abs(want) > 2e-6
    assert (np.sign(mine) == np.sign(want))[clear].all()


def brute_betweenness(near):
    out, n = dict.fromkeys(near, 0.0), len(near)
    for s in near:
        sigma, depth, order = defaultdict(float, {s: 1.0}), {s: 0}, [s]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    sigma[y] += sigma[x]
        delta = defaultdict(float)
        for y in reversed(order[1:]):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            out[y] += delta[y]
    return {x: v / ((n - 1) * (n - 2)) for x, v in out.items()}


def test_betweenness_of_all_sources_and_types(spark, sf, monkeypatch):
    want = brute_betweenness(largest(default_edges(spark, sf))[1])
    monkeypatch.setattr(A.betweenness, "__defaults__", (None, None, 25_000))  # two slabs or more
    got = {r["node"]: r["betweenness"] for r in Q.betweenness(spark, sf).collect()}
    assert got.keys() == want.keys() and any(x.startswith("c") for x in got)
    assert all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_rmt_novel_equals_the_dense_projection(spark, sf):
    from loomspark.functions import text as T
    from loomspark.operators.vector import hash_embed

    rows = X.docs(spark, sf).select("doc_id", T.terms("body").alias("t")).select("doc_id", hash_embed("t").alias("v")).orderBy("doc_id").collect()
    m = np.array([r["v"] for r in rows], float)
    centred = m - m.mean(0)
    values, comps = np.linalg.eigh(centred.T @ centred / len(m))
    bound = values.mean() * (1 + (m.shape[1] / len(m)) ** 0.5) ** 2
    raw = (centred @ comps[:, values > bound]) ** 2 @ (values[values > bound] - bound)
    want = (raw - raw.min()) / (raw.max() - raw.min())
    got = {r["doc_id"]: r["score"] for r in Q.rmt_novel(spark, sf).collect()}
    assert len(got) == len(rows) > 0 and all(abs(got[r["doc_id"]] - w) < 2e-6 for r, w in zip(rows, want))


def chain(spark, n):
    return spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "related_to", "main", 1.0 + i / 7) for i in range(n)], "from_id string, to_id string, edge_type string, corpus string, weight double").selectExpr("*", "timestamp'2024-01-01' as valid_at", "cast(null as timestamp) as invalid_at")


def test_shortest_path_reaches_ten_steps(spark, monkeypatch):
    monkeypatch.setattr(Q, "_edges", lambda spark, sf: chain(spark, 12))
    monkeypatch.setattr(Q, "_path_pairs", lambda spark, sf: spark.createDataFrame([(1, "n00", "n08"), (2, "n00", "n10"), (3, "n00", "n11")], "pid long, a string, b string"))
    steps = defaultdict(list)
    for r in Q.shortest_path(spark, None).collect():
        steps[r["pid"]].append((r["step"], r["node"]))
    assert {p: sorted(s) for p, s in steps.items()} == {p: [(i, f"n{i:02d}") for i in range(n + 1)] for p, n in ((1, 8), (2, 10))}


def test_full_analysis_has_gap_boundary_and_converged_ranks(spark, monkeypatch):
    calls = {}
    rank, between = A.pagerank, A.betweenness
    monkeypatch.setattr(A, "pagerank", lambda edges, **options: calls.update(options) or rank(edges, rounds=3))
    monkeypatch.setattr(A, "betweenness", lambda edges, starts, types: calls.update(starts=starts.count()) or between(edges, starts, types))
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z")]
    edges = spark.createDataFrame([(*p, "related_to", "main", 1.0) for p in pairs], "from_id string, to_id string, edge_type string, corpus string, weight double").selectExpr("*", "timestamp'2024-01-01' as valid_at", "cast(null as timestamp) as invalid_at")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vec array<double>")
    got = defaultdict(list)
    for r in A.full_analysis(edges, vectors).orderBy("rank").collect():
        got[r["section"]].append((r["id"], r["score"]))
    m = np.zeros((6, 6))
    for a, b in pairs:
        m["abcxyz".index(a), "abcxyz".index(b)] = m["abcxyz".index(b), "abcxyz".index(a)] = 1
    gap = np.linalg.eigvalsh(np.diag(m.sum(1)) - m)[1]
    assert dict(got["structure"]) == {"components": 1.0, "spectral_gap": pytest.approx(gap, abs=1e-6)}
    assert len(got["boundary"]) == 5 and {x for x, _ in got["boundary"][:2]} == {"c", "x"}
    assert calls == {"starts": 6} and A.SOURCES == 200


def test_kept_neighbours_take_in_fresh_vectors(spark, monkeypatch):
    """In three steps, with fewer than k at first; the number of compared pairs is that of fresh vectors with all."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    df = lambda a, b: spark.createDataFrame(rows[a:b], "doc_id long, vec array<double>")
    compared, search = [], A.vector_topk
    monkeypatch.setattr(A, "vector_topk", lambda v, q, k, **options: compared.append(v.count() * q.count()) or search(v, q, k, **options))
    kept = A.knn_edges(df(0, 4), 5)
    kept = A.knn_delta(kept, df(0, 4), df(4, 60), 5)
    compared.clear()
    kept = A.knn_delta(kept, df(0, 60), df(60, 90), 5)
    assert sum(compared) == 30 * 90 + 30 * 60
    pairs = lambda edges: {(r["qid"], r["doc_id"]) for r in edges.collect()}
    assert pairs(kept) == pairs(A.knn_edges(df(0, 90), 5)) and kept.count() == 450
    score = lambda **options: {r["doc_id"]: round(r["surprisal"], 9) for r in A.surprisal(df(0, 90), 5, rounds=3, **options).collect()}
    assert score(knn=kept) == score()


def test_full_analysis_gives_the_ranks_of_pages_as_scores(spark):
    pairs = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "a")]
    edges = spark.createDataFrame([(*p, "related_to", "main", 1.0) for p in pairs], "from_id string, to_id string, edge_type string, corpus string, weight double").selectExpr("*", "timestamp'2024-01-01' as valid_at", "cast(null as timestamp) as invalid_at")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vec array<double>")
    got = [(r["id"], r["score"]) for r in A.full_analysis(edges, vectors).where("section = 'foundational'").orderBy("rank").collect()]
    want = sorted(((r["node"], round(r["rank"], 6)) for r in A.pagerank(edges).collect()), key=lambda x: (-x[1], x[0]))
    assert got == want and sum(x for _, x in got) == pytest.approx(1, abs=1e-5)
