"""The cell index against brute force, and the share of (query, cell) pairs that its bounds leave out."""

import numpy as np
import pytest

from loomspark.operators.cells import GROUP_ROWS, cell_index, cell_topk

V, Q = "doc_id long, vec array<float>", "qid long, qvec array<float>"


def clustered(n, dims=24, centres=30, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(int(i), (middle[i % centres] + 0.08 * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def plain(vectors, queries, k, threshold=None, skip_self=False):
    ids = np.array([i for i, _ in vectors])
    m = np.array([v for _, v in vectors], float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    out = []
    for qid, q in queries:
        q = np.array(q, float)
        if not q.any():
            continue
        sims = m @ (q / np.linalg.norm(q))
        best = sorted((-round(s, 9), i) for s, i in zip(sims, ids) if not (skip_self and i == qid))[:k]
        out += [(qid, int(i), rank) for rank, (s, i) in enumerate(best) if threshold is None or -s >= threshold]
    return sorted(out)


def got(hits):
    return sorted((r["qid"], r["doc_id"], r["rank"]) for r in hits.collect())


def test_exact_and_few_pairs_on_clusters(spark):
    vectors = clustered(3000)
    asked = [(10_000 + i, v) for i, v in clustered(90, seed=1)]
    index = cell_index(spark.createDataFrame(vectors, V), 40)
    assert index.sizes.sum() == 3000
    hits, met = cell_topk(index, spark.createDataFrame(asked, Q), 10)
    assert got(hits) == plain(vectors, asked, 10)
    assert met.count() < 0.2 * len(asked) * (index.sizes > 0).sum()


@pytest.mark.parametrize("k, threshold", [(1, None), (5, 0.99), (7, None), (5000, None)])
def test_neighbours_of_all(spark, k, threshold):
    vectors = clustered(400, centres=9) + [(500, [0.0] * 24), (501, clustered(1)[0][1])]
    index = cell_index(spark.createDataFrame([*vectors, (502, None)], V))
    hits, _ = cell_topk(index, spark.createDataFrame(vectors, V).toDF("qid", "qvec"), k, threshold, skip_self=True)
    assert got(hits) == plain(vectors, vectors, k, threshold, skip_self=True)


def test_recall_of_few_probes(spark):
    vectors = clustered(2000, centres=12)
    index = cell_index(spark.createDataFrame(vectors, V))
    asked = spark.createDataFrame(vectors, V).toDF("qid", "qvec")
    near = set(got(cell_topk(index, asked, 5, skip_self=True)[0].select("qid", "doc_id", "rank")))
    some = {(q, d) for q, d, _ in got(cell_topk(index, asked, 5, skip_self=True, probes=8)[0])}
    assert len(some & {(q, d) for q, d, _ in near}) >= 0.9 * len(near)


def test_unstructured_vectors_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    index = cell_index(spark.createDataFrame(vectors, V))
    vectors = [(i, np.float32(v).tolist()) for i, v in vectors]
    assert got(cell_topk(index, spark.createDataFrame(vectors, V).toDF("qid", "qvec"), 4)[0]) == plain(vectors, vectors, 4)
    none = cell_index(spark.createDataFrame([], V))
    assert cell_topk(none, spark.createDataFrame(vectors, V).toDF("qid", "qvec"), 4)[0].count() == 0
    assert cell_topk(index, spark.createDataFrame([], Q), 4)[0].count() == 0


def test_a_cell_of_many_parts(spark, monkeypatch):
    from loomspark.operators import cells

    monkeypatch.setattr(cells, "GROUP_ROWS", 50)
    vectors = clustered(600, centres=2)
    index = cell_index(spark.createDataFrame(vectors, V), 3)
    assert index.vectors.select("part").distinct().count() > 3 and GROUP_ROWS > 50
    asked = vectors[:40]
    assert got(cell_topk(index, spark.createDataFrame(asked, V).toDF("qid", "qvec"), 6)[0]) == plain(vectors, asked, 6)


def test_the_limit_comes_before_the_shuffle(spark):
    """Plans keep k rows of each query before they sort all."""
    from loomspark.operators.vector import vector_topk

    rows = spark.createDataFrame(clustered(50), V)
    assert "WindowGroupLimit" in vector_topk(rows, rows.toDF("qid", "qvec"), 3)._jdf.queryExecution().toString()


def test_a_query_is_written_once_for_a_group_of_cells(spark):
    from loomspark.operators import cells

    rng = np.random.default_rng(5)
    vectors = [(i, np.float32(rng.normal(size=16)).tolist()) for i in range(400)]
    rows = spark.createDataFrame(vectors, V)
    index = cell_index(rows, 20)
    groups = cells._groups(index.sizes, 100)
    held = np.bincount(groups, weights=index.sizes)
    assert held.sum() == 400 and held.max() <= 100 and len(held) < 10
    assert cells._groups(np.array([10, cells.GROUP_ROWS * 2 + 1, 10, 0, 10]), 25).tolist() == [0, 1, 4, 4, 4]
    asked = cells._asked(index, rows.toDF("qid", "qvec"), groups, lambda bounds, order, row: order).collect()
    assert len(asked) == 400 * len(held) and sum(len(r["cells"]) for r in asked) == 400 * 20
