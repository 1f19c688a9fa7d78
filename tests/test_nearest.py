"""Selection of the highest entries without sorting all, and walks without broadcasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import analytics as A
from loomspark.operators.vector import nearest_columns


@pytest.mark.parametrize("width", [1, 5, 64, 300, 1000])
@pytest.mark.parametrize("k", [1, 3, 6, 40])
def test_same_as_a_sort_of_all(width, k):
    rng = np.random.default_rng(width * 100 + k)
    for sims in (rng.random((20, width)), np.round(rng.random((20, width)), 1) + rng.random((20, width)) * 1e-11, np.zeros((3, width)), -rng.random((9, width))):
        order = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]
        i, j = nearest_columns(sims, k)
        assert i.tolist() == np.repeat(np.arange(len(sims)), order.shape[1]).tolist() and j.tolist() == order.ravel().tolist()


def test_absent_entries_are_none():
    sims = np.full((2, 500), -np.inf)
    sims[0, [400, 7]] = 0.5, 0.6
    assert [x.tolist() for x in nearest_columns(sims, 3)] == [[0, 0], [7, 400]]


def test_rounds_of_a_walk_broadcast_nothing(spark, monkeypatch):
    """Shares don't pass the driver."""
    plans, keep = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    links = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0), (4, 1, 1.0)], "from_id long, to_id long, share double")
    got = {r["node"]: r["rank"] for r in A.stationary(links, spark.range(1, 6).select(F.col("id").alias("node")), 0.85, 60, 1e-12).collect()}
    m, p = np.zeros((5, 5)), np.full(5, 0.2)
    for a, b, w in ((1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0), (4, 1, 1.0)):
        m[b - 1, a - 1] = w
    for _ in range(60):
        p = 0.85 * m @ p + 0.15 / 5
        p /= p.sum()
    assert np.allclose([got[i] for i in range(1, 6)], p, atol=1e-9)
    rounds = [plan for label, plan in plans if label == "rank"]
    assert rounds and not any("Broadcast" in plan for plan in rounds)
