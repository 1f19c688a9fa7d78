"""Hyperplane tables against all pairs: recall, forests and groups, hot buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import hyperplanes as H
from loomspark.operators.vector import similar_pairs
from loomspark.plans import fixtures as X

V = "doc_id long, vec array<double>"


def pairs_of(df):
    return {(r["a"], r["b"]) for r in df.select("a", "b").collect()}


def groups_of(pairs, nodes):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: top(x) for x in nodes}


def some(n, seed=0, centres=60, spread=0.25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16))
    return [(i, (middle[rng.integers(centres)] + spread * rng.normal(size=16)).tolist()) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_recall_of_pairs(spark, threshold):
    rows = spark.createDataFrame(some(900), V)
    want = pairs_of(similar_pairs(rows, threshold)[1])
    got = pairs_of(H.near_links(rows, threshold, recall=0.95, bits=6, every=True)[1])
    assert got <= want and len(got) >= 0.93 * len(want) > 1000


def test_recall_on_the_given_vectors(spark, sf):
    vectors = X.vectors(spark, sf)
    want = pairs_of(similar_pairs(vectors, 0.35)[1])
    got = pairs_of(H.near_links(vectors, 0.35, recall=0.95, every=True)[1])
    assert got <= want and len(got) >= 0.9 * len(want) > 0


@pytest.mark.parametrize("exact", [True, False])
def test_forests_connect_what_pairs_do(spark, monkeypatch, exact):
    monkeypatch.setattr(H, "BLOCK", 64)
    data = some(500, 3) + [(1000, some(1, 3)[0][1]), (1001, None), (1002, [0.0] * 16), (1003, [0.0] * 16)]
    rows = spark.createDataFrame(data, V)
    members, links = H.near_links(rows, 0.9, exact=exact)
    want = pairs_of(similar_pairs(rows, 0.9)[1])
    got = pairs_of(links)
    nodes = {i for i, v in data if v is not None} - {1000, 1003}
    assert got <= want and groups_of(got, nodes) == groups_of(want, nodes)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: i for i in nodes} | {1000: 0, 1003: 1002}
    grouped = {r["doc_id"]: r["root"] for r in H.near_groups(rows, 0.9, exact=exact).collect()}
    assert grouped == groups_of(want, nodes) | {1000: groups_of(want, nodes)[0], 1003: 1002}


def test_one_bucket_holds_all(spark, monkeypatch):
    """Near copies of one vector: links stay near the number of vectors, not of pairs."""
    monkeypatch.setattr(H, "BLOCK", 100)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, (np.ones(16) + 0.01 * rng.normal(size=16)).tolist()) for i in range(1000)], V)
    members, links = H.near_links(rows, 0.95, bits=2)
    assert members.count() == 1000 and links.count() < 1000 * 99 / 2
    assert H.near_groups(rows, 0.95, bits=2).agg(F.max("root")).first()[0] == 0


def test_tables():
    assert H.tables_for(0.95, 16, 0.99) > H.tables_for(0.95, 8, 0.99) and H.tables_for(1.0, 8, 0.99) == 1
    assert H.tables_for(0.0, H.bits_for(10**9, 0.0, 0.9), 0.9) <= H.MOST_TABLES


def test_empty(spark):
    members, links = H.near_links(spark.createDataFrame([], V), 0.5)
    assert members.count() == links.count() == 0


def test_a_vector_enters_a_bucket_once(spark, monkeypatch):
    """No bucket has two sides that hold the same vectors, and small buckets share a task's call."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.group import GroupedData

    def refused(*_):
        raise AssertionError("two sides")

    kept, wide = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "cogroup", refused)
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, kind: kept.append(self) or wide(self, f, kind))
    rows = spark.createDataFrame(some(900), V)
    _, links = H.near_links(rows, 0.9, every=True, bits=4)
    assert isinstance(links, DataFrame) and links.count() > 0
    assert kept[0].count().count() < 20  # groups, of some hundred buckets
