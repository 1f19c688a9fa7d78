"""Diversified order of a beam against the plain greedy rule."""

import random

import numpy as np

from loomspark.operators import graph as G


def test_mmr_equals_greedy_choice(spark):
    rng = random.Random(4)
    hits = [(q, f"n{i}", round(rng.random(), 2)) for q in range(6) for i in range(rng.randint(1, 9))]
    vecs = {f"n{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(8)}  # n8 has none
    got = {}
    found = G.mmr(spark.createDataFrame(hits, "qid long, node string, score double"), spark.createDataFrame(list(vecs.items()), "node string, vec array<double>"))
    for r in found.orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append(r["node"])
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    for q in range(6):
        left, chosen = {n: s for p, n, s in hits if p == q and n in vecs}, []
        while left:
            best = max(left, key=lambda n: (round(0.7 * left[n] - 0.3 * max((cos(vecs[n], vecs[c]) for c in chosen), default=0.0), 12), left[n], [-ord(c) for c in n]))
            chosen.append(best)
            del left[best]
        assert got.get(q, []) == chosen
