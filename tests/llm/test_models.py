"""The classifiers against plain versions: per-example updates over dictionaries, convolutions by loops, gradients by differences."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import language, quality

from test_mix_draw import hashed
from test_operators import ODD, documents, odd  # noqa: F401

ODDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
FULL = (1 << 64) - 1


def plain_features(text):
    """Counts of hashed n-grams of a text's words, and the number of words."""
    words, grams = (text or "").split(), Counter()
    word = [zlib.crc32(w.lower().encode()) for w in words]
    kind = [zlib.crc32(quality.shape(w).encode()) + (i > 0 and word[i] == word[i - 1]) for i, w in enumerate(words)]
    at = lambda x, i: x[i] if i < len(x) else 0
    for i in range(len(words)):
        pair = kind[i] * ODDS[1] + at(kind, i + 1)
        for k, x in enumerate((word[i], word[i] * ODDS[0] + at(word, i + 1), kind[i], pair, pair * ODDS[2] + at(kind, i + 2))):
            grams[((x * ODDS[0] + k * ODDS[1]) * ODDS[2] & FULL) >> (64 - quality.BITS)] += 1
    return grams, len(words)


def plain_model(rows, alpha=0.5, beta=1.0, l1=0.002, l2=0.02):
    """Weights after quality.EPOCHS passes of follow-the-regularised-leader updates, one example after another."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(quality.EPOCHS):
        for _, _, text, label in rows:
            grams, size = plain_features(text)
            x = {g: c * quality.SCALE / max(1, size) for g, c in grams.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_quality_equals_plain_updates(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] is not None:
            key = hashed(r["doc_id"])
            groups[key % quality.PARTS].append((key, r["doc_id"], texts[r["doc_id"]], r["quality"]))
    total = defaultdict(float)
    for rows in groups.values():
        for i, w in plain_model(sorted(rows)).items():
            total[i] += w / len(groups)
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        grams, size = plain_features(text)
        z = sum(total[g] * c for g, c in grams.items()) * quality.SCALE / max(1, size) + total["bias"]
        want = 1 / (1 + math.exp(-z))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)
        assert abs(want - 0.3) < 1e-6 or got[i]["predicted"] == (want >= 0.3)


def test_quality_reruns_agree_to_the_last_bit(spark, sf):
    run = lambda n: quality.train(documents(spark, sf).repartition(n), spark.read.parquet(f"{sf}/labels.parquet").repartition(n))
    assert (run(1) == run(7)).all()


def plain_prediction(net, raw):
    """Languages of a text by loops over windows, positions, taps and dimensions."""
    step = language.WINDOW - max(language.WIDTHS) + 1
    starts = range(0, max(1, len(raw) - max(language.WIDTHS) + 1), step)
    sums, total = np.zeros(len(net.languages)), 0
    for i, start in enumerate(starts):
        window = (raw[start : start + language.WINDOW] + b"\0" * language.WINDOW)[: language.WINDOW]
        length = max(1, min(step, len(raw) - i * step))
        pooled = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                pooled.append(max(sum(float(net.p["embed"][window[p + j]] @ net.p[f"w{w}"][j][:, f]) for j in range(w)) for p in range(language.WINDOW - w + 1)))
        hidden = np.maximum(np.array(pooled) + net.p["shift"], 0)
        z = hidden @ net.p["out"] + net.p["bias"]
        e = np.exp(z - z.max())
        sums, total = sums + e / e.sum() * length, total + length
    return sums / total


def test_language_equals_plain_convolution(spark, sf):
    net = language.train(documents(spark, sf))
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).where("length(text) < 900").orderBy("doc_id").limit(12).collect()]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, text in rows:
        want = plain_prediction(net, text.encode())
        assert got[i]["score"] == pytest.approx(want.max(), abs=1e-4)
        assert net.languages[int(want.argmax())] == got[i]["lang_pred"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = language.ByteNetwork(["a", "b", "c"])
    net.p |= {k: rng.normal(0, 0.3, net.p[k].shape) for k in ("out", "bias", "shift")}
    net.p["embed"][0] = 0
    x, own, weight = rng.integers(1, 256, (5, language.WINDOW), np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 2.0, 1.0])

    def exact_tables():
        return {w: net.p["embed"] @ net.p[f"w{w}"] for w in language.WIDTHS}

    net.tables = exact_tables
    loss = lambda: -np.mean(weight * np.log(net.predict(x, net.tables())[np.arange(5), own]))
    grad = net.gradients(x, own, weight)
    for name, g in grad.items():
        places = np.argsort(-np.abs(g).ravel())[:6]
        for at in places:
            place, h = np.unravel_index(at, g.shape), 1e-6
            kept = net.p[name][place]
            net.p[name][place] = kept + h
            high = loss()
            net.p[name][place] = kept - h
            low = loss()
            net.p[name][place] = kept
            assert (high - low) / (2 * h) == pytest.approx(g[place], rel=1e-3, abs=1e-7), name


def test_training_rows_are_the_smallest_hashes(spark, monkeypatch):
    """One language holds most rows, one a single one, one id many times."""
    rng = random.Random(2)
    rows = [(i, "text", "big" if rng.random() < 0.8 else rng.choice("abc")) for i in range(6000)] + [(7000, "x", "one")] + [(7001, "x", "same")] * 500 + [(None, "x", "big"), (7002, None, "big"), (7003, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = defaultdict(set)
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            want[lang].add((hashed(i), i))
    for total, each in ((25_600, 20), (12, 2)):
        monkeypatch.setattr(language, "TRAIN_DOCS", total)
        got = defaultdict(list)
        for r in language.training_rows(docs, 20).collect():
            got[r["own"]].append((r["key"], r["doc_id"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:each] for k, v in want.items()}


def test_empty_tables(spark, odd):  # noqa: F811
    assert language.identify(odd.limit(0)).count() == 0
    assert quality.quality_scores(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"} and unlabelled.count() == len(ODD)
