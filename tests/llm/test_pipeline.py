"""The pipeline's stages, each on what its predecessor kept, against brute-force versions."""

import corpus_pipeline
from loomspark.llm import decontaminate, quality
from loomspark.session import materialize

from test_near_copies import brute_kept
from test_operators import DOCS, ODD, brute_coverage, expected_tokens


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mixture", "token_files"]

    good = materialize(stages["quality"](spark, docs, sf), "good")
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3} and good.columns == columns

    unique = materialize(stages["near_duplicates"](spark, good, sf), "unique")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in unique.collect()} == brute_kept(rows) and unique.columns == columns

    clean = materialize(stages["decontaminate"](spark, unique, sf), "clean")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    five = lambda t: {tuple(w[i : i + 5]) for w in [decontaminate.tokens(t)] for i in range(len(w) - 4)}
    grams = {t: five(t) for t in items}
    hit = lambda text: any(g & own and brute_coverage(text, t) >= decontaminate.THRESHOLD for own in [five(text)] for t, g in grams.items())
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in unique.collect() if not hit(r["text"])} and clean.columns == columns

    mixed = materialize(stages["mixture"](spark, clean, sf), "mixed")
    whole = {r["doc_id"]: r["text"].split() for r in clean.collect()}
    seen = {}
    for r in mixed.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + len(r["text"].split())
        assert set(r["text"].split()) <= set(whole[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert all(n <= 3 * len(whole[i]) for i, n in seen.items()) and mixed.columns == columns
    assert abs(sum(seen.values()) / sum(map(len, whole.values())) - 1) < 0.05

    out = stages["token_files"](spark, mixed, sf).collect()
    want = expected_tokens([(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((i, n, c) for i, _, n, c in want)
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted(r["doc_id"] for r in ordered)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    docs.unpersist()


def test_odd_rows_in_chain(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows and ids, an extra column with a clashing name."""
    sf = str(tmp_path)
    columns = DOCS + ", size string"
    spark.createDataFrame([(*r, "clash") for r in ODD], columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "Same words again and again."), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        fresh = materialize(stage(spark, docs, sf), name)
        kept[name] = [r["doc_id"] for r in fresh.collect()]
        assert name == "token_files" or fresh.columns == docs.columns
        docs = fresh
    by_id = lambda ids: sorted(ids, key=lambda i: (i is not None, i or 0))
    assert by_id(kept["quality"]) == by_id(r[0] for r in ODD)  # without labels nothing is rejected
    assert by_id(kept["near_duplicates"]) == [None, 1, 3, 5]  # texts without words are copies of each other
    assert by_id(kept["decontaminate"]) == [None, 1, 5]
    assert set(kept["mixture"]) <= {None, 5} and set(kept["token_files"]) == set(kept["mixture"])


def test_empty_tables_in_chain(spark, tmp_path):
    sf = str(tmp_path)
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
