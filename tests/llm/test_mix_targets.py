"""op10 against its targets: sources at their limit are taken exactly three times, others to half a block."""

from collections import defaultdict

from pyspark.sql import functions as F

from loomspark.llm import mixing


def test_small_sources_meet_their_targets(spark, tmp_path):
    words = {"a": 5, "b": 10, "c": 33, "d": 100, "e": 1, "f": 47, "g": 0, "h": 4000, "i": 90001, "j": 3333, "k": 64, "l": 120, "m": 31}
    rows = [(f"{s}{i}", s, " ".join(["w"] * min(70, n - i))) for s, n in words.items() for i in range(0, max(n, 1), 70)]
    spark.createDataFrame(rows, "doc_id string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    taken, target, places = defaultdict(int), {}, []
    for r in mixing.op10_mix_sources(spark, str(tmp_path)).collect():
        s = r["doc_id"][0]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert sum(p["words"] for p in r["places"] or []) == r["taken"]
        places += [(p["shard"], p["slot"], p["words"]) for p in r["places"] or []]
    capped = [s for s, n in words.items() if target[s] == 3 * n]
    assert set("abcde") <= set(capped) and len(capped) < len(words)
    assert all(taken[s] == 3 * words[s] for s in capped)
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS / 2 for s in words)
    filled = {(a, b) for a, b, _ in places}
    assert max(a * mixing.SHARD_SLOTS + b for a, b in filled) + 1 == len(filled)


def test_parts_of_passes_meet_any_target(spark):
    rows = spark.range(1, 200).select(F.col("id").alias("source_size"), F.explode(F.sequence(F.lit(0), F.lit(60))).alias("part"))
    rows = rows.select("source_size", (F.col("source_size") * F.col("part") / 20.0).alias("target"), F.xxhash64("source_size", "part").alias("rank"), F.ceil(F.col("source_size") / 32).alias("blocks"))
    for r in mixing.passes(rows, 32, 1).collect():
        full = r["slots"] - r["whole"] * r["blocks"] - r["extra"]
        got = r["whole"] * r["source_size"] + 32 * full + r["extra"] * (r["source_size"] - 32 * (r["blocks"] - 1))
        assert 0 <= full < r["blocks"] and abs(got - r["target"]) <= 16, r
