from loomspark.functions.embedding import embed_with, prefix


def test_failed_batches_are_null_and_open_the_breaker(spark):
    def provider(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(1, "ab"), (2, None), (3, "bad"), (4, "abc")]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", embed_with(provider, "t", batch=1, lead="q: ").alias("v")).collect()}
    assert got == {1: [5.0, 1.0], 2: None, 3: None, 4: [6.0, 1.0]}
    broken = [(i, "bad") for i in range(3)] + [(3, "ok")]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(broken, "i int, t string").coalesce(1).select("i", embed_with(provider, "t", batch=1).alias("v")).collect()}
    assert got[3] is None


def test_prefixes():
    assert prefix("nomic-embed-text", True) == "search_query: " and prefix("multilingual-e5", False) == "passage: " and prefix("other", True) == ""
