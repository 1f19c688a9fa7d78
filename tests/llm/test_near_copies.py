"""The pipeline's near-duplicate stage against brute force at a five-word Jaccard similarity of 0.8."""

import corpus_pipeline
from loomspark.llm import near_copies

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}


def brute_kept(rows):
    """Smallest id of each group, by comparing all pairs."""
    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i for i in ids if root[i] == i}


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect())


def changed(n):
    """WORDS with n words changed, far apart: five shingles lost and five gained by each."""
    out = list(WORDS)
    for i in range(n):
        out[20 + 40 * i] = "other"
    return " ".join(out)


def test_stage_takes_five_words_and_four_fifths(spark, monkeypatch):
    far = " ".join(x for i, x in enumerate(WORDS) if i % 2)
    rows = [(1, changed(0)), (2, changed(8)), (3, changed(0).upper() + " "), (4, far), (5, None), (6, " "), (7, "a b"), (8, "a c"), (9, "A  b")]
    rows += [(20 + i, " ".join(WORDS[60 * i : 60 * i + 60]) + " tail") for i in range(6)]
    want = sorted(brute_kept(rows))
    assert 2 not in want and 3 not in want and 4 in want
    assert kept(spark, rows) == want
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    assert kept(spark, rows + [(50 + i, changed(0) + f" {i}") for i in range(9)]) == want


def test_stage_equals_brute_force_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert kept(spark, rows) == sorted(brute_kept(rows))


def test_links_of_both_methods_make_groups_together(spark):
    """SimHash is a method of the stage: a text that it alone links joins the group, also through a MinHash link."""
    from loomspark.llm.near_copies import near_groups
    from loomspark.llm.simhash import joined_groups, keep_one, simhash_groups

    base = WORDS * 3
    spread = [w if i % 20 else f"x{i}" for i, w in enumerate(base)]  # half of its five-word shingles are others
    rows = [(1, " ".join(base)), (2, " ".join(base[:-2])), (3, "some other text"), (4, None), (5, " ".join(spread))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = {r["doc_id"]: r["root"] for r in joined_groups(simhash_groups, near_groups)(docs).collect()}
    alone = [{r["doc_id"]: r["root"] for r in method(docs).collect()} for method in (simhash_groups, near_groups)]
    for one in alone:
        assert all(both[a] == both[b] for a in one for b in one if one[a] == one[b])
    pairs = spark.createDataFrame([(1, 10, 7), (2, 20, 7), (3, 30, 9)], "doc_id long, text_hash long, root long")
    others = spark.createDataFrame([(1, 10, 7), (2, 20, 8), (3, 30, 8)], "doc_id long, text_hash long, root long")
    assert len({r["root"] for r in joined_groups(lambda d: pairs, lambda d: others)(docs).collect()}) == 1
    assert sorted(r["doc_id"] for r in keep_one(docs, joined_groups(simhash_groups, near_groups)).collect())[:1] == [1]
