import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import analytics
from loomspark.plans.engine import Conflict, Documents, Memory, Store

NOTES = [
    ("The gateway was moved to the new region on 2024-03-05. Latency fell.", "infra"),
    ("Login tokens now rotate every hour. OAuth stays optional.", "auth"),
    ("Login with SSO was added for staff in April 2024.", "auth"),
    ("Lunch menu: soup and bread.", None),
    ("Lunch menu: soup and bread.", None),
    ("   ", None),
]


def test_memory_round_trip(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m", capacity=40)
    rows = spark.createDataFrame(NOTES, "body string, tag string")
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    assert {r["status"] for r in memory.add(rows, now).collect()} == {"ingested"}
    again = memory.add(rows, now).collect()
    assert len(again) == 4 and {r["status"] for r in again} == {"already_indexed"} and memory.list().count() == 4
    ids = {r["body"]: r["doc_id"] for r in memory._own("documents").collect()}
    gateway, tokens, sso = (ids[NOTES[i][0]] for i in range(3))

    asked = spark.createDataFrame([(1, "login tokens"), (2, "login besides SSO"), (3, "what happened in March 2024")], "qid long, text string")
    best = {r["qid"]: r["doc_id"] for r in memory.search(asked, as_of=now).where("rank = 1").collect()}
    assert best == {1: tokens, 2: tokens, 3: gateway}
    assert {r["tag"] for r in memory.search(asked, as_of=now, tags=["auth"]).collect()} == {"auth"}

    wide = memory.search(asked, as_of=now, expansion=spark.createDataFrame([(1, "oauth")], "qid long, expansion string"), expand_graph=True)
    assert {r["doc_id"] for r in wide.where("qid = 1").collect()} >= {tokens, sso}

    edges = memory._own("edges")
    assert edges.where(F.col("edge_type") == "same_tag").count() == 2
    assert {r["to_id"] for r in edges.where(F.col("from_id") == gateway).collect()} >= {"month:2024-03", "quarter:2024-Q1", "year:2024"}
    got = memory.get(spark.createDataFrame([(gateway,)], "doc_id string")).first()["body"]
    assert got.split() == NOTES[0][0].split()
    path = memory.path(spark.createDataFrame([(1, tokens, sso)], "pid long, a string, b string")).collect()
    assert [r["node"] for r in sorted(path, key=lambda r: r["step"])] == [tokens, sso]
    common = memory.common(spark.createDataFrame([(1, gateway), (1, sso)], "gid long, node string"))
    assert common.count() == 0
    assert memory.graph_search(asked).count() > 0

    gone = spark.createDataFrame([(sso,)], "doc_id string")
    memory.touch(spark.createDataFrame([(tokens,)], "doc_id string"), as_of=now)
    memory.invalidate(spark.createDataFrame([(gateway,)], "doc_id string"), now)
    assert memory._own("edges").where((F.col("from_id") == gateway) & F.col("invalid_at").isNull()).count() == 0
    memory.delete(gone)
    assert memory.list().count() == 3 and memory._own("chunks").where(F.col("doc_id") == sso).count() == 0
    assert memory._own("edges").where((F.col("from_id") == sso) | (F.col("to_id") == sso)).count() == 0
    surprising, stale = memory.dream(now)
    assert surprising.count() == 1 and stale.count() == 0
    assert memory.state().first()["last_doc_count"] == 3
    surprising, _ = memory.dream(F.to_timestamp(F.lit("2024-07-01 00:00:00")))
    assert surprising.count() == 0 and memory.store.table("state").count() == 1
    before = sorted(map(str, memory._own("edges").drop("seq").collect()))
    memory.store.compact()
    assert all(len(f) == 1 for f in memory.store.folders()[1].values())
    assert sorted(map(str, memory._own("edges").drop("seq").collect())) == before and memory.list().count() == 3


def test_commits_append_and_conflict(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    access = lambda i: spark.createDataFrame([(f"d{i}", "a")], "doc_id string, agent_id string").withColumn("ts", F.current_timestamp())
    store.commit({"access": access(1)})
    seq, seen = store.folders()
    store.commit({"access": access(2)}, after=seq)
    with pytest.raises(Conflict):
        store.commit({"access": access(3)}, after=seq)
    assert len(store.folders()[1]["access"]) == 2 and seen["access"] == store.folders()[1]["access"][:1]
    assert {r["doc_id"] for r in store.table("access").collect()} == {"d1", "d2"}


def test_chunks_like_known_ones_are_left_out(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m", analyse=None)
    add = lambda *rows: {r["chunks"] for r in memory.add(spark.createDataFrame(rows, "body string, session_id string, lines long")).collect()}
    assert add(("alpha beta gamma delta", "s1", 1), ("quite another note", "s1", 2)) == {1}
    assert add(("Alpha, beta, gamma, delta!", "s1", 3)) == {0}  # the same terms, so the same vector
    assert add(("one two three four", None, 4), ("One two three four.", None, 5)) == {0, 1}
    sessions = memory._own("edges").where("edge_type = 'co_session'")
    assert sessions.select("from_id").distinct().count() == 3 and sessions.join(sessions.selectExpr("to_id as from_id", "from_id as to_id"), ["from_id", "to_id"]).count() == sessions.count()
    ids = memory.list().select("doc_id").union(spark.createDataFrame([("none",)], "doc_id string"))
    got = memory.status(ids).collect()
    assert sum(r["indexed"] for r in got) == 5 and not any(r["has_failures"] for r in got)
    assert {r["attributes"] for r in memory.list().collect()} == {f'{{"lines":{i}}}' for i in range(1, 6)}
    assert memory.note(spark.createDataFrame([("a conclusion", []), ("another conclusion", ["x"])], "body string, source_ids array<string>")).count() == 1


def test_search_with_neighbours_exclusions_and_clusters(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m")
    memory.add(spark.createDataFrame([(b, t) for b, t in NOTES if b.strip()], "body string, tag string"))
    asked = spark.createDataFrame([(1, "rotating login token")], "qid long, text string")
    body = {r["doc_id"]: r["body"] for r in memory._own("documents").collect()}
    best = memory.search(asked).where("rank = 1").first()["doc_id"]
    assert body[best].startswith("Login tokens")  # stems meet
    barred = memory.search(asked, excluded=spark.createDataFrame([(1, ["Rotate"])], "qid long, excluded array<string>")).where("rank = 1").first()
    assert not body[barred["doc_id"]].startswith("Login tokens")
    merged = memory.merged_search(asked, 3, spark.createDataFrame([(1, "staff sso")], "qid long, text string"))
    assert merged.count() <= 3 and [r["rank"] for r in merged.orderBy("rank").collect()] == list(range(1, merged.count() + 1))
    got = [(r["cluster_id"], r["size"]) for r in memory.clusters().collect()]
    assert got == [("auth", 2), ("infra", 1), (None, 1)]


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Plan\nShip the index.\n\n# Notes\nNone yet.")
    (tmp_path / "in" / "b.py").write_text("def one():\n    return 1\n\ndef two():\n    return two_things\n")
    docs = Documents(spark, f"file://{tmp_path}/d")
    assert docs.ingest_files(str(tmp_path / "in")).count() == 2
    assert docs._own("chunks").where("body like '# def %(b.py:%'").count() == 2
    hit = docs.search(spark.createDataFrame([(1, "ship index")], "qid long, text string")).first()
    assert hit["rank"] == 1 and hit["l0"].startswith("# Plan")
    assert hit["doc_id"] == spark.createDataFrame([("# Plan\nShip the index.\n\n# Notes\nNone yet.",)], "b string").select(T.doc_id("b")).first()[0]


def numbers(terms):
    """An embedding that reads a vector from its text."""
    return F.transform(terms, lambda t: t.cast("float"))


@pytest.mark.parametrize("order, stay", [("abc", "ac"), ("bac", "b"), ("cab", "ca"), ("cba", "ca")])
def test_chunks_are_compared_in_the_order_of_arrival(spark, tmp_path, order, stay):
    """a ~ b ~ c, but a and c are apart: what stays is what a walk in that order keeps."""
    text = {"a": "100 0", "b": "96 28", "c": "84 54"}
    memory = Memory(spark, f"file://{tmp_path}/m", embed=numbers, analyse=None)
    rows = spark.createDataFrame([(text[x],) for x in order], "body string").repartition(1)
    chunks = {r["doc_id"]: r["chunks"] for r in memory.add(rows).collect()}
    bodies = {r["body"]: r["doc_id"] for r in memory._own("documents").collect()}
    assert {x for x in order if chunks[bodies[text[x]]] == 1} == set(stay)
    assert memory._own("rows").count() == len(stay)


def test_newest_members_of_clusters(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m", analyse=None)
    for day, names in ((1, "pq"), (9, "r"), (5, "st")):
        memory.add(spark.createDataFrame([(f"note {x} {x * 5}", "tag") for x in names], "body string, tag string"), F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00")))
    recent = memory.clusters().where("cluster_id = 'tag'").first()["recent"]
    body = {r["doc_id"]: r["body"] for r in memory._own("documents").collect()}
    assert [body[d][5] for d in recent][0] == "r" and {body[d][5] for d in recent} == {"r", "s", "t"}


def test_dreams_take_a_share_of_the_corpus_and_all_chunks(spark, tmp_path, monkeypatch):
    memory = Memory(spark, f"file://{tmp_path}/m", embed=numbers, analyse=None)
    asked = []

    def scored(vectors, fresh, share):
        asked.append((vectors.count(), fresh.count(), round(share, 6), {tuple(r["vec"]) for r in vectors.collect()}))
        return fresh.select("doc_id").limit(0)

    monkeypatch.setattr(analytics, "incremental_surprisal", scored)
    at = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d} 00:00:00"))
    axis = lambda i: " ".join("1" if k == i else "0" for k in range(12))
    memory.add(spark.createDataFrame([(axis(i),) for i in range(8)], "body string"), at(1))
    memory.dream(at(2))
    rows = spark.createDataFrame([("two parts", 0, axis(8)), ("two parts", 1, axis(9)), (axis(10), 0, axis(10))], "body string, chunk_no long, part string")
    chunks = rows.select(T.doc_id("body").alias("body_id"), "chunk_no", F.col("part").alias("body"))
    memory.add(rows.select("body").distinct(), at(3), chunks=chunks)
    memory.dream(at(4))
    assert asked[0][:3] == (8, 8, 0.15) and asked[1][:3] == (10, 2, 0.75)
    assert tuple(0.5 if k in (8, 9) else 0.0 for k in range(12)) in asked[1][3]  # the mean of both chunks
