import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomspark.operators import records as R
from loomspark.plans.engine import Memory
from loomspark.sources.files import allowed, documents_from, read_files
from loomspark.streaming import access as S
from loomspark.streaming import ingest as I


def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf)


def test_streamed_counters_equal_the_batch(spark, sf, tmp_path):
    shape = lambda df: df.select((F.col("event_id") % 50).alias("doc_id"), (F.col("user_id") % 4).alias("agent_id"), "ts")
    got = S.run_available(S.access_counters(shape(stream(spark, sf))), "counters", "complete", str(tmp_path))
    want = S.access_counters(shape(spark.read.parquet(f"{sf}/events.parquet")))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_streamed_windows_equal_the_batch(spark, sf, tmp_path):
    got = S.run_available(S.tumbling(stream(spark, sf)).select("start", "event_type", "n"), "windows", "complete", str(tmp_path))
    want = S.tumbling(spark.read.parquet(f"{sf}/events.parquet")).select("start", "event_type", "n")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_breaker(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [("s", at(0), False), ("s", at(1), False), ("s", at(2), False), ("s", at(3), True), ("s", at(70), False), ("s", at(80), True), ("s", at(140), True), ("s", at(141), True)]
    rows = spark.createDataFrame(calls, "service string, at timestamp, ok boolean")
    met = [r["met"] for r in S.breaker(rows, streaming=False).orderBy("at").collect()]
    assert met == ["closed", "closed", "closed", "open", "half_open", "open", "half_open", "closed"]
    rows.write.parquet(str(tmp_path / "calls"))
    live = S.breaker(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls")))
    got = S.run_available(live, "breaker", "append", str(tmp_path / "cp"))
    assert [r["met"] for r in got.orderBy("at").collect()] == met


def test_ingest_counts_each_batch_once(spark, tmp_path):
    """A writer that dies after its commit, and the same batch once more after the restart."""
    memory = Memory(spark, f"file://{tmp_path}/m", analyse=None)
    texts = lambda a, b: [(f"note number {i} about topic {i} alone t{i}x{i}", f"tag{i % 2}") for i in range(a, b)]
    write = lambda a, b: spark.createDataFrame(texts(a, b), "body string, tag string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(0, 4)
    live = spark.readStream.schema("body string, tag string").parquet(str(tmp_path / "in"))
    run = lambda m: I.ingest(m, live, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    add = memory.add

    def dies(rows, **options):
        add(rows, **options)
        raise RuntimeError("lost after the commit")

    memory.add = dies
    with pytest.raises(Exception, match="lost after the commit"):
        run(memory)
    assert memory.list().count() == 4 and memory.store.last_batch("ingest") == 0
    again = Memory(spark, f"file://{tmp_path}/m", analyse=None)
    commits = again.store.folders()[0]
    run(again)
    assert again.list().count() == 4 and again.store.folders()[0] == commits
    write(4, 6)
    run(again)
    assert again.list().count() == 6 and again.store.last_batch("ingest") == 1 and again.store.folders()[0] == commits + 1
    assert again._own("chunks").groupBy("doc_id", "chunk_no").count().where("count > 1").count() == 0


def test_gate_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i % 4}", i) for i in range(150) if i % 4 != 3 or i < 60], "corpus string, doc_id long")
    rows.where("doc_id < 70").write.parquet(str(tmp_path / "docs"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "docs"))

    def fired():
        """What a run of all that is there adds; the second one goes on from the first one's state."""
        I.due_corpora(live, 15).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return {(r["corpus"], r["docs"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    state = spark.createDataFrame([], "corpus string, last_dream_at timestamp, last_doc_count long")
    first = R.dream_gate(rows.where("doc_id < 70"), state, 15).where("due").collect()
    before = {(r["corpus"], r["docs"]) for r in first}
    assert fired() == before and len(first) == 4
    rows.where("doc_id >= 70").write.mode("append").parquet(str(tmp_path / "docs"))
    marks = spark.createDataFrame([(r["corpus"], None, r["docs"]) for r in first], state.schema)
    then = {(r["corpus"], r["docs"]) for r in R.dream_gate(rows, marks, 15).where("due").collect()}
    assert fired() == before | then and 0 < len(then) < 4


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("Plan of 2024-03-01. More.")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9")
    (tmp_path / "copy.md").write_text("Plan of 2024-03-01. More.")
    rows = read_files(spark, str(tmp_path))
    assert {r["title"]: r["body"] for r in rows.collect()} == {"a.md": "Plan of 2024-03-01. More.", "copy.md": "Plan of 2024-03-01. More.", "bad.txt": "caf\ufffd"}
    docs = documents_from(rows, "agent:x")
    assert docs.count() == 2 and docs.where("size(dates) = 1").first()["l0"] == "Plan of 2024-03-01."
    assert documents_from(rows, "agent:x", docs).count() == 0
    paths = spark.createDataFrame([("file:///etc/passwd",), ("/home//x/.ssh/id",), ("/data/x",)], "p string")
    assert [r[0] for r in paths.select(allowed("p")).collect()] == [False, False, True]
