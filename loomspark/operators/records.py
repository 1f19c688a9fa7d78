"""Sessions, access counters, documents and consolidation state as tables of events: the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in order."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def scratch(writes: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Current values of (agent_id, session_id, key) from writes (.., value, updated_at, seq); a later delete removes."""
    rows = writes.withColumn("gone", F.lit(False))
    if deletes is not None:
        rows = rows.unionByName(deletes.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    return latest(rows, ["agent_id", "session_id", "key"], F.desc("updated_at"), F.desc("seq")).where("not gone").drop("gone", "seq")


def tasks(log: DataFrame, status: str | None = None) -> DataFrame:
    """Tasks by their latest log entry (agent_id, session_id, task_id, title, status, at, seq)."""
    rows = latest(log, ["agent_id", "session_id", "task_id"], F.desc("at"), F.desc("seq"))
    return rows if status is None else rows.where(F.col("status") == status)


def history(rows: DataFrame, limit: int, term: str | None = None) -> DataFrame:
    """Each agent's newest entries, of those that contain term (any case) if one is given."""
    found = rows if term is None else rows.where(F.contains(F.lower("content"), F.lower(F.lit(term))))
    newest = W.partitionBy("agent_id").orderBy(F.desc("id"))
    return found.withColumn("place", F.row_number().over(newest).cast("long")).where(F.col("place") <= limit)


def access_counts(events: DataFrame) -> DataFrame:
    """Per agent and over all agents (agent_id null): count and last access."""
    grouped = events.rollup("doc_id", "agent_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"), F.grouping_id().alias("level"))
    return grouped.where("level < 3").select("doc_id", F.when(F.col("level") == 0, F.col("agent_id")).alias("agent_id"), F.col("level").cast("long").alias("level"), "access_count", "last_accessed")


def new_since(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (corpus, doc_id, inserted_at) later than their corpus's mark in state (corpus, last_dream_at); all without."""
    marks = state.select("corpus", "last_dream_at")
    return rows.join(marks, "corpus", "left").where("last_dream_at is null or inserted_at > last_dream_at").drop("last_dream_at")


def dream_gate(rows: DataFrame, state: DataFrame, least: int = 20) -> DataFrame:
    """Corpora with `least` documents or more, and as many more than at their last cycle."""
    counts = rows.groupBy("corpus").agg(F.count("*").alias("docs"))
    joined = counts.join(state.select("corpus", "last_doc_count"), "corpus", "left").fillna(0, ["last_doc_count"])
    return joined.withColumn("due", (F.col("docs") >= least) & (F.col("docs") - F.col("last_doc_count") >= least))


def save_state(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """state (corpus, last_dream_at, last_doc_count) with fresh rows in place of old ones."""
    return state.join(fresh.select("corpus"), "corpus", "left_anti").unionByName(fresh)


def stale(docs: DataFrame, access: DataFrame, as_of: Column, days: int = 90, levels: tuple = ("explicit", "action")) -> DataFrame:
    """Documents (doc_id, level, created_at) of those levels, never accessed and at least `days` old."""
    old = docs.where(F.col("level").isin(*levels) & (F.datediff(as_of, "created_at") >= days))
    return old.join(access.select("doc_id").distinct(), "doc_id", "left_anti")


def reassemble(chunks: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """(doc_id, body): chunks (doc_id, chunk_no, body) in the order of their numbers."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "body")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda c: c["body"]), joiner).alias("body"))


def list_documents(docs: DataFrame, corpus: str | None = None) -> DataFrame:
    """(doc_id, title, chars) of a corpus's documents, one row each; the longest version of a repeated id counts."""
    rows = docs if corpus is None else docs.where(F.col("corpus") == corpus)
    return latest(rows.withColumn("chars", F.length("body").cast("long")), ["doc_id"], F.desc("chars"), F.asc("source_id")).select("doc_id", "source_id", "chars")


def clusters(members: DataFrame, most: int = 8, newest: int = 3, newest_by: str = "doc_id") -> DataFrame:
    """(cluster_id, size, recent) of members (cluster_id, doc_id, <newest_by>): the largest clusters with their newest
    members, newest first and ties by the larger doc_id, and all others' members as one row without an id."""
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc(newest_by), F.desc("doc_id")))
    recent = members.withColumn("place", place).where(F.col("place") <= newest).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("recent"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    best = sizes.where("cluster_id is not null").orderBy(F.desc("size"), "cluster_id").limit(most).join(recent, "cluster_id")
    rest = sizes.join(best.select("cluster_id"), "cluster_id", "left_anti").agg(F.sum("size").alias("size")).where("size is not null")
    return best.select("cluster_id", "size", "recent").unionByName(rest, allowMissingColumns=True)


def upsert_documents(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Documents by doc_id, fresh ones in place of old ones; of repeated fresh ids the largest body counts."""
    once = fresh.groupBy("doc_id").agg(F.max_by(F.struct(*fresh.columns), "body").alias("row")).select("row.*")
    return old.join(once.select("doc_id"), "doc_id", "left_anti").unionByName(once)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of gone (doc_id): documents, chunks, vectors, access."""
    ids = gone.select("doc_id").distinct()
    return {name: rows.join(ids, "doc_id", "left_anti") for name, rows in tables.items()}
