"""The engine as a user calls it: tables in a folder, one class for memory, documents and sessions.

Tables are Parquet folders. A commit is one file of the log, named by its number and created only if it isn't there: it
lists folders that are added to tables, and tables that start anew. So readers see a commit as a whole, writes append
what is new instead of rewriting tables, and of two writers that take the same number one fails. All methods take and
return DataFrames; text becomes vectors through `embed`, a function of an array of terms (a Column) to a vector, the
hashing embedder by default.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.chunking import CAPACITY, chunk_files, chunk_text
from loomspark.operators import analytics, fusion, graph, records
from loomspark.operators.bm25 import BLOCKS, ROWS, Analyser, Postings, postings, stemmed
from loomspark.operators.vector import hash_embed, mean_vectors, vector_topk, without_near_greedy
from loomspark.session import materialize
from loomspark.sources.files import documents_from, read_files

EDGES = "from_id string, to_id string, edge_type string, corpus string, weight double, valid_at timestamp, invalid_at timestamp"
SCHEMAS = {
    "documents": "doc_id string, corpus string, title string, tag string, level string, session_id string, source_ids array<string>, attributes string, body string, l0 string, dates array<date>, content_hash string, chunks long, failed_chunks long, inserted_at timestamp",
    "chunks": "doc_id string, corpus string, chunk_no long, body string",
    "blocks": BLOCKS,
    "rows": ROWS.format(kind="string"),
    "vectors": "doc_id string, corpus string, chunk_no long, vec array<float>",
    "edges": f"{EDGES}, seq long",
    "access": "doc_id string, agent_id string, ts timestamp",
    "state": "corpus string, last_dream_at timestamp, last_doc_count long",
}
EXTRA = {"title": "string", "tag": "string", "level": "string", "session_id": "string", "source_ids": "array<string>"}
DUPLICATE = 0.95
#: Bits of a chunk's number in a key that orders chunks; the others number documents of one call.
CHUNK_BITS = 24


class Conflict(RuntimeError):
    """Another writer has taken the commit's number; the caller reads again and repeats its change."""


class Store:
    """Versioned tables in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def log(self) -> list[tuple[int, dict]]:
        """(number, change) of every commit in order; a change has `add`, folders by table, and `anew`, tables."""
        where, files = self._files()
        if not files.exists(where):
            return []
        rows = self.spark.read.text(where.toString()).select("value", F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)", 1).cast("long").alias("seq")).collect()  # a row per commit since the last compact()
        return sorted((r["seq"], json.loads(r["value"])) for r in rows)

    def folders(self) -> tuple[int, dict[str, list[str]]]:
        """The last commit's number (-1 if there is none) and the folders of each table."""
        seq, found = -1, {}
        for seq, change in self.log():
            for name in change["anew"]:
                found[name] = []
            for name, folder in change["add"].items():
                found.setdefault(name, []).append(folder)
        return seq, found

    def table(self, name: str, seen: dict[str, list[str]] | None = None) -> DataFrame:
        folders = (self.folders()[1] if seen is None else seen).get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def last_batch(self, name: str) -> int:
        """The number of the last batch of a stream that a commit carries, -1 if none does."""
        return max((change["batch"][1] for _, change in self.log() if change.get("batch", [None])[0] == name), default=-1)

    def commit(self, add: dict[str, DataFrame], anew: dict[str, DataFrame] | None = None, after: int | None = None, batch: tuple[str, int] | None = None) -> None:
        """Append to tables and start others anew, as the commit that follows number `after` (the last one read). batch is
        the stream and the number that the commit stands for."""
        anew = anew or {}
        after = self.folders()[0] if after is None else after
        change = {"add": {}, "anew": sorted(anew)} | ({"batch": list(batch)} if batch else {})
        for name, df in {**add, **anew}.items():
            folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
            fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(folder)
            change["add"][name] = folder
        where, files = self._files()
        file = self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{after + 1:012d}.json")
        try:
            out = files.create(file, False)
        except Exception as e:  # the file system's own exceptions differ; whether the number is taken doesn't
            if files.exists(file):
                raise Conflict(f"commit {after + 1} of {self.path} is taken") from e
            raise
        out.write(bytearray(json.dumps(change).encode()))
        out.close()

    def compact(self) -> None:
        """Rewrite every table as one folder; edges keep the last row of each key."""
        seq, seen = self.folders()
        tables = {name: self.table(name, seen) for name in seen}
        if "edges" in tables:
            tables["edges"] = graph.last_written(tables["edges"])
        self.commit({}, tables, seq)


class Memory:
    """add, search, get, list, graph_search, path, common, analyze, invalidate, delete over one corpus."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        corpus: str = "agent:default",
        embed: Callable[[Column], Column] = hash_embed,
        capacity: int = CAPACITY,
        params: fusion.SearchParams = fusion.PRESETS["memory"],
        analyse: Analyser | None = stemmed,
    ):
        self.store, self.corpus, self.embed, self.capacity, self.params, self.analyse = Store(spark, path), corpus, embed, capacity, params, analyse
        self.spark = spark

    def _own(self, name: str, seen: dict[str, list[str]] | None = None) -> DataFrame:
        rows = self.store.table(name, seen).where(F.col("corpus") == self.corpus)
        return graph.last_written(rows) if name == "edges" else rows

    def add(self, rows: DataFrame, as_of: Column | None = None, similar: float = 0.8, chunks: DataFrame | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
        """Ingest rows (body, and title, tag, level, session_id, source_ids if there): documents new by content with their
        chunks, vectors and edges to sources, periods, alike documents and documents of the same tag and session. Other
        columns become JSON attributes. chunks (body_id, chunk_no, body) may come from the caller, body_id being the
        document's id. Of chunks with a cosine of DUPLICATE to one that is there or to each other, one stays. Returns
        (doc_id, status, chunks): status `ingested`, or `already_indexed` for known content. A batch (stream, number) that
        was committed before adds nothing."""
        seq, seen = self.store.folders()
        if batch and self.store.last_batch(batch[0]) >= batch[1]:
            return rows.where(F.trim("body") != "").select(T.doc_id("body").alias("doc_id"), F.lit("already_indexed").alias("status"), F.lit(None).cast("long").alias("chunks")).distinct()
        now = F.current_timestamp() if as_of is None else as_of
        other = [c for c in rows.columns if c not in EXTRA and c != "body"]  # before columns of our own
        rows = rows.withColumn("attributes", F.to_json(F.struct(*other)) if other else F.lit(None).cast("string"))
        for name, kind in EXTRA.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        known = self._own("documents", seen)
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
        made = documents_from(rows.select("body"), self.corpus, known)
        arrival = self._arrival(rows)
        kept = [*EXTRA, "attributes"]
        meta = rows.select(T.doc_id("body").alias("doc_id"), *kept).groupBy("doc_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept])
        docs = materialize(made.join(meta, "doc_id").withColumn("inserted_at", now), "documents")
        cut = chunk_text(docs, self.capacity) if chunks is None else chunks.withColumnRenamed("body_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
        parts = materialize(cut.withColumn("corpus", F.lit(self.corpus)), "chunks")
        vectors = materialize(parts.select("doc_id", "corpus", "chunk_no", self.embed(T.terms("body")).alias("vec")), "vectors")
        vectors, dropped = self._without_known(vectors, self._own("vectors", seen), arrival)
        parts = materialize(parts.join(dropped, ["doc_id", "chunk_no"], "left_anti"), "chunks")
        counts = parts.join(vectors.select("doc_id", "chunk_no", F.col("vec").isNull().alias("failed")), ["doc_id", "chunk_no"]).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("failed").alias("failed_chunks"))
        docs = docs.join(counts, "doc_id", "left").fillna(0, ["chunks", "failed_chunks"]).withColumn("content_hash", F.hex(F.xxhash64("body")))
        docs = materialize(docs, "documents")
        edges = self._edges(docs, known, vectors, self._own("vectors", seen), now, similar).withColumn("seq", F.lit(seq + 1))
        self.store.commit({"documents": docs, "chunks": parts, **self._indexed(parts, seq + 1), "vectors": vectors, "edges": edges}, after=seq, batch=batch)
        asked = rows.where(F.trim("body") != "").select(T.doc_id("body").alias("doc_id")).distinct()
        fresh = docs.select("doc_id", F.lit("ingested").alias("status"), "chunks")
        return asked.join(fresh, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("already_indexed")).alias("status"), "chunks")

    def _indexed(self, chunks: DataFrame, segment: int) -> dict[str, DataFrame]:
        """Tables of the index of chunks, dealt by ranges of terms."""
        made = postings(chunks, self.analyse, segment)
        return {"blocks": made.blocks.repartitionByRange(made.tasks, "bucket", "term", "block").sortWithinPartitions("bucket", "term", "block"), "rows": made.rows}

    def _without_known(self, fresh: DataFrame, known: DataFrame, arrival: DataFrame) -> tuple[DataFrame, DataFrame]:
        """fresh vectors without those that are copies, and the (doc_id, chunk_no) of the latter. As if chunks came one
        after another, by arrival (doc_id, arrival) and number: each goes if one that is there or has stayed is near it.
        Zero vectors are near nothing."""
        key = F.shiftleft("arrival", CHUNK_BITS) + F.col("chunk_no")
        keyed = materialize(fresh.where("vec is not null").where(F.exists("vec", lambda x: x != 0)).join(arrival, "doc_id").withColumn("key", key), "keyed")
        near = vector_topk(known, keyed.select(F.col("key").alias("qid"), F.col("vec").alias("qvec")), 1, DUPLICATE).select(F.col("qid").alias("key"))
        unknown = materialize(keyed.join(near, "key", "left_anti"), "unknown")
        stay = without_near_greedy(unknown.select(F.col("key").alias("doc_id"), "vec"), DUPLICATE).select(F.col("doc_id").alias("key"))
        gone = materialize(keyed.join(stay, "key", "left_anti").select("doc_id", "chunk_no"), "copies")
        return materialize(fresh.join(gone, ["doc_id", "chunk_no"], "left_anti"), "vectors"), gone

    def _arrival(self, rows: DataFrame) -> DataFrame:
        """(doc_id, arrival): places of documents in the order of rows, without the gaps between partitions."""
        first = rows.groupBy(T.doc_id("body").alias("doc_id")).agg(F.min("__row").alias("row")).withColumn("part", F.shiftright("row", 33))
        sizes = rows.groupBy(F.shiftright("__row", 33).alias("part")).agg((F.max("__row") % (1 << 33) + 1).alias("n"))  # a row per partition
        starts = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))
        return materialize(first.join(starts, "part").select("doc_id", (F.col("start") + F.col("row") % (1 << 33)).alias("arrival")), "arrival")

    def _edges(self, docs: DataFrame, known: DataFrame, vectors: DataFrame, old: DataFrame, now: Column, similar: float) -> DataFrame:
        """Edges of new documents, in the columns of EDGES."""
        every = old.unionByName(vectors)
        near = vector_topk(every, vectors.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec")), 5, similar, skip_self=True)
        near = near.groupBy("qid", "doc_id").agg(F.max("sim").alias("weight")).select(F.col("qid").alias("from_id"), F.col("doc_id").alias("to_id"), F.lit("related_to").alias("edge_type"), "weight")
        parts = [
            near,
            near.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "edge_type", "weight"),
            graph.source_edges(docs.where("source_ids is not null")),
            docs.select(F.col("doc_id").alias("from_id"), F.explode(T.periods("dates")).alias("to_id"), F.lit("occurred_in").alias("edge_type"), F.lit(1.0).alias("weight")),
        ]
        for column, kind, weight in (("tag", "same_tag", 0.6), ("session_id", "co_session", 0.5)):
            fresh = docs.where(F.col(column).isNotNull()).select("doc_id", column)
            rest = known.select("doc_id", column).join(fresh.select(column).distinct(), column, "left_semi").select("doc_id", column)
            parts.append(graph.attribute_edges(rest.unionByName(fresh), column, kind, weight))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.dropDuplicates(graph.KEY).select("from_id", "to_id", "edge_type", F.lit(self.corpus).alias("corpus"), F.col("weight").cast("double").alias("weight"), now.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))

    def add_files(self, path: str) -> DataFrame:
        """Ingest readable files under path, cut by their kind: code by symbols, Markdown by headings, the rest as text."""
        files = materialize(read_files(self.spark, path), "files")
        once = files.groupBy(T.doc_id("body").alias("body_id")).agg(F.min("path").alias("path"))
        chunks = chunk_files(files.select("path", "body"), self.capacity).join(once, "path").select("body_id", "chunk_no", "body")
        return self.add(files.select("body", "title", "path"), chunks=materialize(chunks, "file-chunks"))

    def status(self, ids: DataFrame) -> DataFrame:
        """(doc_id, indexed, has_failures, content_hash) of ids (doc_id)."""
        own = self._own("documents").select("doc_id", F.lit(True).alias("known"), (F.col("failed_chunks") > 0).alias("failed"), "content_hash")
        rows = ids.select("doc_id").distinct().join(own, "doc_id", "left")
        return rows.select("doc_id", F.coalesce("known", F.lit(False)).alias("indexed"), F.coalesce("failed", F.lit(False)).alias("has_failures"), "content_hash")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.select("qid", "text", self.embed(T.terms("text")).alias("qvec"))

    def search(self, queries: DataFrame, agent: str = "default", as_of: Column | None = None, tags: list[str] | None = None, expansion: DataFrame | None = None, excluded: DataFrame | None = None, expand_graph: bool = False, sources: list[str] | None = None) -> DataFrame:
        """(qid, doc_id, rrf, embedding, bm25, rank, l0, tag) for queries (qid, text); expansion (qid, expansion) and
        excluded (qid, excluded) may come from a language model. With expand_graph, near documents two hops around the
        best hits join them. sources leaves only documents that name one of them."""
        docs, vectors = self._own("documents"), self._own("vectors")
        access = records.access_counts(self.store.table("access")).where("level = 0")
        corpus = fusion.Corpus(docs.select("doc_id", "body", F.col("dates").alias("days")), Postings(self.store.table("blocks"), self.store.table("rows")), vectors, self._own("edges"), access, self.corpus)
        only = None if sources is None else docs.where(F.arrays_overlap("source_ids", F.array(*[F.lit(s) for s in sources]))).select("doc_id")
        named = docs.select("doc_id", "l0", "tag")
        keep = lambda hits: hits.join(named if tags is None else named.where(F.col("tag").isin(*tags)), "doc_id", "left_semi")
        now = F.current_timestamp() if as_of is None else as_of
        best = fusion.search(corpus, queries, self.embed, now, self.params, agent, self.analyse, expansion, excluded, keep, only, expand_graph)
        return best.join(named, "doc_id")

    def touch(self, docs: DataFrame, agent: str = "default", as_of: Column | None = None) -> None:
        """Record an access of docs (doc_id)."""
        now = F.current_timestamp() if as_of is None else as_of
        self.store.commit({"access": docs.select("doc_id", F.lit(agent).alias("agent_id"), now.alias("ts"))})

    def get(self, ids: DataFrame) -> DataFrame:
        """(doc_id, body): documents of ids (doc_id) put together from their chunks."""
        return records.reassemble(self._own("chunks").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))

    def list(self) -> DataFrame:
        return self._own("documents").select("doc_id", "title", "tag", "attributes", "l0", F.length("body").alias("chars"), "inserted_at")

    def clusters(self) -> DataFrame:
        """(cluster_id, size, recent): the largest tags with their newest documents; the rest as one row without an id."""
        return records.clusters(self._own("documents").select(F.col("tag").alias("cluster_id"), "doc_id", "inserted_at"), newest_by="inserted_at")

    def merged_search(self, queries: DataFrame, limit: int = 10, use_case: DataFrame | None = None, **options) -> DataFrame:
        """(qid, node, rrf, rank): hits of search() and their graph neighbours at half their score. use_case (qid, text)
        re-ranks both by their cosine to it."""
        hits = self.search(queries, **options).where(F.col("rank") <= limit).select("qid", F.col("doc_id").alias("node"), "rrf")
        hits = materialize(hits, "hits")
        vectors = self._own("vectors").select(F.col("doc_id").alias("node"), "vec")
        seeds = hits.select("qid", "node", F.col("rrf").alias("score")).join(self._asked(queries).select("qid", "qvec"), "qid")
        rows = graph.merge_neighbors(hits, graph.beam_search(self._own("edges"), vectors, seeds, 1))
        if use_case is not None:
            wanted = use_case.select("qid", self.embed(T.terms("text")).alias("uvec"))
            rows = graph.use_case_rerank(rows.withColumnRenamed("rrf", "score"), vectors, wanted).withColumnRenamed("score", "rrf")
        order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("rrf", 9)), "node"))
        return rows.withColumn("rank", order.cast("long")).where(F.col("rank") <= limit)

    def graph_search(self, queries: DataFrame, hops: int = 2, diverse: bool = False) -> DataFrame:
        """(qid, node, score, hop, relation) around each query's five best hits; MMR order (qid, node, place) if diverse."""
        seeds = self.search(queries).where("rank <= 5").select("qid", F.col("doc_id").alias("node"), F.col("rrf").alias("score"))
        vectors = self._own("vectors").select(F.col("doc_id").alias("node"), "vec")
        found = graph.beam_search(self._own("edges"), vectors, seeds.join(self._asked(queries).select("qid", "qvec"), "qid"), hops)
        return graph.mmr(found, mean_vectors(vectors, "node")) if diverse else found

    def path(self, pairs: DataFrame) -> DataFrame:
        """Shortest paths of pairs (pid, a, b) along up to graph.FAN_OUT edges of a node each way, with the first sentence
        of each document."""
        return graph.shortest_paths(self._own("edges"), pairs).join(self._own("documents").select(F.col("doc_id").alias("node"), "l0"), "node", "left")

    def common(self, groups: DataFrame) -> DataFrame:
        """Documents adjacent to all members of each group (gid, node) of two or more."""
        enough = groups.groupBy("gid").agg(F.countDistinct("node").alias("n")).where("n >= 2").select("gid")
        found = graph.common_neighbors(self._own("edges"), groups.join(enough, "gid", "left_semi"))
        return found.join(self._own("documents").select(F.col("doc_id").alias("node"), "l0"), "node")

    def analyze(self, top: int = 10) -> DataFrame:
        return analytics.full_analysis(materialize(self._own("edges"), "edges"), materialize(mean_vectors(self._own("vectors")), "vectors"), top)

    def invalidate(self, ids: DataFrame, as_of: Column | None = None) -> None:
        """End the current edges that go out from ids (doc_id); nothing is removed."""
        seq, seen = self.store.folders()
        now = F.current_timestamp() if as_of is None else as_of
        nodes = ids.select(F.col("doc_id").alias("from_id")).distinct()
        ended = self._own("edges", seen).where("invalid_at is null").join(nodes, "from_id", "left_semi")
        self.store.commit({"edges": ended.withColumn("invalid_at", now).withColumn("seq", F.lit(seq + 1))}, after=seq)

    def delete(self, ids: DataFrame) -> None:
        """Remove ids (doc_id) with their chunks, postings, vectors, accesses and edges: these tables start anew."""
        seq, seen = self.store.folders()
        names = ("documents", "chunks", "vectors", "access")
        kept = records.delete_documents({n: self.store.table(n, seen) for n in names}, ids)
        kept |= self._indexed(kept["chunks"], seq + 1)
        edges = graph.delete(graph.last_written(self.store.table("edges", seen)), ids.select(F.col("doc_id").alias("node")))
        self.store.commit({}, {**kept, "edges": edges}, seq)

    def state(self) -> DataFrame:
        """(corpus, last_dream_at, last_doc_count): the mark that the last cycle left."""
        rows = self._own("state")
        return rows.groupBy("corpus").agg(F.max_by(F.struct("last_dream_at", "last_doc_count"), "last_dream_at").alias("s")).select("corpus", "s.*")

    def dream(self, as_of: Column, share: float = 0.15, prune: bool = True) -> tuple[DataFrame, DataFrame]:
        """One cycle: (surprising, stale), the documents new since the last mark that surprise most, and those that were
        never used and are old. share is one of the whole corpus, so of the new documents share x all / new of them, all at
        most. The stale ones are removed, and the mark is saved. A document's vector is the mean of its chunks'."""
        vectors = materialize(mean_vectors(self._own("vectors")), "mean-vectors")
        docs = self._own("documents")
        fresh = materialize(records.new_since(docs.select("doc_id", "corpus", "inserted_at"), self.state()).join(vectors, "doc_id", "left_semi"), "fresh")
        part = min(1.0, share * vectors.count() / max(1, fresh.count()))
        surprising = materialize(analytics.incremental_surprisal(vectors, fresh, part), "surprising")
        old = docs.select("doc_id", "level", F.to_date("inserted_at").alias("created_at"))
        stale = materialize(records.stale(old, self.store.table("access"), F.to_date(as_of)), "stale")
        if prune and not stale.isEmpty():
            self.delete(stale)
        mark = self._own("documents").agg(F.count("*").alias("last_doc_count")).select(F.lit(self.corpus).alias("corpus"), as_of.alias("last_dream_at"), "last_doc_count")
        seq, seen = self.store.folders()
        self.store.commit({}, {"state": records.save_state(self.store.table("state", seen), mark)}, seq)
        return surprising, stale

    def note(self, rows: DataFrame, as_of: Column | None = None) -> DataFrame:
        """Ingest conclusions drawn from other documents: rows (body, source_ids and more) must name their sources."""
        return self.add(rows.where(F.size("source_ids") > 0), as_of)


class Documents(Memory):
    """The same over files: ingest, search, list, delete of a document corpus."""

    def __init__(self, spark: SparkSession, path: str, **options):
        super().__init__(spark, path, corpus="rag:documents", params=fusion.PRESETS["rag"], **options)

    ingest_text, ingest_files = Memory.add, Memory.add_files
