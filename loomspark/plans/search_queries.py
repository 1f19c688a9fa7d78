"""Catalogue: retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import cells
from loomspark.operators import fusion as U
from loomspark.operators.bm25 import bm25, bm25_rows, holding, query_terms, scratch_index, stemmed
from loomspark.operators.cells import cell_index
from loomspark.operators.hyperplanes import near_groups
from loomspark.operators.vector import similar_pairs, vector_topk, without_near, without_near_greedy
from loomspark.plans import fixtures as X
from loomspark.session import fence, materialize, read_table

PARAMS = U.SearchParams(num_to_return=10, num_to_score=40, min_rrf=0.005, feedback_sim=0.2)
EDGE = 0.35
R6 = lambda c: F.round(c, 6).alias(c)


_made: dict = {}


def _once(spark, sf, name, make):
    """What make() returns, made once for a table folder in an application: an index is built before queries come and
    serves them all. index_build is the query that builds one each time."""
    key = (spark.conf.get("spark.app.id", ""), spark.conf.get("spark.checkpoint.dir", ""), sf, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _index(spark, sf):
    return _once(spark, sf, "docs", lambda: scratch_index(X.docs(spark, sf)))


def index_build(spark, sf):
    """The index's heads, built anew: what each term's blocks hold in all."""
    made = scratch_index(X.docs(spark, sf)).blocks
    return made.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").cast("long").alias("max_tf"), F.min("min_dl").cast("long").alias("min_dl"), F.sum(F.aggregate("postings", F.lit(0).cast("long"), lambda s, p: s + p["tf"])).alias("occurrences"))


def bm25_topk(spark, sf):
    return bm25(_index(spark, sf), query_terms(X.queries(spark, sf)), 10).select("qid", "doc_id", R6("score"), "rank")


def bm25_filtered(spark, sf):
    return bm25(_index(spark, sf), query_terms(X.queries(spark, sf)), 10, "lang:en").select("qid", "doc_id", R6("score"), "rank")


#: Sources that bm25_sources asks for.
SOURCES = ("src0", "src3")


def bm25_sources(spark, sf):
    """Documents of some sources only; counts and lengths stay those of all."""
    only = X.docs(spark, sf).where(F.col("source_id").isin(*SOURCES)).select("doc_id")
    return bm25(_index(spark, sf), query_terms(X.queries(spark, sf)), 10, only=only).select("qid", "doc_id", R6("score"), "rank")


def bm25_expanded(spark, sf):
    cos = materialize(vector_topk(X.vectors(spark, sf), X.queries(spark, sf), 40), "cosine")
    more = query_terms(U.feedback_terms(cos, X.docs(spark, sf), PARAMS), "expansion")
    return bm25(_index(spark, sf), more, 10).select("qid", "doc_id", R6("score"), "rank")


def _lines(spark, sf):
    return X.docs(spark, sf).select("doc_id", "corpus", F.posexplode(F.split("body", "\n")).alias("chunk_no", "body")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def bm25_chunks(spark, sf):
    """The best lines of documents, each a row of the index, for every item."""
    index = _once(spark, sf, "lines", lambda: scratch_index(_lines(spark, sf)))
    return bm25_rows(index, query_terms(X.queries(spark, sf)), 10)[0].select("qid", "doc_id", "chunk_no", R6("score"), "rank")


def cosine_topk(spark, sf):
    return vector_topk(X.vectors(spark, sf), X.queries(spark, sf), 10).select("qid", "doc_id", R6("sim"), "rank")


def _cells(spark, sf):
    return _once(spark, sf, "cells", lambda: cell_index(X.vectors(spark, sf)))


def cell_topk(spark, sf):
    """cosine_topk by the cell index."""
    return cells.cell_topk(_cells(spark, sf), X.queries(spark, sf), 10)[0].select("qid", "doc_id", R6("sim"), "rank")


def cell_knn(spark, sf):
    """The five nearest others of every vector, by the cell index."""
    asked = X.vectors(spark, sf).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    return cells.cell_topk(_cells(spark, sf), asked, 5, skip_self=True)[0].select("qid", "doc_id", R6("sim"), "rank")


def find_similar(spark, sf):
    """Five nearest others of at least 0.2 for every vector whose number divides by 100."""
    v = X.vectors(spark, sf)
    asked = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    return vector_topk(v, asked, 5, 0.2, skip_self=True).select("qid", "doc_id", R6("sim"), "rank")


def max_similarity(spark, sf):
    v = X.vectors(spark, sf)
    asked = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    return vector_topk(v, asked, 1, skip_self=True).select("qid", F.round("sim", 6).alias("max_sim"))


def _doubled(spark, sf):
    v = X.vectors(spark, sf).select("doc_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    moved = F.transform("vec", lambda x, i: F.when(i == 0, x + 0.01).otherwise(x))
    return v.union(v.select(F.col("doc_id") + 1000000, moved))


def dedup_exact(spark, sf):
    return without_near(_doubled(spark, sf)).select("doc_id")


def dedup_greedy(spark, sf):
    return without_near_greedy(_doubled(spark, sf)).select("doc_id")


def similarity_forest(spark, sf):
    """The group of every vector and moved copy by links of hyperplane tables: all that are joined by cosines of 0.95."""
    return near_groups(_doubled(spark, sf), 0.95, recall=0.999).select("doc_id", "class_id", "root")


def bulk_edges(spark, sf):
    """Symmetric links between classes of equal vectors, weight rounded."""
    _, pairs = similar_pairs(X.vectors(spark, sf), EDGE)
    w = F.round("sim", 4).alias("weight")
    return pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), w).union(pairs.select(F.col("b"), F.col("a"), w))


def similarity_classes(spark, sf):
    """Each vector with the smallest number of its equals and its class's links."""
    own, pairs = similar_pairs(X.vectors(spark, sf), EDGE)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return own.join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def prf_terms(spark, sf):
    return U.feedback_terms(vector_topk(X.vectors(spark, sf), X.queries(spark, sf), 40), X.docs(spark, sf), PARAMS)


def rrf_fusion(spark, sf):
    hits = U.rrf(*U.signals(X.docs(spark, sf), _index(spark, sf), X.vectors(spark, sf), X.queries(spark, sf), PARAMS))
    return U.best(hits, PARAMS).select("qid", "doc_id", R6("rrf"), R6("embedding"), R6("bm25"), "rank")


def enriched_merge(spark, sf):
    """The cosine list merged with that of the query vector moved half-way to its best other hit."""
    v, q = X.vectors(spark, sf), X.queries(spark, sf)
    first = materialize(vector_topk(v, q, 40), "cosine")
    hit = first.where("rank = 1").join(v.select("doc_id", "vec"), "doc_id").select("qid", "vec")
    moved = q.join(hit, "qid").select("qid", F.zip_with("qvec", "vec", lambda a, b: a.cast("double") + b.cast("double") / 2).alias("qvec"))
    return U.max_merge(first, vector_topk(v, moved, 40)).where("rank < 10").select("qid", "doc_id", R6("sim"), "rank")


def temporal_injection(spark, sf):
    """A month's documents, up to 50 by number, placed after the dated documents that name the month as their own."""
    rows = materialize(fence(X.dated(spark, sf), days=T.dates("body")), "dated")
    own = rows.select(F.expr("cast(year(days[0]) * 100 + month(days[0]) as bigint)").alias("qid"), "doc_id", F.col("doc_id").cast("double").alias("score"))
    W = F.expr("cast(row_number() over (partition by qid order by score, doc_id) as bigint) - 1")
    ranked = own.withColumn("rank", W).where("rank < 10").select("qid", "doc_id", "rank")
    links = rows.select("doc_id", F.explode("days").alias("day")).select(F.expr("cast(year(day) * 100 + month(day) as bigint)").alias("qid"), "doc_id").distinct()
    links = links.withColumn("n", F.expr("row_number() over (partition by qid order by doc_id)")).where("n <= 50").drop("n")
    return U.append_candidates(ranked, links)


def _hits(spark, sf):
    return U.rrf(*U.signals(X.docs(spark, sf), _index(spark, sf), X.vectors(spark, sf), X.queries(spark, sf), PARAMS))


def _now(spark, sf):
    """The last event's time: one row."""
    return F.lit(read_table(spark, sf, "events").agg(F.max("ts").cast("timestamp")).first()[0])


def decay_rerank(spark, sf):
    hits = U.usage_rerank(_hits(spark, sf), X.doc_access(spark, sf), "1", _now(spark, sf))
    return U.best(hits, PARAMS).select("qid", "doc_id", R6("rrf"), "rank")


def negation_rerank(spark, sf):
    """Fusion with each query's last term excluded."""
    excluded = X.queries(spark, sf).select("qid", F.slice(T.terms("text"), F.lit(-1), F.lit(1)).alias("excluded"))
    hits = U.negation_rerank(_hits(spark, sf), X.docs(spark, sf), excluded)
    return U.best(hits, PARAMS).select("qid", "doc_id", R6("rrf"), "rank")


def date_rerank(spark, sf):
    """Documents whose second date lies in a month, ranked by how close their dates come to the month's query."""
    rows = materialize(fence(X.dated(spark, sf), days=T.dates("body")), "dated")
    q = rows.select(F.expr("cast(year(days[0]) * 100 + month(days[0]) as bigint)").alias("qid"), F.trunc(F.get("days", F.lit(0)), "MM").alias("m")).distinct()
    ranges = q.select("qid", T.query_ranges(F.date_format("m", "MMMM yyyy")).alias("ranges"))
    base = rows.select(F.expr("cast(year(days[1]) * 100 + month(days[1]) as bigint)").alias("qid"), "doc_id", F.lit(0.1).alias("rrf"), F.lit(0.0).alias("embedding"), F.lit(0.0).alias("bm25"))
    hits = U.date_boost(base.join(q.select("qid"), "qid", "left_semi"), rows.select("doc_id", "days"), ranges)
    return U.best(hits, PARAMS).select("qid", "doc_id", R6("rrf"), "rank")


def hybrid_search(spark, sf):
    asked = X.queries(spark, sf).withColumn("text", F.concat("text", F.lit(" besides "), F.element_at(T.terms("text"), -1)))
    found = U.hybrid_search(X.docs(spark, sf), _index(spark, sf), X.vectors(spark, sf), asked, X.doc_access(spark, sf), "1", _now(spark, sf), PARAMS)
    return found.select("qid", "doc_id", R6("rrf"), R6("embedding"), R6("bm25"), "rank")


FLOW_PARAMS = U.SearchParams(num_to_return=10, num_to_score=40, min_rrf=0.005, feedback_sim=0.2)
FLOW_LEAST = 0.1


def _flow(spark, sf):
    """(index, queries, hits) of the whole search."""
    docs, vectors, edges, asked = X.flow(spark, sf)
    docs, edges = materialize(docs, "flow-docs"), materialize(edges, "flow-edges")
    index = _once(spark, sf, "flow", lambda: scratch_index(docs))
    access = X.doc_access(spark, sf).withColumn("doc_id", X._node("doc_id"))
    corpus = U.Corpus(docs, index, vectors, edges, access)
    return index, asked, U.search(corpus, asked, X.term_vector, _now(spark, sf), FLOW_PARAMS, "1", least=FLOW_LEAST)


def search_flow(spark, sf):
    """The whole search: exclusion, dates, cosine, feedback, enriched cosine, BM25 twice, periods, fusion, date boost,
    usage, penalty, minimums and graph expansion."""
    return _flow(spark, sf)[2].select("qid", "doc_id", R6("rrf"), R6("embedding"), R6("bm25"), "rank")


def recall_metrics(spark, sf):
    """Precision, hit rate, reciprocal rank and NDCG at 3 of the whole search, a document being relevant if it has half
    of an item's distinct terms or more, and an item's terms those of its query but the excluded one."""
    from loomspark.operators.metrics import retrieval_metrics

    index, asked, found = _flow(spark, sf)
    wanted = materialize(query_terms(fence(asked, n=T.negation("text")).select("qid", F.col("n.clean").alias("text"))), "wanted")
    hits = found.select("qid", "doc_id", (F.col("rank") - 1).alias("rank"))
    relevant = holding(index, wanted, 0.5)
    return retrieval_metrics(hits, relevant, wanted.select("qid").distinct(), 3)


TOK = f"tok AS (SELECT doc_id, corpus, body, {X.sql_terms('body')} AS tokens FROM docs), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok)"
TF = "tf AS (SELECT term, doc_id, corpus, dl, count(*) AS tf FROM (SELECT doc_id, corpus, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
WANTED = f"wanted AS (SELECT DISTINCT qid, unnest({X.sql_terms('text')}) AS term FROM queries)"


def sql_bm25(name: str, wanted: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM (
    SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
    FROM tf JOIN df USING (term) JOIN {wanted} USING (term), stats WHERE {where} GROUP BY qid, doc_id)) WHERE rank < {k})"""


def sql_cos(name: str, queries: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT qid, doc_id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) - 1 AS rank FROM (
    SELECT qid, doc_id, {X.SQL_COS.format(a='qvec', b='vec')} AS sim FROM vectors, {queries} WHERE qvec IS NOT NULL AND {where})) WHERE rank < {k})"""


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
PRF = f"""fb AS (SELECT qid, rank, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM cos JOIN tok USING (doc_id) WHERE rank < 3 AND sim >= 0.2),
fbc AS (SELECT qid, term, count(*) AS n, min(rank * 100000000 + pos) AS first FROM fb WHERE length(term) >= 3 AND term NOT IN ({STOP}) GROUP BY qid, term),
fbt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS place FROM fbc),
expansion AS (SELECT qid, string_agg(term, ' ' ORDER BY place) AS expansion FROM fbt WHERE place <= 12 GROUP BY qid),
more AS (SELECT DISTINCT qid, term FROM fbt WHERE place <= 12)"""
BASE = f"WITH {X.DOCS}, {X.QUERIES}, {TOK}, {TF}, {WANTED}"
ALL = f"""{BASE}, {sql_cos('cos', 'queries', 40)}, {PRF}, {sql_bm25('b1', 'wanted', 40)}, {sql_bm25('b2', 'more', 40)},
s1 AS (SELECT qid, doc_id, score, 1.5 / (16 + rank) * score / (CASE WHEN max(score) OVER (PARTITION BY qid) < 1e-6 THEN 1 ELSE max(score) OVER (PARTITION BY qid) END) AS part FROM b1),
s2 AS (SELECT qid, doc_id, score, 0.75 / (16 + rank) * score / (CASE WHEN max(score) OVER (PARTITION BY qid) < 1e-6 THEN 1 ELSE max(score) OVER (PARTITION BY qid) END) AS part FROM b2),
hits AS (SELECT qid, doc_id, coalesce(2.0 / (16 + cos.rank), 0) + coalesce(s1.part, 0) + coalesce(s2.part, 0) AS rrf, coalesce(sim, 0) AS embedding, coalesce(s1.score, s2.score, 0) AS bm25
  FROM cos FULL JOIN s1 USING (qid, doc_id) FULL JOIN s2 USING (qid, doc_id))"""
USED = f"""{X.ACCESS}, used AS (SELECT h.qid, h.doc_id, h.embedding, h.bm25, rrf * greatest(0.3, 1 - 0.5 * coalesce(epoch_us((SELECT max(ts)
FROM events)) - epoch_us(last_accessed), 365 * 86400000000) / 86400000000.0 / 365) * least(1.3, 1 + 0.02 * coalesce(access_count, 0)) AS rrf FROM hits h LEFT
JOIN doc_access a ON a.doc_id = h.doc_id AND a.agent_id = '1')"""


def sql_best(source: str, columns: str) -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM {source} WHERE rrf >= 0.005 AND bm25 >= 0 AND embedding >= 0) WHERE rank <= 10"


LAST = f"({X.sql_terms('q.text')})[-1]"
NOT_LAST = "pen AS (SELECT h.* REPLACE (rrf * CASE WHEN contains(lower(body), {last}) THEN 0.1 ELSE 1 END AS rrf) FROM {hits} h LEFT JOIN docs USING (doc_id) LEFT JOIN queries q USING (qid))"
OUT = "qid, doc_id, round(rrf, 6) AS rrf"
FULL_OUT = f"{OUT}, round(embedding, 6) AS embedding, round(bm25, 6) AS bm25"
ASKED = f"WITH {X.VECTORS}, asked AS (SELECT doc_id AS qid, vec AS qvec FROM vectors WHERE doc_id % 100 = 0)"
DOUBLED = f"""WITH {X.VECTORS}, d AS (SELECT doc_id, vec FROM vectors UNION ALL SELECT doc_id + 1000000, list_concat([vec[1] + 0.01], vec[2:]) FROM vectors),
near AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.doc_id < b.doc_id WHERE {X.SQL_COS.format(a='a.vec', b='b.vec')} >= 0.95)"""
PAIRS = f"""WITH {X.VECTORS}, cls AS (SELECT doc_id, vec, min(doc_id) OVER (PARTITION BY vec) AS class_id FROM vectors), reps AS (SELECT * FROM cls
WHERE doc_id = class_id), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, {X.SQL_COS.format(a='a.vec', b='b.vec')} AS sim FROM reps a
JOIN reps b ON a.doc_id < b.doc_id WHERE {X.SQL_COS.format(a='a.vec', b='b.vec')} >= {EDGE})"""
ME = "lambda x: CAST(x AS DOUBLE)"

def sql_fused(cos: str) -> str:
    part = lambda name, source, weight: f"""{name} AS (SELECT qid, doc_id,
score, {weight} / (16 + rank) * score / (CASE WHEN max(score) OVER (PARTITION BY qid) < 1e-6 THEN 1 ELSE max(score) OVER (PARTITION BY qid) END) AS part
FROM {source})"""  # noqa: E731
    return f"""{part("s1", "b1", 1.5)}, {part("s2", "b2", 0.75)},
hits AS (SELECT qid, doc_id, coalesce(2.0 / (16 + c.rank), 0) + coalesce(s1.part, 0) + coalesce(s2.part, 0) AS rrf, coalesce(sim, 0) AS embedding, coalesce(s1.score, s2.score, 0) AS bm25
  FROM {cos} c FULL JOIN s1 USING (qid, doc_id) FULL JOIN s2 USING (qid, doc_id))"""


def sql_near(name: str, a: str, b: str, k: int, where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT {a} AS node, {b} AS other, row_number() OVER (PARTITION BY {a} ORDER BY weight DESC, {b}, edge_type) AS place FROM cur WHERE {where}) WHERE place <= {k})"


FLOW_SQL = f"""WITH {X.FLOW}, {X.EDGES.strip()}, cur AS MATERIALIZED (SELECT CASE WHEN edge_type = 'occurred_in' THEN 'v' || substr(from_id, 2) ELSE from_id END AS from_id,
to_id, edge_type, weight FROM edges WHERE invalid_at IS NULL), {TOK}, {TF.replace("df AS (", "df AS MATERIALIZED (")}, {WANTED},
{sql_cos('cos', 'queries', 40)}, {PRF}, {sql_bm25('b1', 'wanted', 40)}, {sql_bm25('b2', 'more', 40)},
richer AS MATERIALIZED (SELECT qid, {X.sql_term_vector(X.sql_terms("text || ' ' || expansion"))} AS qvec FROM queries JOIN expansion USING (qid)), {sql_cos('cos2', 'richer', 40)},
merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) - 1 AS rank FROM (SELECT qid, doc_id, max(sim) AS sim
FROM (SELECT qid, doc_id, sim FROM cos UNION ALL SELECT qid, doc_id, sim FROM cos2) GROUP BY ALL)),
{sql_near("of_period", "to_id", "from_id", 50, "edge_type = 'occurred_in'")},
periods_asked AS (SELECT qid, unnest(['month:' || strftime(m, '%Y-%m'), 'quarter:' || strftime(m, '%Y') || '-Q' || quarter(m)]) AS node FROM queries WHERE m IS NOT NULL),
added AS (SELECT DISTINCT qid, other AS doc_id FROM periods_asked JOIN of_period USING (node) WHERE (qid, other) NOT IN (SELECT (qid, doc_id) FROM merged)),
added_sim AS (SELECT a.qid, a.doc_id, {X.SQL_COS.format(a='qvec', b='vec')} AS sim, row_number() OVER (PARTITION BY a.qid ORDER BY a.doc_id) AS n FROM added a JOIN vectors USING (doc_id) JOIN queries q ON q.qid = a.qid),
near_ AS MATERIALIZED (SELECT qid, doc_id, sim, rank FROM merged UNION ALL SELECT a.qid, a.doc_id, a.sim, coalesce(l.last, -1) + n FROM added_sim a LEFT
JOIN (SELECT qid, max(rank) AS last FROM merged GROUP BY qid) l USING (qid)),
{sql_fused('near_')},
boosted AS (SELECT h.qid, h.doc_id, h.embedding, h.bm25, rrf + 1.5 * coalesce((SELECT max(exp(-pow(greatest(0, m - d, d - last_day(m)), 2) / 450))
FROM (SELECT unnest(days) AS d)), 0) AS rrf FROM hits h LEFT JOIN docs USING (doc_id) LEFT JOIN queries q USING (qid)),
{USED.replace("FROM hits h", "FROM boosted h").replace("a.doc_id = h.doc_id", "'v' || a.doc_id = h.doc_id")},
pen AS (SELECT u.* REPLACE (rrf * CASE WHEN contains(lower(body), last) THEN 0.1 ELSE 1 END AS rrf) FROM used u LEFT JOIN docs USING (doc_id) LEFT JOIN queries USING (qid)),
best AS MATERIALIZED ({sql_best('pen', 'qid, doc_id, rrf, embedding, bm25')}),
{sql_near("o", "from_id", "to_id", 8)}, {sql_near("i", "to_id", "from_id", 8)}, adj AS MATERIALIZED (SELECT DISTINCT node, other FROM (SELECT node, other FROM o UNION ALL SELECT node, other FROM i)),
e0 AS (SELECT qid, doc_id AS node FROM best WHERE rank <= 5), e1 AS MATERIALIZED (SELECT DISTINCT qid, other AS node FROM e0 JOIN adj USING (node) WHERE (qid, other) NOT IN (SELECT (qid, node) FROM e0)),
e2 AS (SELECT DISTINCT qid, other AS node FROM e1 JOIN adj USING (node) WHERE (qid, other) NOT IN (SELECT (qid, node) FROM e0 UNION ALL SELECT (qid, node) FROM e1)),
fresh AS (SELECT e.qid, e.node AS doc_id, {X.SQL_COS.format(a='qvec', b='vec')} AS sim FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) e
JOIN vectors v ON v.doc_id = e.node JOIN queries q ON q.qid = e.qid WHERE (e.qid, e.node) NOT IN (SELECT (qid, doc_id) FROM best)),
span AS (SELECT qid, min(rrf) AS lo, max(rrf) AS hi FROM best GROUP BY qid),
wide AS (SELECT qid, doc_id, rrf, embedding, bm25 FROM best UNION ALL SELECT qid, doc_id,
lo + (hi - lo) * greatest(0.0, (sim - {FLOW_LEAST}) / (1 - {FLOW_LEAST})), NULL, NULL FROM fresh JOIN span USING (qid) WHERE sim >= {FLOW_LEAST}),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM wide) WHERE rank <= 10)"""

QUERIES = {
    "index_build": (index_build, f"WITH {X.DOCS}, {TOK}, {TF} SELECT term, count(*) AS df, max(tf) AS max_tf, min(dl) AS min_dl, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term"),
    "bm25_topk": (bm25_topk, f"{BASE}, {sql_bm25('b1', 'wanted', 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM b1"),
    "bm25_chunks": (
        bm25_chunks,
        f"""WITH {X.DOCS}, {X.QUERIES}, lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS body, unnest(range(len(string_split(body, chr(10))))) AS chunk_no FROM docs),
tok AS (SELECT doc_id, chunk_no, {X.sql_terms('body')} AS tokens FROM lines), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok),
tf AS (SELECT term, doc_id, chunk_no, dl, count(*) AS tf FROM (SELECT doc_id, chunk_no, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), {WANTED},
s AS (SELECT qid, doc_id, chunk_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (term) JOIN wanted USING (term), stats GROUP BY ALL)
SELECT qid, doc_id, chunk_no, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, chunk_no) - 1 AS rank FROM s) WHERE rank < 10""",
    ),
    "bm25_filtered": (bm25_filtered, BASE + ", " + sql_bm25("b1", "wanted", 10, "corpus = 'lang:en'") + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM b1"),
    "bm25_sources": (bm25_sources, BASE + ", " + sql_bm25("b1", "wanted", 10, f"doc_id IN (SELECT doc_id FROM docs WHERE source_id IN {SOURCES})") + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM b1"),
    "bm25_expanded": (bm25_expanded, f"{BASE}, {sql_cos('cos', 'queries', 40)}, {PRF}, {sql_bm25('b2', 'more', 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM b2"),
    "cosine_topk": (cosine_topk, f"WITH {X.QUERIES}, {sql_cos('cos', 'queries', 10)} SELECT qid, doc_id, round(sim, 6) AS sim, rank FROM cos"),
    "cell_topk": (cell_topk, f"WITH {X.QUERIES}, {sql_cos('cos', 'queries', 10)} SELECT qid, doc_id, round(sim, 6) AS sim, rank FROM cos"),
    "cell_knn": (cell_knn, f"WITH {X.VECTORS}, asked AS (SELECT doc_id AS qid, vec AS qvec FROM vectors), {sql_cos('cos', 'asked', 5, 'qid <> doc_id')} SELECT qid, doc_id, round(sim, 6) AS sim, rank FROM cos"),
    "find_similar": (find_similar, f"{ASKED}, {sql_cos('cos', 'asked', 5, 'qid <> doc_id')} SELECT qid, doc_id, round(sim, 6) AS sim, rank FROM cos WHERE sim >= 0.2"),
    "max_similarity": (max_similarity, f"{ASKED}, {sql_cos('cos', 'asked', 1, 'qid <> doc_id')} SELECT qid, round(sim, 6) AS max_sim FROM cos"),
    "dedup_exact": (dedup_exact, f"{DOUBLED} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT b FROM near)"),
    "dedup_greedy": (
        dedup_greedy,
        f"""{DOUBLED.replace('WITH', 'WITH RECURSIVE', 1)}, o AS MATERIALIZED (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) AS i, coalesce(x.others, []) AS others
FROM d LEFT JOIN (SELECT b, list(a) AS others FROM near GROUP BY b) x ON x.b = d.doc_id),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, o.doc_id) END FROM r JOIN o ON o.i = r.i + 1)
SELECT unnest(kept) AS doc_id FROM r WHERE i = (SELECT max(i) FROM r)""",
    ),
    "similarity_forest": (
        similarity_forest,
        f"""{DOUBLED.replace('WITH', 'WITH RECURSIVE', 1)}, both_ AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN both_ ON a = node)
SELECT node AS doc_id, (SELECT min(o.doc_id) FROM d o JOIN d m ON o.vec = m.vec WHERE m.doc_id = node) AS class_id, min(root) AS root FROM reach GROUP BY node""",
    ),
    "bulk_edges": (bulk_edges, f"{PAIRS} SELECT a AS from_id, b AS to_id, round(sim, 4) AS weight FROM pairs UNION ALL SELECT b, a, round(sim, 4) FROM pairs"),
    "similarity_classes": (similarity_classes, f"""{PAIRS}, ends AS (SELECT c, count(*) AS links FROM (SELECT a AS c FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY c) SELECT doc_id, class_id,
coalesce(links, 0) AS links FROM cls LEFT JOIN ends ON c = class_id"""),
    "prf_terms": (prf_terms, f"{BASE}, {sql_cos('cos', 'queries', 40)}, {PRF} SELECT qid, expansion FROM expansion"),
    "rrf_fusion": (rrf_fusion, f"{ALL} {sql_best('hits', FULL_OUT)}"),
    "enriched_merge": (
        enriched_merge,
        f"""WITH {X.QUERIES}, {sql_cos('cos', 'queries', 40)}, moved AS (SELECT q.qid, list_transform(q.qvec, lambda x, i: x + v.vec[i] / 2) AS qvec FROM queries q
JOIN cos USING (qid) JOIN vectors v ON v.doc_id = cos.doc_id WHERE cos.rank = 1), {sql_cos('cos2', 'moved', 40)},
both_ AS (SELECT qid, doc_id, max(sim) AS sim FROM (SELECT qid, doc_id, sim FROM cos UNION ALL SELECT qid, doc_id, sim FROM cos2) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) - 1 AS rank FROM both_) SELECT qid, doc_id, round(sim, 6) AS sim, rank FROM r WHERE rank < 10""",
    ),
    "temporal_injection": (
        temporal_injection,
        f"""WITH {X.DATES}, ranked AS (SELECT * FROM (SELECT year(days[1]) * 100 + month(days[1]) AS qid, doc_id,
row_number() OVER (PARTITION BY year(days[1]) * 100 + month(days[1]) ORDER BY doc_id) - 1 AS rank FROM dates) WHERE rank < 10),
l0 AS (SELECT DISTINCT year(d) * 100 + month(d) AS qid, doc_id FROM (SELECT doc_id, unnest(days) AS d FROM dates)), l AS (SELECT * FROM (SELECT *,
row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS n FROM l0) WHERE n <= 50),
extra AS (SELECT qid, doc_id FROM l ANTI JOIN ranked USING (qid, doc_id)), last AS (SELECT qid, max(rank) AS last FROM ranked GROUP BY qid)
SELECT qid, doc_id, rank FROM ranked UNION ALL SELECT e.qid, e.doc_id, coalesce(last, -1) + row_number() OVER (PARTITION BY e.qid ORDER BY e.doc_id) FROM extra e LEFT JOIN last USING (qid)""",
    ),
    "decay_rerank": (decay_rerank, f"{ALL}, {USED} {sql_best('used', OUT)}"),
    "negation_rerank": (negation_rerank, f"{ALL}, {NOT_LAST.format(hits='hits', last=LAST)} {sql_best('pen', OUT)}"),
    "date_rerank": (
        date_rerank,
        f"""WITH {X.DATES}, q AS (SELECT DISTINCT year(days[1]) * 100 + month(days[1]) AS qid, date_trunc('month', days[1]) AS m FROM dates),
b AS (SELECT year(days[2]) * 100 + month(days[2]) AS qid, doc_id, days FROM dates), j AS (SELECT b.qid, doc_id, unnest(days) AS d, CAST(m AS DATE) AS a, last_day(m) AS z FROM b JOIN q USING (qid)),
s AS (SELECT qid, doc_id, 0.1 + 1.5 * max(exp(-pow(greatest(0, a - d, d - z), 2) / 450)) AS rrf, 0 AS embedding, 0 AS bm25 FROM j GROUP BY ALL) {sql_best('s', OUT)}""",
    ),
    "hybrid_search": (hybrid_search, f"{ALL}, {USED}, {NOT_LAST.format(hits='used', last=LAST)} {sql_best('pen', FULL_OUT)}"),
    "search_flow": (search_flow, f"{FLOW_SQL} SELECT {FULL_OUT}, rank FROM found"),
    "recall_metrics": (
        recall_metrics,
        f"""{FLOW_SQL}, sz AS (SELECT qid, count(*) AS n FROM wanted GROUP BY qid), rel AS MATERIALIZED (SELECT qid, doc_id FROM (SELECT qid, doc_id, count(*) AS held
FROM tf JOIN wanted USING (term) GROUP BY ALL) JOIN sz USING (qid) WHERE held * 2 >= n),
h AS (SELECT f.qid, f.doc_id, f.rank - 1 AS rank, (qid, doc_id) IN (SELECT (qid, doc_id) FROM rel) AS hit FROM found f WHERE rank <= 3), rc AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
m AS (SELECT s.qid, coalesce(sum(CAST(hit AS INTEGER)), 0) / 3.0 AS p, coalesce(max(CAST(hit AS INTEGER)), 0) AS hr,
coalesce(max(CASE WHEN hit THEN 1.0 / (rank + 1) END), 0) AS rr, coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 2) END), 0) AS dcg FROM sz s LEFT
JOIN h USING (qid) GROUP BY s.qid),
ideals AS (SELECT m.*, coalesce(list_sum(list_transform(range(least(3, rc.n)), lambda k: 1 / log2(k + 2))), 0) AS ideal FROM m LEFT JOIN rc USING (qid))
SELECT count(*) AS queries, round(avg(p), 6) AS precision_at_k, round(avg(hr), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg FROM ideals""",
    ),
}
