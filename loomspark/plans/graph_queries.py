"""Catalogue: edge store, traversal and analytics over the derived edge table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import analytics as A
from loomspark.operators import graph as G
from loomspark.operators import records as R
from loomspark.operators.components import connected_components
from loomspark.operators.spectrum import ZERO, Laplacian, smallest_pairs, spectrum_checks
from loomspark.operators.vector import hash_embed, vector_topk
from loomspark.plans import fixtures as X
from loomspark.session import fence, materialize, read_table

AS_OF = "2024-06-01 00:00:00"
PATH_DEPTH = 10
R6 = lambda c: F.round(c, 6).alias(c)


def _now():
    return F.to_timestamp(F.lit(AS_OF))


def _edges(spark, sf):
    return materialize(X.edges(spark, sf), "edges")


def _vectors(spark, sf):
    return X.vectors(spark, sf).select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("node"), "vec")


def _seeds(spark, sf):
    """Every vector whose number divides by 100 seeds a search of its own."""
    v = X.vectors(spark, sf).where("doc_id % 100 = 0")
    return v.select(F.col("doc_id").alias("qid"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("node"), F.lit(1.0).alias("score"), F.col("vec").alias("qvec"))


def neighbors_topk(spark, sf):
    return G.neighbors(X.edges(spark, sf), 5)


def predecessors_topk(spark, sf):
    return G.neighbors(X.edges(spark, sf), 5, incoming=True)


def all_edges(spark, sf):
    return G.all_edges(X.edges(spark, sf))


def temporal_neighbors(spark, sf):
    return G.temporal_neighbors(X.edges(spark, sf), _now()).select("from_id", "to_id", "edge_type", R6("score"))


def contradiction_count(spark, sf):
    return G.contradictions(X.edges(spark, sf))


def edges_by_type(spark, sf):
    return G.current(X.edges(spark, sf), ("derives_from",)).select("from_id", "to_id", "weight")


EDGE_COLUMNS = ("from_id", "to_id", "edge_type", "weight", "invalid_at is null as is_current")


def edges_as_of(spark, sf):
    return G.edges_as_of(X.edges(spark, sf), F.to_timestamp(F.lit("2024-01-03 00:00:00"))).select("from_id", "to_id", "edge_type", "weight")


def edge_upsert(spark, sf):
    """Every related_to edge written twice more; the last written counts."""
    base = _edges(spark, sf)
    again = base.where("edge_type = 'related_to'").withColumn("invalid_at", F.lit(None).cast("timestamp"))
    written = again.withColumn("weight", F.lit(0.1)).withColumn("seq", F.lit(1).cast("long")).unionByName(again.withColumn("weight", F.lit(0.2)).withColumn("seq", F.lit(2).cast("long")))
    return G.upsert(base, written).selectExpr(*EDGE_COLUMNS)


def _old(spark, sf):
    return X.vectors(spark, sf).where("corpus = 'label:0'").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("node"))


def invalidate_node(spark, sf):
    return G.invalidate(X.edges(spark, sf), _old(spark, sf), _now()).selectExpr(*EDGE_COLUMNS)


def delete_node(spark, sf):
    return G.delete(X.edges(spark, sf), _old(spark, sf)).selectExpr(*EDGE_COLUMNS)


def compact_cluster(spark, sf):
    """Each label's vectors under a summary of the label."""
    members = X.vectors(spark, sf).select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("node"), F.concat(F.lit("summary:"), "corpus").alias("summary"))
    return G.compact_clusters(_edges(spark, sf), members, _now()).selectExpr(*EDGE_COLUMNS)


def list_clusters(spark, sf):
    """The eight largest labels as clusters with their three newest members; the rest as one row without a cluster."""
    v = X.vectors(spark, sf).select(F.col("corpus").alias("cluster_id"), "doc_id")
    return R.clusters(v).select("cluster_id", "size", F.array_join(F.transform("recent", lambda i: i.cast("string")), ",").alias("recent"))


def store_counts(spark, sf):
    rows = X.edges(spark, sf)
    return rows.groupBy("corpus").agg(F.count("*").alias("edge_count"), F.count_if(F.col("invalid_at").isNull()).alias("current_count"), F.countDistinct("edge_type").alias("types"))


def common_neighbors(spark, sf):
    """Common neighbours of each related pair of vectors."""
    base = _edges(spark, sf)
    pairs = G.current(base, ("related_to",)).where("from_id < to_id").select(F.concat_ws("|", "from_id", "to_id").alias("gid"), F.explode(F.array("from_id", "to_id")).alias("node"))
    return G.common_neighbors(base, pairs)


def source_edges(spark, sf):
    docs = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(F.expr("vec_id div 2"), F.expr("vec_id div 3")).alias("source_ids"), F.when(F.col("vec_id") % 7 == 0, "contradiction").otherwise("inference").alias("level"))
    return G.source_edges(docs)


def same_tag_edges(spark, sf):
    return G.attribute_edges(X.docs(spark, sf).select("doc_id", "source_id"), "source_id", "same_tag", 0.6)


def co_session_edges(spark, sf):
    return G.attribute_edges(X.history(spark, sf).select(F.col("id").alias("doc_id"), "session_id"), "session_id", "co_session", 0.5)


def related_edges(spark, sf):
    """Symmetric links of every new vector (number divisible by 100) to its five nearest of at least 0.2."""
    v = X.vectors(spark, sf)
    asked = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    near = vector_topk(v, asked, 5, 0.2, skip_self=True).select("qid", "doc_id", F.round("sim", 4).alias("weight"))
    one = near.select(F.col("qid").alias("from_id"), F.col("doc_id").alias("to_id"), "weight")
    return one.union(near.select("doc_id", "qid", "weight")).distinct()


def beam_search(spark, sf):
    return G.beam_search(_edges(spark, sf), _vectors(spark, sf), _seeds(spark, sf)).select("qid", "node", R6("score"), "hop", "relation")


def beam_search_mmr(spark, sf):
    v = _vectors(spark, sf)
    return G.mmr(materialize(G.beam_search(_edges(spark, sf), v, _seeds(spark, sf)), "hits"), v)


def multi_angle_merge(spark, sf):
    """Three angles of each query: its own vector, the next and the one after, merged by the best score."""
    s = _seeds(spark, sf).select("qid", "node", "score")
    v = X.vectors(spark, sf).select(F.col("doc_id").alias("n"), F.col("vec").alias("qvec"))
    angles = s.select("qid", "node", "score", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("angle")).join(v, F.col("n") == F.col("qid") + F.col("angle"))
    asked = angles.select((F.col("qid") * 10 + F.col("angle")).alias("qid"), "node", "score", "qvec")
    hits = G.beam_search(_edges(spark, sf), _vectors(spark, sf), asked)
    return G.merge_angles(hits.withColumn("qid", F.expr("qid div 10"))).select("qid", "node", R6("score"))


def _hits(spark, sf, asked):
    """Ten nearest vectors of each query as hits with the scores of a single ranked list."""
    found = vector_topk(X.vectors(spark, sf), asked, 10)
    node = F.concat(F.lit("v"), F.col("doc_id").cast("string"))
    return materialize(found.select("qid", node.alias("node"), (2.0 / (16 + F.col("rank"))).alias("rrf"), (F.col("rank") + 1).alias("rank")), "hits")


def neighbor_merge(spark, sf):
    """Hits by cosine with what the graph finds around each query's vector, at half its score."""
    hits = _hits(spark, sf, X.vectors(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec")))
    return G.merge_neighbors(hits, G.beam_search(_edges(spark, sf), _vectors(spark, sf), _seeds(spark, sf))).select("qid", "node", R6("rrf"))


def use_case_rerank(spark, sf):
    """Nodes around each query's vector by their closeness to the next vector as the use case."""
    cases = X.vectors(spark, sf).where("doc_id % 100 = 1").select((F.col("doc_id") - 1).alias("qid"), F.col("vec").alias("uvec"))
    found = G.beam_search(_edges(spark, sf), _vectors(spark, sf), _seeds(spark, sf))
    return G.use_case_rerank(found, _vectors(spark, sf), cases).select("qid", "node", R6("score"))


def graph_expand(spark, sf):
    """Hits by cosine, extended through the graph by nodes of at least 0.1."""
    v = X.vectors(spark, sf)
    asked = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    hits = _hits(spark, sf, asked)
    return G.graph_expand(hits, _edges(spark, sf), _vectors(spark, sf), asked, least=0.1).select("qid", "node", R6("rrf"), "rank")


def _path_pairs(spark, sf):
    v = X.vectors(spark, sf).where("doc_id % 100 = 0 and doc_id > 0")
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    return v.select(F.col("doc_id").alias("pid"), name(F.col("doc_id")).alias("a"), name(F.col("doc_id") - 100).alias("b"))


def shortest_path(spark, sf):
    """Nodes along the path of each pair, with the type of the edge that leads to each."""
    return G.shortest_paths(_edges(spark, sf), _path_pairs(spark, sf), PATH_DEPTH, A.DEFAULT_TYPES).select("pid", "step", "node", "via")


def annotated_edges(spark, sf):
    hits = _seeds(spark, sf).select("qid", "node")
    return G.annotate(hits, X.edges(spark, sf)).select("qid", "node", F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["edge_type"], e["other"])), ",").alias("edges"))


def pagerank_k(spark, sf):
    return A.pagerank(X.edges(spark, sf)).select("node", F.round("rank", 9).alias("rank"))


def surprisal_k(spark, sf):
    return A.surprisal(X.vectors(spark, sf)).select("doc_id", R6("surprisal"), R6("normalized"))


def surprisal_incremental(spark, sf):
    """The tenth of the newer half of the vectors that surprises most."""
    v = X.vectors(spark, sf)
    half = v.agg(F.expr("max(doc_id) div 2")).first()[0]
    return A.incremental_surprisal(v, v.where(F.col("doc_id") > half), 0.1).select("doc_id", R6("surprisal"))


def knn_maintained(spark, sf):
    """The five nearest others of every vector: kept edges of the older half, then the newer half added."""
    v = X.vectors(spark, sf).select("doc_id", "vec")
    half = v.agg(F.expr("max(doc_id) div 2")).first()[0]
    old, fresh = v.where(F.col("doc_id") <= half), v.where(F.col("doc_id") > half)
    return A.knn_delta(A.knn_edges(old), old, fresh).select("qid", "doc_id", R6("sim"))


def local_entropy(spark, sf):
    return A.local_entropy(X.edges(spark, sf)).select("node", R6("entropy"))


def entropy_production(spark, sf):
    """How much each node's own edges change the entropy of its neighbours' degrees."""
    return A.entropy_production(G.current(X.edges(spark, sf), A.DEFAULT_TYPES)).select("node", R6("production"))


def degree_stats(spark, sf):
    return A.degrees(X.edges(spark, sf)).select("node", "degree", "neighbors", R6("weight"))


def components(spark, sf):
    """Components of current edges but period links: each node's component by its smallest node."""
    return A.components(G.current(X.edges(spark, sf), A.DEFAULT_TYPES))


def session_components(spark, sf):
    rows = connected_components(G.current(X.edges(spark, sf), ("co_session",)).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    return rows.groupBy("root").agg(F.count("*").alias("size"))


def betweenness(spark, sf):
    """Dependencies from every node, over all default types."""
    return A.betweenness(_edges(spark, sf), types=A.DEFAULT_TYPES).select("node", R6("betweenness"))


def fiedler(spark, sf):
    return A.fiedler(_edges(spark, sf), types=A.DEFAULT_TYPES).select("node", R6("value"))


def laplacian_spectrum(spark, sf):
    """The six smallest eigenpairs of the largest component: which values are zero, residuals, lengths and overlaps."""
    graph = Laplacian(_edges(spark, sf), A.DEFAULT_TYPES)
    checks = spectrum_checks(graph, smallest_pairs(graph, 6))
    return checks.select("pair", (F.col("eigenvalue") < ZERO).alias("is_zero"), R6("residual"), R6("length"), R6("overlap"))


def rmt_novel(spark, sf):
    """Documents under the hashing embedder by their share in its directions beyond chance."""
    docs = fence(X.docs(spark, sf).select("doc_id", "body"), tokens=T.terms("body"))
    return A.rmt_anomalies(materialize(docs.select("doc_id", hash_embed("tokens").alias("vec")), "hashed")).select("doc_id", R6("score"))


def full_analysis(spark, sf):
    return A.full_analysis(_edges(spark, sf), X.vectors(spark, sf))


E = f"WITH {X.EDGES}, cur AS (SELECT * FROM edges WHERE invalid_at IS NULL)"
BOTH = "both_ AS (SELECT from_id AS node, to_id AS other, edge_type, weight, 'out' AS direction FROM cur UNION ALL SELECT to_id, from_id, edge_type, weight, 'in' FROM cur)"
DEF = "('derives_from', 'contradicts', 'related_to', 'same_tag', 'co_session')"


def sql_near(name: str, a: str, b: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT {a} AS node, {b} AS other, edge_type, weight, row_number() OVER (PARTITION BY {a} ORDER BY weight DESC, {b}, edge_type) AS rank FROM cur) WHERE rank <= {k})"


VEC = "vec AS (SELECT 'v' || vec_id AS node, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"
TW = "CASE edge_type WHEN 'related_to' THEN weight WHEN 'derives_from' THEN 0.9 WHEN 'contradicts' THEN 0.85 WHEN 'same_tag' THEN 0.6 ELSE 0.5 END"


def sql_hop(h: int, seen: str) -> str:
    return f"""c{h} AS (SELECT f.qid, a.other, a.node AS parent, edge_type, f.qvec,
f.score * pow(0.8, {h}) * (CASE WHEN v.vec IS NULL THEN 0.5 ELSE greatest(0.0, {X.SQL_COS.format(a='f.qvec', b='v.vec')}) END) * {TW} AS cand FROM f{h - 1} f
JOIN adj a ON a.node = f.node LEFT JOIN vec v ON v.node = a.other),
t{h} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cand, 9) DESC, other, parent, edge_type) AS n FROM c{h}),
u{h} AS (SELECT * FROM t{h} WHERE n <= 8 AND (qid, other) NOT IN ({seen})),
f{h} AS (SELECT qid, other AS node, cand AS score, {h} AS hop, edge_type AS relation, qvec FROM (SELECT *, row_number() OVER (PARTITION BY qid, other ORDER BY n) AS k FROM u{h}) WHERE k = 1)"""


ADJ = f"{sql_near('o', 'from_id', 'to_id', 20)}, {sql_near('i', 'to_id', 'from_id', 20)}, adj AS (SELECT node, other, edge_type, weight FROM o UNION ALL SELECT node, other, edge_type, weight FROM i), {VEC}"
SEEDS = "f0 AS (SELECT vec_id AS qid, 'v' || vec_id AS node, 1.0 AS score, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS qvec FROM embeddings WHERE vec_id % 100 = 0)"
S0, S1 = "SELECT (qid, node) FROM f0", "SELECT (qid, node) FROM f0 UNION ALL SELECT (qid, node) FROM f1"


def sql_seen(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT qid, node FROM {n}" for n in names)


ASKED = f"{X.VECTORS}, asked AS (SELECT doc_id AS qid, vec AS qvec FROM vectors WHERE doc_id % 100 = 0)"
KNN = f"""knn AS (SELECT * FROM (SELECT a.doc_id AS qid, b.doc_id,
row_number() OVER (PARTITION BY a.doc_id ORDER BY round({X.SQL_COS.format(a='a.vec', b='b.vec')}, 9) DESC, b.doc_id) AS rank FROM vectors a
JOIN vectors b ON a.doc_id <> b.doc_id) WHERE rank <= 5)"""


def sql_walk(links: str, nodes: str, damping: float, rounds: int, tol: float) -> str:
    """walk (node, rank, it): rounds of the walk over links (from_id, to_id, share) until the change is below tol; last_ is the last of them."""
    raw = f"{damping} * coalesce(f.flow, 0) + {round(1 - damping, 9)} / (SELECT count(*) FROM {nodes})"
    return f"""walk AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM {nodes}) AS rank, 0 AS it, 1.0::DOUBLE AS change FROM {nodes}
  UNION ALL SELECT node, raw / total, it + 1, sum(abs(raw / total - old)) OVER () FROM (
    SELECT o.node, o.rank AS old, o.it, {raw} AS raw, sum({raw}) OVER () AS total
    FROM walk o LEFT JOIN (SELECT to_id, sum(share * rank) AS flow FROM {links} JOIN walk ON node = from_id GROUP BY to_id) f ON f.to_id = o.node WHERE o.it < {rounds} AND o.change >= {tol})),
last_ AS (SELECT node, rank FROM walk WHERE it = (SELECT max(it) FROM walk))"""


SURPRISE = f"""WITH RECURSIVE {X.VECTORS}, {KNN}, links AS MATERIALIZED (SELECT qid AS from_id, doc_id AS to_id, 0.2::DOUBLE AS share FROM knn), nodes AS (SELECT doc_id AS node FROM vectors),
{sql_walk("links", "nodes", 1.0, 200, 1e-10)}, s AS (SELECT node AS doc_id, -ln(rank + 1e-15) AS surprisal FROM last_)"""
EDGE_ROW = "from_id, to_id, edge_type, weight"
ONCE = "d AS (SELECT DISTINCT ON (from_id, to_id, edge_type) * FROM edges ORDER BY from_id, to_id, edge_type, valid_at DESC)"

ROOTS = f"""WITH RECURSIVE {X.EDGES}, cur AS (SELECT * FROM edges WHERE invalid_at IS NULL AND edge_type IN {DEF}), adj AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM cur UNION SELECT to_id, from_id FROM cur),
r AS (SELECT a AS node, a AS root, 0 AS it, 1::HUGEINT AS moved FROM (SELECT DISTINCT a FROM adj)
  UNION ALL SELECT node, fresh, it + 1, sum(CAST(fresh <> root AS INTEGER)) OVER () FROM (
    SELECT o.node, o.root, o.it, least(o.root, m.root) AS fresh FROM r o JOIN (SELECT b AS node, min(root) AS root FROM adj JOIN r ON node = a GROUP BY b) m USING (node) WHERE o.moved > 0))"""

QUERIES = {
    "neighbors_topk": (neighbors_topk, f"{E}, {sql_near('o', 'from_id', 'to_id', 5)} SELECT node, other, edge_type, weight, rank FROM o"),
    "predecessors_topk": (predecessors_topk, f"{E}, {sql_near('o', 'to_id', 'from_id', 5)} SELECT node, other, edge_type, weight, rank FROM o"),
    "all_edges": (all_edges, f"{E}, {BOTH} SELECT node, other, edge_type, weight, direction FROM both_"),
    "temporal_neighbors": (
        temporal_neighbors,
        f"""{E}, c AS (SELECT to_id AS node, count(*) AS n FROM cur WHERE edge_type = 'contradicts' GROUP BY to_id) SELECT from_id, to_id, edge_type,
round(weight * pow(0.98, greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(valid_at)) / 86400000000.0))) * pow(0.98, coalesce(n, 0)), 6) AS score
FROM cur LEFT JOIN c ON node = to_id""",
    ),
    "contradiction_count": (contradiction_count, f"{E} SELECT to_id AS node, count(*) AS n FROM cur WHERE edge_type = 'contradicts' GROUP BY to_id"),
    "edges_by_type": (edges_by_type, f"{E} SELECT from_id, to_id, weight FROM cur WHERE edge_type = 'derives_from'"),
    "edges_as_of": (edges_as_of, f"{E} SELECT {EDGE_ROW} FROM edges WHERE valid_at <= TIMESTAMP '2024-01-03' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-03')"),
    "edge_upsert": (edge_upsert, f"""{E}, {ONCE} SELECT from_id, to_id, edge_type, CASE WHEN edge_type = 'related_to' THEN 0.2::DOUBLE ELSE weight END AS weight,
edge_type = 'related_to' OR invalid_at IS NULL AS is_current FROM d"""),
    "invalidate_node": (invalidate_node, f"{E} SELECT {EDGE_ROW}, invalid_at IS NULL AND from_id NOT IN (SELECT 'v' || vec_id FROM embeddings WHERE label = 0) AS is_current FROM edges"),
    "delete_node": (delete_node, f"""{E}, g AS (SELECT 'v' || vec_id AS node FROM embeddings WHERE label = 0) SELECT {EDGE_ROW}, invalid_at IS NULL AS is_current FROM edges
WHERE from_id NOT IN (SELECT node FROM g) AND to_id NOT IN (SELECT node FROM g)"""),
    "compact_cluster": (
        compact_cluster,
        f"""{E}, m AS (SELECT 'v' || vec_id AS node, 'summary:label:' || label AS summary FROM embeddings), {ONCE} SELECT {EDGE_ROW},
invalid_at IS NULL AND from_id NOT IN (SELECT node FROM m) AND to_id NOT IN (SELECT node FROM m) AS is_current FROM d UNION ALL SELECT summary,
node, 'derives_from', 1.0::DOUBLE, true FROM m""",
    ),
    "list_clusters": (
        list_clusters,
        """WITH c AS (SELECT 'label:' || label AS cluster_id, count(*) AS size, array_to_string(list(vec_id ORDER BY vec_id DESC)[1:3], ',') AS recent FROM embeddings
GROUP BY label), t AS (SELECT * FROM c ORDER BY size DESC, cluster_id LIMIT 8)
SELECT * FROM t UNION ALL SELECT NULL, CAST((SELECT count(*) FROM embeddings) - sum(size) AS BIGINT), NULL FROM t HAVING (SELECT count(*) FROM embeddings) > sum(size)""",
    ),
    "store_counts": (store_counts, f"{E} SELECT corpus, count(*) AS edge_count, count(*) FILTER (invalid_at IS NULL) AS current_count, count(DISTINCT edge_type) AS types FROM edges GROUP BY corpus"),
    "common_neighbors": (
        common_neighbors,
        f"""{E}, {BOTH}, nb AS MATERIALIZED (SELECT DISTINCT node, other FROM both_), p AS MATERIALIZED (SELECT DISTINCT from_id AS a, to_id AS b FROM cur
WHERE edge_type = 'related_to' AND from_id < to_id), x AS MATERIALIZED (SELECT a, b, other FROM p JOIN nb ON node = a)
SELECT a || '|' || b AS gid, x.other AS node FROM x JOIN nb y ON y.node = x.b AND y.other = x.other""",
    ),
    "source_edges": (source_edges, """SELECT vec_id AS from_id, unnest([vec_id // 2,
vec_id // 3]) AS to_id, CASE WHEN vec_id % 7 = 0 THEN 'contradicts' ELSE 'derives_from' END AS edge_type, CAST(CASE WHEN vec_id % 7 = 0 THEN 0.85 ELSE 0.9 END AS DOUBLE) AS weight
FROM embeddings"""),
    "same_tag_edges": (same_tag_edges, """WITH c AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents), e AS (SELECT p AS from_id, doc_id AS to_id FROM c
WHERE p IS NOT NULL) SELECT *, 'same_tag' AS edge_type, CAST(0.6 AS DOUBLE) AS weight FROM (SELECT * FROM e UNION ALL SELECT to_id, from_id FROM e)"""),
    "co_session_edges": (co_session_edges, f"""WITH {X.HISTORY}, c AS (SELECT id, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS p FROM history), e AS (SELECT p AS from_id, id AS to_id FROM c
WHERE p IS NOT NULL) SELECT *, 'co_session' AS edge_type, CAST(0.5 AS DOUBLE) AS weight FROM (SELECT * FROM e UNION ALL SELECT to_id, from_id FROM e)"""),
    "related_edges": (
        related_edges,
        f"""WITH {ASKED}, n AS (SELECT * FROM (SELECT qid, doc_id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) AS k FROM (SELECT qid,
doc_id, {X.SQL_COS.format(a='qvec', b='vec')} AS sim FROM vectors, asked WHERE qid <> doc_id)) WHERE k <= 5 AND sim >= 0.2) SELECT qid AS from_id,
doc_id AS to_id, round(sim, 4) AS weight FROM n UNION SELECT doc_id, qid, round(sim, 4) FROM n""",
    ),
    "beam_search": (beam_search, f"""{E}, {ADJ}, {SEEDS}, {sql_hop(1, S0)}, {sql_hop(2, S1)} SELECT qid, node, round(score, 6) AS score, CAST(hop AS BIGINT) AS hop, relation FROM (SELECT * FROM f1
UNION ALL SELECT * FROM f2)"""),
    "beam_search_mmr": (
        beam_search_mmr,
        f"""{E.replace('WITH', 'WITH RECURSIVE', 1)}, {ADJ}, {SEEDS}, {sql_hop(1, S0)}, {sql_hop(2, S1)}, h AS MATERIALIZED (SELECT qid, node, score, vec FROM (SELECT qid, node, score FROM f1 UNION ALL SELECT qid, node, score FROM f2) JOIN vec USING (node)),
near AS MATERIALIZED (SELECT a.qid, a.node, b.node AS other, {X.SQL_COS.format(a='a.vec', b='b.vec')} AS sim FROM h a JOIN h b ON a.qid = b.qid),
r AS (SELECT DISTINCT qid, 0::BIGINT AS place, NULL::VARCHAR AS node, []::VARCHAR[] AS chosen FROM h
  UNION ALL SELECT qid, place + 1, node, list_append(chosen, node) FROM (
    SELECT r.qid, r.place, r.chosen, h.node, row_number() OVER (PARTITION BY r.qid ORDER BY round(0.7 * h.score - 0.3 * coalesce((SELECT max(sim) FROM near n WHERE n.qid = h.qid AND n.node = h.node AND list_contains(r.chosen, n.other)), 0), 12) DESC, h.score DESC, h.node) AS k
    FROM r JOIN h ON h.qid = r.qid WHERE NOT list_contains(r.chosen, h.node)) WHERE k = 1)
SELECT qid, node, place FROM r WHERE place > 0""",
    ),
    "multi_angle_merge": (
        multi_angle_merge,
        f"""{E}, {ADJ}, f0 AS (SELECT e.vec_id * 10 + a AS qid, 'v' || e.vec_id AS node, 1.0 AS score, list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)) AS qvec
FROM embeddings e, (SELECT unnest(range(3)) AS a) JOIN embeddings q ON q.vec_id = e.vec_id + a WHERE e.vec_id % 100 = 0), {sql_hop(1, S0)}, {sql_hop(2, S1)}
SELECT qid // 10 AS qid, node, round(max(score), 6) AS score FROM (SELECT qid, node, score FROM f1 UNION ALL SELECT qid, node, score FROM f2) GROUP BY ALL""",
    ),
    "neighbor_merge": (
        neighbor_merge,
        f"""{E}, {ADJ}, {SEEDS}, {sql_hop(1, S0)}, {sql_hop(2, S1)}, {ASKED},
hits AS MATERIALIZED (SELECT qid, 'v' || doc_id AS node, 2.0 / (16 + k) AS rrf FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round({X.SQL_COS.format(a='qvec', b='vec')}, 9) DESC, doc_id) - 1 AS k FROM vectors, asked) WHERE k < 10)
SELECT qid, node, round(rrf, 6) AS rrf FROM hits
UNION ALL SELECT qid, node, round(0.5 * max(score), 6) FROM (SELECT qid, node, score FROM f1 UNION ALL SELECT qid, node, score FROM f2) WHERE (qid, node) NOT IN (SELECT (qid, node) FROM hits) GROUP BY qid, node""",
    ),
    "use_case_rerank": (
        use_case_rerank,
        f"""{E}, {ADJ}, {SEEDS}, {sql_hop(1, S0)}, {sql_hop(2, S1)}, cases AS (SELECT vec_id - 1 AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS uvec FROM embeddings WHERE vec_id % 100 = 1)
SELECT qid, node, round(score * (0.5 + 0.5 * CASE WHEN v.vec IS NULL THEN 0 ELSE greatest(0.0, {X.SQL_COS.format(a='uvec', b='v.vec')}) END), 6) AS score
FROM (SELECT qid, node, score FROM f1 UNION ALL SELECT qid, node, score FROM f2) JOIN cases USING (qid) LEFT JOIN vec v USING (node)""",
    ),
    "graph_expand": (
        graph_expand,
        f"""{E}, {sql_near('o', 'from_id', 'to_id', 8)}, {sql_near('i', 'to_id', 'from_id', 8)}, adj AS (SELECT DISTINCT node, other FROM (SELECT node, other FROM o UNION ALL SELECT node, other FROM i)), {ASKED}, {VEC},
hits AS (SELECT qid, 'v' || doc_id AS node, 2.0 / (16 + k) AS rrf, k + 1 AS rank FROM (SELECT qid, doc_id,
row_number() OVER (PARTITION BY qid ORDER BY round({X.SQL_COS.format(a='qvec', b='vec')}, 9) DESC, doc_id) - 1 AS k FROM vectors, asked) WHERE k < 10),
e0 AS (SELECT qid, node FROM hits WHERE rank <= 5), e1 AS (SELECT DISTINCT qid, other AS node FROM e0 JOIN adj USING (node) WHERE (qid, other) NOT IN (SELECT (qid, node) FROM e0)),
e2 AS (SELECT DISTINCT qid, other AS node FROM e1 JOIN adj USING (node) WHERE (qid, other) NOT IN (SELECT (qid, node) FROM e0 UNION ALL SELECT (qid, node) FROM e1)),
c AS (SELECT qid, node, {X.SQL_COS.format(a='qvec', b='vec')} AS sim FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) JOIN vec USING (node)
JOIN asked USING (qid) WHERE (qid, node) NOT IN (SELECT (qid, node) FROM hits)),
s AS (SELECT qid, min(rrf) AS lo, max(rrf) AS hi FROM hits GROUP BY qid), x AS (SELECT qid, node, rrf FROM hits UNION ALL SELECT qid, node,
lo + (hi - lo) * greatest(0.0, (sim - 0.1) / 0.9) FROM c JOIN s USING (qid) WHERE sim >= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, node) AS rank FROM x) SELECT qid, node, round(rrf, 6) AS rrf, rank FROM r WHERE rank <= 10""",
    ),
    "shortest_path": (
        shortest_path,
        f"""WITH RECURSIVE {X.EDGES}, cur AS (SELECT * FROM edges WHERE invalid_at IS NULL AND edge_type IN {DEF}), adj AS MATERIALIZED (SELECT node, other,
min(edge_type) AS via FROM (SELECT *, row_number() OVER (PARTITION BY node, d ORDER BY weight DESC, other, edge_type) AS place
FROM (SELECT 1 AS d, from_id AS node, to_id AS other, edge_type, weight FROM cur UNION ALL SELECT 2, to_id, from_id, edge_type, weight FROM cur)) WHERE place <= 100 GROUP BY ALL),
p AS (SELECT vec_id AS pid, 'v' || vec_id AS a, 'v' || (vec_id - 100) AS b FROM embeddings WHERE vec_id % 100 = 0 AND vec_id > 0),
bfs AS (SELECT pid, a AS node, 0 AS d FROM p UNION SELECT pid, other, d + 1 FROM bfs JOIN adj USING (node) WHERE d < {PATH_DEPTH}),
dist AS MATERIALIZED (SELECT pid, node, min(d) AS d FROM bfs GROUP BY ALL),
up AS MATERIALIZED (SELECT c.pid, c.node, c.d, min(CASE WHEN q.node IS NOT NULL THEN {{'node': q.node, 'via': a.via}} END) AS p FROM dist c LEFT
JOIN adj a ON a.other = c.node LEFT JOIN dist q ON q.pid = c.pid AND q.node = a.node AND q.d = c.d - 1 GROUP BY c.pid, c.node, c.d),
path AS (SELECT u.* FROM up u JOIN p ON u.pid = p.pid AND u.node = p.b UNION ALL SELECT u.* FROM path x JOIN up u ON u.pid = x.pid AND u.node = x.p.node)
SELECT pid, CAST(d AS BIGINT) AS step, node, p.via AS via FROM path""",
    ),
    "annotated_edges": (annotated_edges, f"""{E}, {sql_near('o', 'from_id', 'to_id', 3)}, {SEEDS}, a AS (SELECT node, string_agg(edge_type || ':' || other, ',' ORDER BY rank) AS edges FROM o GROUP BY node)
SELECT qid, node, edges FROM f0 LEFT JOIN a USING (node)"""),
    "pagerank_k": (
        pagerank_k,
        f"""{E.replace('WITH', 'WITH RECURSIVE', 1)}, w AS (SELECT from_id, to_id, sum(weight) AS w FROM cur WHERE edge_type <> 'occurred_in' GROUP BY ALL),
links AS MATERIALIZED (SELECT from_id, to_id, w / sum(w) OVER (PARTITION BY from_id) AS share FROM w), nodes AS MATERIALIZED (SELECT from_id AS node
FROM links UNION SELECT to_id FROM links),
{sql_walk("links", "nodes", 0.85, 100, 1e-6)} SELECT node, round(rank, 9) AS rank FROM last_""",
    ),
    "knn_maintained": (
        knn_maintained,
        f"""WITH {X.VECTORS}, s AS (SELECT a.doc_id AS qid, b.doc_id, {X.SQL_COS.format(a='a.vec', b='b.vec')} AS sim FROM vectors a JOIN vectors b ON a.doc_id <> b.doc_id)
SELECT qid, doc_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, doc_id) AS n FROM s) WHERE n <= 5""",
    ),
    "surprisal_k": (surprisal_k, f"{SURPRISE} SELECT doc_id, round(surprisal, 6) AS surprisal, round((surprisal - min(surprisal) OVER ()) / (max(surprisal) OVER () - min(surprisal) OVER ()), 6) AS normalized FROM s"),
    "surprisal_incremental": (surprisal_incremental, f"""{SURPRISE}, h AS (SELECT max(doc_id) // 2 AS half FROM vectors), n AS (SELECT s.*, row_number() OVER (ORDER BY round(surprisal, 9) DESC, doc_id) AS k,
count(*) OVER () AS c FROM s, h WHERE doc_id > half) SELECT doc_id, round(surprisal, 6) AS surprisal FROM n WHERE k <= greatest(1, floor(c * 0.1))"""),
    "local_entropy": (local_entropy, f"""{E}, {BOTH}, c AS (SELECT node, edge_type, count(*) AS n FROM both_ WHERE edge_type IN {DEF} GROUP BY ALL), t AS (SELECT node,
n / sum(n) OVER (PARTITION BY node) AS p FROM c) SELECT node, round(sum(-p * log2(p)), 6) AS entropy FROM t GROUP BY node"""),
    "entropy_production": (
        entropy_production,
        f"""WITH {X.EDGES}, cur AS (SELECT * FROM edges WHERE invalid_at IS NULL AND edge_type IN {DEF}), {BOTH}, ends AS (SELECT node, other, count(*) AS own FROM both_
GROUP BY ALL), deg AS (SELECT node, sum(own) AS degree FROM ends GROUP BY node),
x AS (SELECT e.node, d.degree AS a, greatest(0, d.degree - e.own) AS b, sum(d.degree) OVER w AS ta, greatest(1, sum(greatest(0, d.degree - e.own)) OVER w) AS tb
FROM ends e JOIN deg d ON d.node = e.other WINDOW w AS (PARTITION BY e.node))
SELECT node, round(abs(sum(CASE WHEN a > 0 THEN -(a / ta) * log2(a / ta) ELSE 0 END) - sum(CASE WHEN b > 0 THEN -(b / tb) * log2(b / tb) ELSE 0 END)), 6) AS production FROM x GROUP BY node""",
    ),
    "degree_stats": (degree_stats, f"{E}, {BOTH} SELECT node, count(*) AS degree, count(DISTINCT other) AS neighbors, round(sum(weight), 6) AS weight FROM both_ GROUP BY node"),
    "components": (
        components,
        f"""{ROOTS} SELECT node, root FROM r WHERE it = (SELECT max(it) FROM r)""",
    ),
    "session_components": (
        session_components,
        f"""WITH RECURSIVE {X.EDGES}, cur AS (SELECT from_id, to_id FROM edges WHERE invalid_at IS NULL AND edge_type = 'co_session'), adj AS (SELECT from_id AS a,
to_id AS b FROM cur UNION SELECT to_id, from_id FROM cur), r AS (SELECT a AS node, a AS reach FROM adj UNION SELECT r.node, b FROM r JOIN adj ON a = reach),
m AS (SELECT node, min(reach) AS root FROM r GROUP BY node) SELECT root, count(*) AS size FROM m GROUP BY root""",
    ),
    "betweenness": (
        betweenness,
        f"""WITH RECURSIVE {X.EDGES}, cur AS (SELECT * FROM edges WHERE invalid_at IS NULL AND edge_type IN {DEF} AND from_id <> to_id), adj AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM cur UNION SELECT to_id, from_id FROM cur), nodes AS MATERIALIZED (SELECT DISTINCT a AS node FROM adj),
ahead AS (SELECT node AS s, node, 0 AS d, 1.0::DOUBLE AS sigma, true AS front FROM nodes
  UNION ALL (WITH fresh AS (SELECT f.s, adj.b AS node, max(f.d) + 1 AS d, sum(f.sigma) AS sigma FROM ahead f JOIN adj ON adj.a = f.node WHERE f.front AND (f.s, adj.b) NOT IN (SELECT (s, node) FROM ahead) GROUP BY f.s, adj.b)
    SELECT s, node, d, sigma, true FROM fresh UNION ALL SELECT s, node, d, sigma, false FROM ahead WHERE front AND EXISTS (SELECT 1 FROM fresh))),
levels AS MATERIALIZED (SELECT s, node, d, sigma FROM ahead WHERE front),
back AS (SELECT s, node, d, sigma, 0.0::DOUBLE AS delta FROM levels WHERE d = (SELECT max(d) FROM levels)
  UNION ALL SELECT l.s, l.node, l.d, l.sigma, coalesce(l.sigma * x.x, 0) FROM (SELECT max(d) - 1 AS d FROM back) u JOIN levels l ON l.d = u.d
    LEFT JOIN (SELECT w.s, adj.b AS node, sum((1 + w.delta) / w.sigma) AS x FROM back w JOIN adj ON adj.a = w.node GROUP BY w.s, adj.b) x ON x.s = l.s AND x.node = l.node)
SELECT nodes.node, round(coalesce(sum(delta), 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 6) AS betweenness FROM nodes LEFT JOIN back ON back.node = nodes.node AND back.s <> back.node GROUP BY nodes.node""",
    ),
    "laplacian_spectrum": (
        laplacian_spectrum,
        f"""{ROOTS}, big AS (SELECT count(*) AS n FROM r WHERE it = (SELECT max(it) FROM r) GROUP BY root ORDER BY n DESC LIMIT 1)
SELECT i AS pair, i = 0 AS is_zero, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, 0.0::DOUBLE AS overlap FROM (SELECT unnest(range(least(6, n))) AS i FROM big)""",
    ),
    "fiedler": (fiedler, None),
    "rmt_novel": (rmt_novel, None),
    "full_analysis": (full_analysis, None),
}
