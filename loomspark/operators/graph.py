"""Edge store and traversal. edges: from_id, to_id, edge_type, corpus, weight, valid_at, invalid_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.text import cosine
from loomspark.session import materialize

#: Weights by which beam search values edge types; related_to counts by its own weight (fixed values).
TYPE_WEIGHTS = {"derives_from": 0.9, "contradicts": 0.85, "same_tag": 0.6, "co_session": 0.5}
OTHER_WEIGHT, HOP_DECAY, NO_VECTOR = 0.5, 0.8, 0.5
CODE_TYPES = ("calls", "implements", "depends_on", "defines", "references", "contains")
KEY = ["from_id", "to_id", "edge_type"]
#: Edges out and in that a path search follows from a node (fixed value).
FAN_OUT = 100


def current(edges: DataFrame, types: tuple | None = None) -> DataFrame:
    rows = edges.where("invalid_at is null")
    return rows.where(F.col("edge_type").isin(*types)) if types else rows


def edges_as_of(edges: DataFrame, ts: Column) -> DataFrame:
    """Edges that were valid at a point in time."""
    return edges.where((F.col("valid_at") <= ts) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > ts)))


def upsert(edges: DataFrame, written: DataFrame) -> DataFrame:
    """The last written row of each (from, to, type): written has the columns of edges and seq; edges count as older."""
    return last_written(edges.withColumn("seq", F.lit(-1).cast("long")).unionByName(written)).drop("seq")


def last_written(log: DataFrame) -> DataFrame:
    """Edges from a log of them with seq: the last written row of each (from, to, type)."""
    last = W.partitionBy(*KEY).orderBy(F.desc("seq"), F.desc("valid_at"))
    return log.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def neighbors(edges: DataFrame, limit: int = 20, incoming: bool = False, types: tuple | None = None) -> DataFrame:
    """(node, other, edge_type, weight, rank): each node's heaviest current edges, ties by the other end and type."""
    node, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    rows = current(edges, types).select(F.col(node).alias("node"), F.col(other).alias("other"), "edge_type", "weight")
    order = W.partitionBy("node").orderBy(F.desc("weight"), "other", "edge_type")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def all_edges(edges: DataFrame, types: tuple | None = None) -> DataFrame:
    """(node, other, edge_type, weight, direction): every current edge from both ends."""
    rows = current(edges, types)
    out = rows.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), "edge_type", "weight", F.lit("out").alias("direction"))
    return out.unionByName(rows.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), "edge_type", "weight", F.lit("in").alias("direction")))


def contradictions(edges: DataFrame) -> DataFrame:
    return current(edges, ("contradicts",)).groupBy(F.col("to_id").alias("node")).agg(F.count("*").alias("n"))


def temporal_neighbors(edges: DataFrame, as_of: Column, decay: float = 0.98) -> DataFrame:
    """Current out-edges by weight x decay^(days old) x decay^(contradictions of the other end)."""
    rows = current(edges).join(contradictions(edges).select(F.col("node").alias("to_id"), "n"), "to_id", "left")
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros("valid_at")) / 86400e6))
    return rows.withColumn("score", F.col("weight") * F.pow(F.lit(decay), days) * F.pow(F.lit(decay), F.coalesce("n", F.lit(0)))).select("from_id", "to_id", "edge_type", "score")


def invalidate(edges: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """End the current out-edges of nodes (node)."""
    marked = edges.join(nodes.select(F.col("node").alias("from_id"), F.lit(True).alias("hit")).distinct(), "from_id", "left")
    return marked.withColumn("invalid_at", F.when(F.col("hit") & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at"))).select(*edges.columns)


def delete(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of nodes (node)."""
    gone = nodes.select("node").distinct()
    return edges.join(gone.withColumnRenamed("node", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("node", "to_id"), "to_id", "left_anti").select(*edges.columns)


def compact_clusters(edges: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """End all current edges that touch members (node, summary), then add summary -> member derives_from edges."""
    hit = members.select("node").distinct()
    ended = edges.join(hit.select(F.col("node").alias("from_id"), F.lit(True).alias("a")), "from_id", "left").join(hit.select(F.col("node").alias("to_id"), F.lit(True).alias("b")), "to_id", "left")
    ended = ended.withColumn("invalid_at", F.when((F.col("a") | F.col("b")) & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at"))).select(*edges.columns)
    corpus = F.lit("main") if "corpus" not in members.columns else F.col("corpus")
    fresh = members.select(F.col("summary").alias("from_id"), F.col("node").alias("to_id"), F.lit("derives_from").alias("edge_type"), corpus.alias("corpus"), F.lit(1.0).alias("weight"), now.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    return upsert(ended, fresh.withColumn("seq", F.lit(1).cast("long")))


def common_neighbors(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, node): nodes adjacent, in either direction, to all members of each group (gid, node)."""
    members = groups.distinct()
    size = members.groupBy("gid").agg(F.count("*").alias("size"))
    near = all_edges(edges).select("node", "other").distinct()
    met = members.join(near, "node").groupBy("gid", "other").agg(F.count("*").alias("n"))
    return met.join(size, "gid").where("n = size").select("gid", F.col("other").alias("node"))


def attribute_edges(rows: DataFrame, attribute: str, kind: str, weight: float) -> DataFrame:
    """Symmetric edges between rows (doc_id, <attribute>) of equal attribute, as a chain in doc_id order, so that groups
    of any size stay connected with as many edges as rows. Rows are dealt by ranges of attribute and doc_id, so that a
    large group is many tasks' work; the ends of neighbouring ranges are joined afterwards."""
    dealt = rows.select("doc_id", F.col(attribute).alias("a")).repartitionByRange("a", "doc_id").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "dealt")
    inside = dealt.withColumn("before", F.lag("doc_id").over(W.partitionBy("range", "a").orderBy("doc_id"))).where("before is not null").select("before", "doc_id")
    ends = dealt.groupBy("a", "range").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(W.partitionBy("a").orderBy("range"))).where("before is not null").select("before", "doc_id")
    one = inside.unionByName(across).select(F.col("before").alias("from_id"), F.col("doc_id").alias("to_id"))
    return one.union(one.select("to_id", "from_id")).withColumn("edge_type", F.lit(kind)).withColumn("weight", F.lit(weight))


def source_edges(docs: DataFrame) -> DataFrame:
    """Edges to each document's sources: contradicts .85 at level contradiction, else derives_from .9."""
    clash = F.col("level") == "contradiction"
    return docs.select(F.col("doc_id").alias("from_id"), F.explode("source_ids").alias("to_id"), F.when(clash, "contradicts").otherwise("derives_from").alias("edge_type"), F.when(clash, 0.85).otherwise(0.9).alias("weight"))


def type_weight() -> Column:
    table = F.create_map(*[x for k, v in TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.col("edge_type") == "related_to", F.col("weight")).otherwise(F.coalesce(F.try_element_at(table, F.col("edge_type")), F.lit(OTHER_WEIGHT)))


def heaviest(edges: DataFrame, at: DataFrame, per_node: int, types: tuple | None = None) -> DataFrame:
    """(node, other, edge_type, weight): the heaviest current edges of the nodes of `at` (node), per_node out and per_node
    in. Only these nodes' edges are ranked; Spark broadcasts the nodes as long as they are few."""
    nodes = at.select("node").distinct()
    out, into = (current(edges, types).join(nodes.withColumnRenamed("node", end), end, "left_semi") for end in ("from_id", "to_id"))
    return neighbors(out, per_node).unionByName(neighbors(into, per_node, incoming=True)).select("node", "other", "edge_type", "weight")


def beam_search(edges: DataFrame, vectors: DataFrame, seeds: DataFrame, hops: int = 2, beam: int = 8, per_node: int = 20) -> DataFrame:
    """(qid, node, score, hop, relation) around seeds (qid, node, score, qvec), a beam of edges per query and hop.

    A candidate row is an edge: parent score x HOP_DECAY^hop x max(0, cosine) x type weight. The best `beam` rows of a
    query count, already seen ends are skipped, and of rows to one end the best is kept. Of several vectors of a node
    (its chunks) the nearest counts.
    """
    hops = min(3, max(1, hops))
    frontier = seeds.select("qid", "node", "score", "qvec")
    seen, out = seeds.select("qid", "node"), None
    for hop in range(1, hops + 1):
        rows = frontier.join(heaviest(edges, frontier, per_node), "node")
        ends = materialize(rows.select("qid", "other", "qvec").dropDuplicates(["qid", "other"]), "beam-ends")
        sims = ends.join(vectors.where("vec is not null").select(F.col("node").alias("other"), "vec"), "other").groupBy("qid", "other").agg(F.max(cosine("qvec", "vec")).alias("sim"))
        rows = rows.join(sims, ["qid", "other"], "left")
        sim = F.when(F.col("sim").isNull(), NO_VECTOR).otherwise(F.greatest(F.lit(0.0), F.col("sim")))
        rows = rows.withColumn("cand", F.col("score") * HOP_DECAY**hop * sim * type_weight())
        order = W.partitionBy("qid").orderBy(F.desc(F.round("cand", 9)), "other", "node", "edge_type")
        top = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= beam)
        top = top.join(seen.select("qid", F.col("node").alias("other")), ["qid", "other"], "left_anti")
        first = W.partitionBy("qid", "other").orderBy("n")
        found = top.withColumn("k", F.row_number().over(first)).where("k = 1").select("qid", F.col("other").alias("node"), F.col("cand").alias("score"), F.lit(hop).cast("long").alias("hop"), F.col("edge_type").alias("relation"), "qvec")
        found = materialize(found, "beam")
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(found.select("qid", "node"))
        frontier = found.select("qid", "node", "score", "qvec")
    return out.select("qid", "node", "score", "hop", "relation")


def merge_angles(hits: DataFrame) -> DataFrame:
    """Best score of each node over the angles (qid, angle, node, score) of a query."""
    return hits.groupBy("qid", "node").agg(F.max("score").alias("score"))


def use_case_rerank(hits: DataFrame, vectors: DataFrame, use_case: DataFrame) -> DataFrame:
    """Scores of hits (qid, node, score) x (0.5 + 0.5 x max(0, cosine)) to the query's use case (qid, uvec)."""
    rows = hits.join(vectors.select("node", "vec"), "node", "left").join(use_case.select("qid", "uvec"), "qid")
    near = F.when(F.col("vec").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), cosine("uvec", "vec")))
    return rows.groupBy("qid", "node").agg(F.max(F.col("score") * (0.5 + 0.5 * near)).alias("score"))


def merge_neighbors(hits: DataFrame, neighbors_: DataFrame, share: float = 0.5) -> DataFrame:
    """hits (qid, node, rrf) and the graph neighbours (qid, node, score) that are not among them, at share x score."""
    fresh = neighbors_.groupBy("qid", "node").agg(F.max("score").alias("score")).join(hits.select("qid", "node"), ["qid", "node"], "left_anti")
    return hits.select("qid", "node", "rrf").unionByName(fresh.select("qid", "node", (share * F.col("score")).alias("rrf")))


def mmr(hits: DataFrame, vectors: DataFrame, trade: float = 0.7) -> DataFrame:
    """(qid, node, place): greedy order by trade x score - (1 - trade) x largest cosine to what is chosen.

    A query has as many hits as its beam admits, so a group is small; hits without vectors drop out.
    """
    import numpy as np
    import pandas as pd

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "node"], ascending=[False, True])
        m = np.stack(group.vec.map(lambda v: np.asarray(v, float)))
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        sims, score, left, chosen = m @ m.T, group.score.to_numpy(), list(range(len(group))), []
        while left:
            value = [round(trade * score[i] - (1 - trade) * max((sims[i, j] for j in chosen), default=0.0), 12) for i in left]
            chosen.append(left.pop(int(np.argmax(value))))
        return pd.DataFrame({"qid": group.qid.iloc[chosen].to_numpy(), "node": group.node.iloc[chosen].to_numpy(), "place": range(1, len(chosen) + 1)})

    kind = dict(hits.dtypes)
    rows = hits.join(vectors.select("node", "vec"), "node").select("qid", "node", "score", "vec")
    return rows.groupBy("qid").applyInPandas(order, f"qid {kind['qid']}, node {kind['node']}, place long")


def graph_expand(hits: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame, seeds: int = 5, per_node: int = 8, least: float = 0.55, keep: int = 10) -> DataFrame:
    """hits (qid, node, rrf, rank) with the nodes two hops around the best ones whose cosine reaches `least`, placed
    between the smallest and largest rrf of the hits."""
    frontier = hits.where(F.col("rank") <= seeds).select("qid", "node")
    seen = frontier
    for _ in range(2):
        near = heaviest(edges, frontier, per_node).select("node", "other").distinct()
        frontier = materialize(frontier.join(near, "node").select("qid", F.col("other").alias("node")).distinct().join(seen, ["qid", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    fresh = seen.join(hits.select("qid", "node"), ["qid", "node"], "left_anti").join(vectors, "node").join(queries.select("qid", "qvec"), "qid")
    fresh = fresh.groupBy("qid", "node").agg(F.max(cosine("qvec", "vec")).alias("sim")).where(F.col("sim") >= least)
    span = hits.groupBy("qid").agg(F.min("rrf").alias("lo"), F.max("rrf").alias("hi"))
    placed = fresh.join(span, "qid").select("qid", "node", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.greatest(F.lit(0.0), (F.col("sim") - least) / (1 - least))).alias("rrf"))
    order = W.partitionBy("qid").orderBy(F.desc(F.round("rrf", 9)), "node")
    return hits.select("qid", "node", "rrf").unionByName(placed).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)


def two_sided(edges: DataFrame, pairs: DataFrame, max_depth: int = 10, types: tuple | None = None, per_node: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """(paths, reached): paths as shortest_paths; reached (pid, side, node, depth), all that was visited on the way.

    Each round expands one level of every open pair, on the side whose frontier is smaller, along the per_node heaviest
    edges out and in of each frontier node. A pair ends when a new node was visited from the other side, or when a frontier
    is empty. Paths are then traced: levels beyond the meeting nodes by the links of the side of b, those before by parents.
    """
    other = F.when(F.col("side") == "a", "b").otherwise("a")
    ends = pairs.select("pid", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("node")), F.struct(F.lit("b").alias("side"), F.col("b").alias("node")))).alias("e"))
    start = materialize(ends.select("pid", "e.side", "e.node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via"), F.lit(0).cast("long").alias("depth")), "reached")
    frontier, levels, links = start, [start], []
    met = materialize(pairs.where("a = b").select("pid", F.col("a").alias("node"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("g")), "met")
    meetings = [met]

    def visited() -> DataFrame:
        rows = levels[0]
        for level in levels[1:]:
            rows = rows.unionByName(level)
        return rows

    for _ in range(max_depth):
        open_ = frontier.join(met.select("pid").distinct(), "pid", "left_anti")
        sides = open_.groupBy("pid").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
        turn = sides.where("na > 0 and nb > 0").select("pid", F.when(F.col("na") <= F.col("nb"), "a").otherwise("b").alias("turn"))
        dealt = materialize(open_.join(turn, "pid").select("pid", "side", "node", "depth", (F.col("side") == F.col("turn")).alias("now")), "frontier")
        growing = dealt.where("now")
        if growing.isEmpty():
            break
        near = heaviest(edges, growing, per_node, types).groupBy("node", "other").agg(F.min("edge_type").alias("via"))
        steps = growing.join(near, "node").select("pid", "side", F.col("other").alias("node"), F.col("node").alias("parent"), "via", (F.col("depth") + 1).alias("depth"))
        fresh_links = materialize(steps.join(visited().select("pid", "side", "node"), ["pid", "side", "node"], "left_anti"), "links")
        links.append(fresh_links.where("side = 'b'"))
        first = fresh_links.groupBy("pid", "side", "node").agg(F.min(F.struct("parent", "via")).alias("p"), F.max("depth").alias("depth"))
        fresh = materialize(first.select("pid", "side", "node", "p.parent", "p.via", "depth"), "reached")
        levels.append(fresh)
        far = visited().select("pid", F.col("side").alias("side2"), "node", F.col("depth").alias("depth2"))
        both = fresh.withColumn("side2", other).join(far, ["pid", "side2", "node"])
        both = both.select("pid", "node", F.when(F.col("side") == "a", F.col("depth")).otherwise(F.col("depth2")).alias("f"), F.when(F.col("side") == "b", F.col("depth")).otherwise(F.col("depth2")).alias("g"))
        best = W.partitionBy("pid")
        meetings.append(materialize(both.withColumn("best", F.min(F.col("f") + F.col("g")).over(best)).where("f + g = best").drop("best"), "met"))
        met = met.unionByName(meetings[-1])
        frontier = dealt.where("not now").drop("now").unionByName(fresh.select("pid", "side", "node", "depth"))
    # From the meeting nodes on to b, level by level, all links of shortest paths; then back from b by the smallest.
    met = materialize(met, "met")
    deepest = met.agg(F.max("g"), F.max(F.col("f") + F.col("g"))).first()
    good, onward = met.select("pid", "node", "f", "g"), []
    if deepest[0]:
        all_links = links[0].select("pid", "node", F.col("parent").alias("next"), "via", F.col("depth").alias("g"))
        for part in links[1:]:
            all_links = all_links.unionByName(part.select("pid", "node", F.col("parent").alias("next"), "via", F.col("depth").alias("g")))
        for _ in range(deepest[0]):
            hop = materialize(good.where("g > 0").join(all_links, ["pid", "node", "g"]), "onward")
            onward.append(hop.select("pid", F.col("next").alias("node"), F.col("node").alias("parent"), "via", (F.col("f") + 1).alias("step")))
            good = hop.select("pid", F.col("next").alias("node"), (F.col("f") + 1).alias("f"), (F.col("g") - 1).alias("g")).distinct()
    parents = visited().where("side = 'a'").select("pid", "node", "parent", "via", F.col("depth").alias("step"))
    beyond = met.select("pid", "f").distinct()
    parents = parents.join(beyond, "pid").where("step <= f").drop("f")
    for part in onward:
        parents = parents.unionByName(part)
    parents = materialize(parents.groupBy("pid", "node", "step").agg(F.min(F.struct("parent", "via")).alias("p")).select("pid", "node", "step", "p.parent", "p.via"), "parents")
    at = pairs.join(met.groupBy("pid").agg(F.max(F.col("f") + F.col("g")).alias("step")), "pid").select("pid", F.col("b").alias("node"), "step")
    out = None
    for _ in range((deepest[1] or 0) + 1):
        found = materialize(at.join(parents, ["pid", "node", "step"]), "path")
        rows = found.select("pid", "step", "node", "via")
        out = rows if out is None else out.unionByName(rows)
        at = found.where("step > 0").select("pid", F.col("parent").alias("node"), (F.col("step") - 1).alias("step"))
    return out, visited().select("pid", "side", "node", "depth")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10, types: tuple | None = None, per_node: int = FAN_OUT) -> DataFrame:
    """(pid, step, node, via) along one shortest undirected path of each pair (pid, a, b), a search from both ends: of
    several paths, back from b through the smallest parent and edge type. Pairs without a path of max_depth steps have no
    rows."""
    return two_sided(edges, pairs, max_depth, types, per_node)[0]


def annotate(hits: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """hits (qid, node) with `edges`: up to `most` of the node's heaviest current edges."""
    near = neighbors(edges, most).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "edge_type"))).alias("edges"))
    return hits.join(near, "node", "left")
