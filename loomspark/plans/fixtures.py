"""Engine tables derived from the given ones, as DataFrames and as the CTEs of the same definition for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.session import read_table

RE = T.TERM


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("lang:"), "lang").alias("corpus"), F.col("source").alias("source_id"), F.col("text").alias("body"))


DOCS = "docs AS (SELECT doc_id, 'lang:' || lang AS corpus, source AS source_id, text AS body FROM documents)"


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with dates, from orders."""
    day = F.to_date("o_orderdate")
    body = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" placed "), day.cast("string"), F.lit(" priority "), "o_orderpriority", F.lit(", reviewed in "), F.date_format(F.add_months(day, 1), "MMMM yyyy"))
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("body"))


DATED = """dated AS (SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey || ' placed ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' priority ' || o_orderpriority || ', reviewed in ' || strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%B %Y') AS body
FROM orders)"""
SQL_ISO = "list_filter(list_transform(regexp_extract_all(body, '\\b\\d{4}-\\d{2}-\\d{2}\\b'), lambda d: TRY_CAST(d AS DATE)), lambda d: d IS NOT NULL)"
SQL_MONTH = f"list_transform(regexp_extract_all(body, '(?i)\\b({'|'.join(T.MONTHS)})\\s+\\d{{4}}\\b'), lambda m: CAST(strptime('15 ' || m, '%d %B %Y') AS DATE))"
DATES = f"{DATED}, dates AS (SELECT doc_id, body, list_sort(list_distinct(list_concat({SQL_ISO}, {SQL_MONTH}))) AS days FROM dated)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("label:"), F.col("label").cast("string")).alias("corpus"), F.col("embedding").alias("vec"))


VECTORS = "vectors AS (SELECT vec_id AS doc_id, 'label:' || label AS corpus, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a query: its whole text, and the vector of the same number (null if there is none)."""
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return items.join(vectors(spark, sf).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec")), "qid", "left")


def sql_terms(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({column}, '{RE}'), lambda t: lower(t)), lambda t: length(t) <= 64)"


QUERIES = f"{VECTORS}, queries AS (SELECT item_id AS qid, text, v.vec AS qvec FROM benchmark LEFT JOIN vectors v ON v.doc_id = item_id)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A bi-temporal property graph over vectors (v), conversation turns (c) and orders (o) with their periods."""
    v = read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    own = W.partitionBy("label").orderBy("vec_id")
    named = v.select("vec_id", "label", "embedding", F.lag("vec_id", 1).over(own).alias("prev"), F.lag("embedding", 1).over(own).alias("prev_vec"), F.lag("vec_id", 3).over(own).alias("third"))
    node = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))

    def edge(rows: DataFrame, a, b, kind: str, weight, number="vec_id") -> DataFrame:
        return rows.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"), F.col(number).cast("long").alias("number"))

    close = named.where("prev is not null").withColumn("w", F.round(F.abs(T.cosine("embedding", "prev_vec")), 6))
    tag = named.where("third is not null")
    half = v.withColumn("half", F.expr("vec_id div 2")).where("vec_id > 0")
    seventh = v.where("vec_id % 7 = 0").withColumn("next", F.col("vec_id") + 1)
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    turn = lambda c: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.col(c).cast("string"))
    after = turns.withColumn("next", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    when = read_table(spark, sf, "orders").select("o_orderkey", F.explode(T.day_periods(F.to_date("o_orderdate"))).alias("period"))
    parts = [
        edge(close, node("prev"), node("vec_id"), "related_to", F.col("w")),
        edge(close, node("vec_id"), node("prev"), "related_to", F.col("w")),
        edge(tag, node("third"), node("vec_id"), "same_tag", F.lit(0.6)),
        edge(tag, node("vec_id"), node("third"), "same_tag", F.lit(0.6)),
        edge(half, node("vec_id"), node("half"), "derives_from", F.lit(0.9)),
        edge(seventh, node("vec_id"), node("next"), "contradicts", F.lit(0.85)),
        edge(after, turn("turn"), turn("next"), "co_session", F.lit(0.5), "conv_id"),
        edge(when, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("period"), "occurred_in", F.lit(1.0), "o_orderkey"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    valid = F.timestamp_seconds(F.lit(1704067200) + F.col("number") % 500000 * 60)
    return rows.select("from_id", "to_id", "edge_type", F.lit("main").alias("corpus"), "weight", valid.alias("valid_at"), F.when(F.col("number") % 11 == 0, valid + F.expr("interval 1 day")).alias("invalid_at"))


SQL_COS = "(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))"
EDGES = f"""
named AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, lag(vec_id, 1) OVER w AS prev, lag(list_transform(embedding,
lambda x: CAST(x AS DOUBLE)), 1) OVER w AS pvec, lag(vec_id, 3) OVER w AS third FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
close AS (SELECT vec_id, prev, round(abs({SQL_COS.format(a='vec', b='pvec')}), 6) AS w FROM named WHERE prev IS NOT NULL),
turns AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
raw AS (
  SELECT 'v' || prev AS from_id, 'v' || vec_id AS to_id, 'related_to' AS edge_type, w AS weight, vec_id AS number FROM close
  UNION ALL SELECT 'v' || vec_id, 'v' || prev, 'related_to', w, vec_id FROM close
  UNION ALL SELECT 'v' || third, 'v' || vec_id, 'same_tag', 0.6, vec_id FROM named WHERE third IS NOT NULL
  UNION ALL SELECT 'v' || vec_id, 'v' || third, 'same_tag', 0.6, vec_id FROM named WHERE third IS NOT NULL
  UNION ALL SELECT 'v' || vec_id, 'v' || (vec_id // 2), 'derives_from', 0.9, vec_id FROM embeddings WHERE vec_id > 0
  UNION ALL SELECT 'v' || vec_id, 'v' || (vec_id + 1), 'contradicts', 0.85, vec_id FROM embeddings WHERE vec_id % 7 = 0
  UNION ALL SELECT 'c' || conv_id || ':' || turn, 'c' || conv_id || ':' || nxt, 'co_session', 0.5, conv_id FROM turns WHERE nxt IS NOT NULL
  UNION ALL SELECT 'o' || o_orderkey,
unnest(['month:' || strftime(o_orderdate, '%Y-%m'), 'quarter:' || strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), 'year:' || strftime(o_orderdate, '%Y')]), 'occurred_in', 1.0,
o_orderkey FROM orders),
edges AS (SELECT from_id, to_id,
edge_type, 'main' AS corpus, CAST(weight AS DOUBLE) AS weight, TIMESTAMP '2024-01-01' + to_minutes(number % 500000) AS valid_at, CASE WHEN number % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(number % 500000) + INTERVAL 1 DAY END AS invalid_at
FROM raw)"""


def doc_access(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "events").select((F.col("event_id") % 500).alias("doc_id"), (F.col("user_id") % 4).cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("doc_id", "agent_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


ACCESS = "doc_access AS (SELECT event_id % 500 AS doc_id, CAST(user_id % 4 AS VARCHAR) AS agent_id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY ALL)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 4).cast("string").alias("agent_id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"))


HISTORY = "history AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id % 4 AS VARCHAR) AS agent_id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content FROM conversations)"


#: Date phrases as they are written into documents and queries of the search flow, from the order of the same number.
def _dated(rows: DataFrame, spark: SparkSession, sf: str, key: str, text: str, phrase: Column) -> DataFrame:
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias(key), F.to_date("o_orderdate").alias("day"))
    return rows.join(orders, key, "left").withColumn(text, F.when(F.col("day").isNull(), F.col(text)).otherwise(F.concat(F.col(text), phrase)))


def _node(column: str) -> Column:
    return F.concat(F.lit("v"), F.col(column).cast("string"))


def term_vector(terms: Column, dims: int = 64) -> Column:
    """Embedding of an array of terms by their MD5 digests, in functions that SQL has as well."""
    hashed = F.transform(terms, F.md5)
    at = lambda h: F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % dims
    sign = lambda h: F.when(F.substring(h, 3, 1) < "8", 1.0).otherwise(-1.0)
    pairs = F.transform(hashed, lambda h: F.struct(at(h).alias("at"), sign(h).alias("sign")))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(pairs, lambda p: p["at"] == d), F.lit(0.0), lambda s, p: s + p["sign"]))


def flow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, vectors, edges, queries) of the search flow over common ids: documents that name the day of the order of
    their number, period edges of orders as those of documents, and benchmark items that ask for a month and exclude
    their last term."""
    written = _dated(docs(spark, sf), spark, sf, "doc_id", "body", F.concat(F.lit(" Noted on "), F.col("day").cast("string"), F.lit(".")))
    found = written.select(_node("doc_id").alias("doc_id"), "corpus", "body", T.dates("body").alias("days"))
    near = edges(spark, sf).withColumn("from_id", F.regexp_replace("from_id", "^o", "v"))
    asked = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", F.element_at(T.terms("text"), -1).alias("last"))
    asked = _dated(asked, spark, sf, "qid", "text", F.concat(F.lit(" in "), F.date_format("day", "MMMM yyyy")))
    return found, vectors(spark, sf).select(_node("doc_id").alias("doc_id"), "vec"), near, asked.select("qid", F.concat("text", F.lit(" besides "), "last").alias("text"))


def sql_term_vector(terms: str) -> str:
    at, sign = "CAST('0x' || substr(h, 1, 2) AS INTEGER) % 64", "CASE WHEN substr(h, 3, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    return f"list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter(list_transform({terms}, lambda t: md5(t)), lambda h: {at} = d), lambda h: {sign})), 0::DOUBLE))"


FLOW = f"""days_of AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders),
docs AS (SELECT 'v' || doc_id AS doc_id, 'lang:' || lang AS corpus,
text || CASE WHEN day IS NULL THEN '' ELSE ' Noted on ' || CAST(day AS VARCHAR) || '.' END AS body, CASE WHEN day IS NULL THEN [] ELSE [day] END AS days
FROM documents LEFT JOIN days_of ON k = doc_id),
vectors AS (SELECT 'v' || vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
queries AS MATERIALIZED (SELECT qid, text, last, m, {sql_term_vector(sql_terms('text'))} AS qvec FROM (
  SELECT item_id AS qid,
text || CASE WHEN day IS NULL THEN '' ELSE ' in ' || strftime(day, '%B %Y') END AS text, ({sql_terms('text')})[-1] AS last, CAST(date_trunc('month',
day) AS DATE) AS m FROM benchmark LEFT JOIN days_of ON k = item_id))"""
