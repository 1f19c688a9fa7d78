"""Catalogue: sessions, consolidation, chunking and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import chunking as C
from loomspark.functions import text as T
from loomspark.functions.markdown import chunk_markdown
from loomspark.functions.stemming import stems
from loomspark.operators import records as R
from loomspark.plans import fixtures as X
from loomspark.session import fence, read_table
from loomspark.streaming import access as S


def _events(spark, sf):
    return read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def scratch_latest(spark, sf):
    rows = _events(spark, sf).select(F.lit("a").alias("agent_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("key"), "value", F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return R.scratch(rows).select("session_id", "key", "value")


def task_list(spark, sf):
    rows = _events(spark, sf).select(F.lit("a").alias("agent_id"), F.lit("s").alias("session_id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("title"), F.when(F.col("event_type") == "purchase", "done").otherwise("todo").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return R.tasks(rows, "done").select("task_id", "title", "status")


def history_list(spark, sf):
    return R.history(X.history(spark, sf), 20).select("agent_id", "id", "role", "place")


def history_search(spark, sf):
    return R.history(X.history(spark, sf), 20, "THE").select("agent_id", "id", "place")


def access_counts(spark, sf):
    rows = _events(spark, sf).select((F.col("event_id") % 500).alias("doc_id"), (F.col("user_id") % 4).cast("string").alias("agent_id"), "ts")
    return R.access_counts(rows).select("doc_id", "agent_id", "level", "access_count", F.unix_micros("last_accessed").alias("last_accessed"))


def _inserted(spark, sf):
    return X.vectors(spark, sf).select("doc_id", "corpus", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("inserted_at"))


def _state(spark, sf):
    """Half of the labels have had a cycle after their first 30 vectors' minutes."""
    v = X.vectors(spark, sf).where(F.substring("corpus", 7, 9).cast("int") % 2 == 0)
    return v.groupBy("corpus").agg(F.timestamp_seconds(F.lit(1704067200) + F.min("doc_id") * 60 + 1800).alias("last_dream_at"), F.lit(30).cast("long").alias("last_doc_count"))


def new_docs_since(spark, sf):
    return R.new_since(_inserted(spark, sf), _state(spark, sf)).select("doc_id", "corpus")


def dream_gate(spark, sf):
    return R.dream_gate(_inserted(spark, sf), _state(spark, sf))


def prune_stale(spark, sf):
    docs = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority").startswith("1"), "explicit").when(F.col("o_orderpriority").startswith("2"), "action").otherwise("inference").alias("level"), F.to_date("o_orderdate").alias("created_at"))
    return R.stale(docs, X.doc_access(spark, sf), F.to_date(F.lit("1998-01-01"))).select("doc_id")


def doc_reassemble(spark, sf):
    """Conversations put together from their turns."""
    rows = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), F.col("text").alias("body"))
    return R.reassemble(rows).select("doc_id", F.md5(F.encode("body", "UTF-8")).alias("digest"))


def rag_list(spark, sf):
    return R.list_documents(X.docs(spark, sf), "lang:en")


def upsert_documents(spark, sf):
    """Documents written again under their source's ids."""
    docs = X.docs(spark, sf)
    fresh = docs.withColumn("doc_id", F.expr("doc_id div 2"))
    rows = R.upsert_documents(docs, fresh)
    return rows.select("doc_id", F.md5(F.encode("body", "UTF-8")).alias("digest"))


def text_chunks(spark, sf):
    return C.chunk_text(X.docs(spark, sf)).select("doc_id", "chunk_no", F.md5(F.encode("body", "UTF-8")).alias("digest"), F.length("body").cast("long").alias("chars"))


def markdown_docs(spark, sf):
    """Documents as Markdown: a title, a section of text, code, a list and a table of their own words."""
    body = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n## Text\n\n"), "body", F.lit("\n\n## Parts\n\n```\n# no heading\n\n"), F.substring("body", 1, 300), F.lit("\n```\n\n- one\n\n  more\n- two\n\n| a | b |\n|-|-|\n| 1 | 2 |\n"))
    return X.docs(spark, sf).select("doc_id", body.alias("body"))


def markdown_chunks(spark, sf):
    """Chunks of every document as Markdown, of 64 tokens or one whole block."""
    import public_tokenizers

    rows = chunk_markdown(markdown_docs(spark, sf), 64, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "chunk_no", "path", "first", "last", "tokens", F.md5(F.encode("body", "UTF-8")).alias("digest"))


def code_symbols(spark, sf):
    """Every document's terms as the names of a Python file's classes, each with two functions."""
    line = lambda t, i: F.when(i % 3 == 0, F.concat(F.lit("class "), t, F.lit(":"))).otherwise(F.concat(F.lit("    def "), t, F.lit("(self):")))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".py"))
    files = fence(X.docs(spark, sf).select(path.alias("path"), "body"), t=T.terms("body")).select("path", F.array_join(F.transform("t", line), "\n").alias("body"))
    return C.symbol_chunks(files).select("path", "line_no", "end_line", "header")


def semantic_chunks(spark, sf):
    """Conversations as sentences, cut where one shares little with the three before it, and at 2048 characters."""
    rows = read_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(C.sentences("text")).alias("pos", "body"))
    rows = fence(rows, tokens=T.terms("body"))
    rows = fence(rows, vec=X.term_vector(F.col("tokens")))
    return C.semantic_chunks(rows.select("doc_id", "pos", "body", "vec"), 0.1).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.encode("body", "UTF-8")).alias("digest"))


def stemmed_terms(spark, sf):
    rows = X.docs(spark, sf).select(F.explode(stems(T.terms("body"))).alias("stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"))


def tumbling_windows(spark, sf):
    return S.tumbling(_events(spark, sf)).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_windows(spark, sf):
    return S.sliding(_events(spark, sf)).select(F.unix_seconds("start").alias("start"), "event_type", "n")


def session_windows(spark, sf):
    return S.sessions(_events(spark, sf)).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def circuit_breaker(spark, sf):
    """Each user's events as calls that fail unless they are purchases or views, and what each call met."""
    calls = _events(spark, sf).select(F.col("user_id").cast("string").alias("service"), F.col("ts").alias("at"), F.col("event_type").isin("purchase", "view").alias("ok"))
    return S.breaker(calls, streaming=False).select("service", F.unix_micros("at").alias("at"), "ok", "met")


def period_rollup(spark, sf):
    """Orders by year, quarter and month with their sums."""
    day = F.to_date("o_orderdate")
    rows = read_table(spark, sf, "orders").select(F.date_format(day, "yyyy").alias("year"), F.quarter(day).cast("long").alias("quarter"), F.date_format(day, "MM").alias("month"))
    return rows.rollup("year", "quarter", "month").agg(F.count("*").alias("n"))


START = "epoch(make_timestamp(2024, 1, 1, 0, 0, 0))"
INS = """ins AS (SELECT vec_id AS doc_id, 'label:' || label AS corpus, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS inserted_at FROM embeddings),
state AS (SELECT 'label:' || label AS corpus, TIMESTAMP '2024-01-01' + to_minutes(min(vec_id) + 30) AS last_dream_at, 30 AS last_doc_count FROM embeddings
WHERE label % 2 = 0 GROUP BY label)"""

QUERIES = {
    "scratch_latest": (scratch_latest, """SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC,
event_id DESC) AS n FROM events) WHERE n = 1"""),
    "task_list": (task_list, """SELECT user_id AS task_id, event_type AS title, 'done' AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
FROM events) WHERE n = 1 AND event_type = 'purchase'"""),
    "history_list": (history_list, f"WITH {X.HISTORY} SELECT agent_id, id, role, place FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY id DESC) AS place FROM history) WHERE place <= 20"),
    "history_search": (history_search, f"""WITH {X.HISTORY} SELECT agent_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY id DESC) AS place FROM history
WHERE contains(lower(content), 'the')) WHERE place <= 20"""),
    "access_counts": (
        access_counts,
        """WITH e AS (SELECT event_id % 500 AS doc_id, CAST(user_id % 4 AS VARCHAR) AS agent_id, ts FROM events) SELECT doc_id, agent_id, 0::BIGINT AS level,
count(*) AS access_count, epoch_us(max(ts)) AS last_accessed FROM e GROUP BY doc_id, agent_id UNION ALL SELECT doc_id, NULL, 1::BIGINT, count(*),
epoch_us(max(ts)) FROM e GROUP BY doc_id""",
    ),
    "new_docs_since": (new_docs_since, f"WITH {INS} SELECT doc_id, corpus FROM ins LEFT JOIN state USING (corpus) WHERE last_dream_at IS NULL OR inserted_at > last_dream_at"),
    "dream_gate": (dream_gate, f"""WITH {INS}, c AS (SELECT corpus, count(*) AS docs FROM ins GROUP BY corpus) SELECT corpus, docs, CAST(coalesce(last_doc_count, 0) AS BIGINT) AS last_doc_count,
docs >= 20 AND docs - coalesce(last_doc_count, 0) >= 20 AS due FROM c LEFT JOIN state USING (corpus)"""),
    "prune_stale": (prune_stale, f"""WITH {X.ACCESS} SELECT o_orderkey AS doc_id FROM orders
WHERE left(o_orderpriority, 1) IN ('1', '2') AND DATE '1998-01-01' - CAST(o_orderdate AS DATE) >= 90 AND o_orderkey NOT IN (SELECT doc_id FROM doc_access)"""),
    "doc_reassemble": (doc_reassemble, "SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id"),
    "rag_list": (rag_list, "SELECT doc_id, source AS source_id, length(text) AS chars FROM documents WHERE lang = 'en'"),
    "upsert_documents": (upsert_documents, """WITH f AS (SELECT doc_id // 2 AS doc_id, max(text) AS body FROM documents GROUP BY 1) SELECT doc_id, md5(body) AS digest FROM f UNION ALL SELECT doc_id,
md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)"""),
    "text_chunks": (text_chunks, None),
    "markdown_chunks": (markdown_chunks, None),
    "code_symbols": (
        code_symbols,
        f"""WITH {X.DOCS}, t AS (SELECT doc_id, {X.sql_terms('body')} AS t FROM docs), r AS (SELECT doc_id, len(t) AS n, unnest(t) AS name, unnest(range(1, len(t) + 1)) AS line_no FROM t)
SELECT 'docs/' || doc_id || '.py' AS path, line_no, CASE WHEN line_no % 3 = 1 THEN least(line_no + 2,
n) ELSE line_no END AS end_line, '# ' || CASE WHEN line_no % 3 = 1 THEN 'class ' ELSE 'def ' END || name || ' (' || doc_id || '.py:' || line_no || ')' AS header
FROM r""",
    ),
    "semantic_chunks": (
        semantic_chunks,
        f"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') AS s FROM conversations),
s AS (SELECT doc_id, unnest(s) AS body, unnest(range(len(s))) AS pos FROM t),
v AS MATERIALIZED (SELECT doc_id, pos, body, {X.sql_term_vector(X.sql_terms('body'))} AS vec FROM s),
w AS (SELECT *, list(vec) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM v),
m AS (SELECT *, list_transform(range(1, 65), lambda i: coalesce(list_sum(list_transform(before, lambda b: b[i])), 0)) AS mean FROM w),
c AS (SELECT *, CASE WHEN pos > 0 AND coalesce(list_inner_product(vec, mean) / nullif(sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(mean, mean)), 0), 0) < 0.1 THEN 1 ELSE 0 END AS cut FROM m),
topics AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS topic FROM c),
parts AS (SELECT *, floor(coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id, topic ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2048) AS part FROM topics),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY topic, part) - 1 AS chunk_no FROM parts)
SELECT doc_id, chunk_no, md5(string_agg(body, ' ' ORDER BY pos)) AS digest FROM numbered GROUP BY doc_id, chunk_no""",
    ),
    "stemmed_terms": (stemmed_terms, None),
    "tumbling_windows": (tumbling_windows, "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "sliding_windows": (sliding_windows, """WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 43200) AS BIGINT) * 43200 AS h FROM events) SELECT unnest([h, h - 43200]) AS start, event_type,
count(*) AS n FROM e GROUP BY 1, 2"""),
    "session_windows": (
        session_windows,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *,
sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start,
epoch_us(max(ts)) + 21600000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    ),
    "circuit_breaker": (
        circuit_breaker,
        """WITH RECURSIVE calls AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS service, epoch_us(ts) AS moment, event_type IN ('purchase', 'view') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type IN ('purchase', 'view')) AS n FROM events),
r AS (SELECT DISTINCT service, 0::BIGINT AS n, 0 AS failures, NULL::BIGINT AS opened, NULL::BIGINT AS moment, NULL::BOOLEAN AS ok, NULL::VARCHAR AS met FROM calls
  UNION ALL SELECT service, n, CASE WHEN refused THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN refused THEN opened WHEN NOT ok AND (opened IS NOT NULL OR failures >= 2) THEN moment END, moment, ok,
    CASE WHEN refused THEN 'open' WHEN opened IS NOT NULL THEN 'half_open' ELSE 'closed' END
  FROM (SELECT c.service, c.n, c.moment, c.ok, r.failures, r.opened, coalesce(c.moment - r.opened < 60000000, false) AS refused FROM r JOIN calls c ON c.service = r.service AND c.n = r.n + 1))
SELECT service, moment AS "at", ok, met FROM r WHERE n > 0""",
    ),
    "period_rollup": (period_rollup, "SELECT strftime(o_orderdate, '%Y') AS year, quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%m') AS month, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2, 3)"),
}
