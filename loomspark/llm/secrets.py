"""Secret scan with multipart credential linking, in DataFrame functions only.

Base findings are pattern matches (assign, access, hex). Weak candidates (login names, opaque 40-character strings,
endpoints) are reported only when the parts that complete a credential start within `scope` code points of them; the
parts meet in an interval join on (document, bucket of `scope` code points).

Defined results: a null text counts as empty; a null doc_id is kept as a key of its own; repeated rows each get
their row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import fence, materialize

SCOPE = 300
BLOCK = 256


def either_case(word: str) -> str:
    """ASCII letters of a pattern in either case, spelled out so that every engine reads it alike."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LOGIN = f"({'|'.join(map(either_case, ('username', 'user', 'login', 'client_?id', 'account_?id')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)"
OPAQUE = "[A-Za-z0-9+/]+"
#: Host names are at most 253 characters long; a bounded class, unlike a repeated group, needs no stack in the JVM.
ENDPOINT = "https?://[A-Za-z0-9.-]+(:[0-9]+)?|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(:[0-9]+)?|[a-z0-9-][a-z0-9.-]{0,252}[.]amazonaws[.]com"
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
SPAN = "array<struct<start:int,ord:int,end:int>>"


def _spans(text: str, pattern: str, ord_: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches: gaps come from split(), lengths from the matches themselves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if ord_ in (0, 3) else found
    gaps = F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(found.alias("m"), inner.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), keep(x["m"], x["v"]).alias("ok")),
    )
    # Spans are gathered in blocks of BLOCK, so that a text with very many is not copied again for each.
    empty = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"), empty.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(ord_).alias("ord"), (start + x["n"]).alias("end")))
        full = x["ok"] & (F.size(acc["open"]) >= BLOCK)
        blocks = F.when(full, F.concat(acc["blocks"], F.array(acc["open"]))).otherwise(acc["blocks"])
        open_ = F.when(full, one).when(x["ok"], F.concat(acc["open"], one)).otherwise(acc["open"])
        return F.struct((start + x["n"]).alias("at"), blocks.alias("blocks"), open_.alias("open"))

    found = F.aggregate(parts, zero, step, lambda a: F.flatten(F.concat(a["blocks"], F.array(a["open"]))))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def _rendered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, weak) per row of docs; weak candidates only where the document can complete them."""
    none = F.array().cast(SPAN)
    at_least = lambda n: lambda m, v: F.length(v) >= n
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = fence(
        rows,
        assign=_spans("text", ASSIGN, 0, at_least(8)),
        access=_spans("text", "AKIA[A-Z0-9]{12,}", 1, at_least(16)),
        hex=_spans("text", "[0-9a-f]{32,}", 2, at_least(32)),
    )
    has_access = F.size("access") > 0
    mixed = lambda m, v: (F.length(m) == 40) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    rows = fence(rows, base=F.array_sort(F.concat("assign", "access", "hex")), opaque_all=F.when(has_access, _spans("text", OPAQUE, 4, mixed)).otherwise(none))
    free = F.filter("opaque_all", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    rows = fence(rows, opaque=free)
    has_secret = F.size("assign") + F.size("hex") + F.size("opaque") > 0
    login = F.when(has_secret, _spans("text", LOGIN, 3, lambda m, v: F.length(v) >= 3)).otherwise(none)
    endpoint = F.when(has_secret & has_access, _spans("text", ENDPOINT, 5, lambda m, v: F.lit(True))).otherwise(none)
    return rows.select("doc_id", "text_hash", "base", F.concat("opaque", login, endpoint).alias("weak"))


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates of each (doc_id, text_hash) that complementary parts within `scope` complete.

    opaque needs an access id; login needs a secret (assign, hex, opaque); endpoint needs an access id and a secret.
    """
    parts = scanned.where(F.size("weak") > 0).select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("p"))
    parts = parts.select("doc_id", "text_hash", "p.*").withColumn("bucket", F.floor(F.col("start") / scope)).distinct()
    weak = parts.where(F.col("ord") >= 3).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    other = parts.select(F.col("doc_id").alias("o_doc"), F.col("text_hash").alias("o_hash"), F.col("bucket").alias("o_bucket"), F.col("start").alias("o_start"), F.col("ord").alias("o_ord")).where(F.col("o_ord").isin(0, 1, 2, 4))
    met = weak.join(
        other,
        weak["doc_id"].eqNullSafe(other["o_doc"]) & (weak["text_hash"] == other["o_hash"]) & (weak["bucket"] == other["o_bucket"]) & (F.abs(weak["start"] - other["o_start"]) <= scope),
    )
    flags = met.groupBy("doc_id", "text_hash", "start", "ord", "end").agg(F.bool_or(F.col("o_ord") == 1).alias("access"), F.bool_or(F.col("o_ord") != 1).alias("secret"))
    whole = flags.where(((F.col("ord") == 4) & F.col("access")) | ((F.col("ord") == 3) & F.col("secret")) | ((F.col("ord") == 5) & F.col("access") & F.col("secret")))
    return whole.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "ord", "end")).alias("linked"))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, base, linked): spans as struct(start, ord, end), ord indexing KINDS; one row per row of docs."""
    scanned = materialize(scan(docs), "secrets")
    linked = link(scanned, scope).select(F.col("doc_id").alias("l_doc"), F.col("text_hash").alias("l_hash"), "linked")
    rows = scanned.join(linked, scanned["doc_id"].eqNullSafe(linked["l_doc"]) & (scanned["text_hash"] == linked["l_hash"]), "left")
    return rows.select("doc_id", "text_hash", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"),
        _rendered(F.concat("base", "linked")).alias("spans"),
    )


def _sql_spans(pattern: str, ord_: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    group = 2 if ord_ in (0, 3) else 0
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(text, '{p}')) + 1), lambda i: {{
        'start': CAST(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i - 1], lambda g: length(g))), 0) AS BIGINT),
        'ord': {ord_}, 'n': CAST(length(regexp_extract_all(text, '{p}')[i]) AS BIGINT), 'm': regexp_extract_all(text, '{p}')[i], 'v': regexp_extract_all(text, '{p}', {group})[i]}}), lambda x: {keep})"""


OP2_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT rid, unnest(list_concat({_sql_spans(ASSIGN, 0, "length(x.v) >= 8")}, {_sql_spans(ACCESS, 1, "length(x.m) >= 16")}, {_sql_spans("[0-9a-f]{32,}", 2, "true")})) AS s FROM t),
base AS (SELECT rid, s.start AS st, s.ord AS ord, s.start + s.n AS en FROM p),
w AS (
  SELECT rid, unnest(list_concat({_sql_spans(LOGIN, 3, "length(x.v) >= 3")}, {_sql_spans("[A-Za-z0-9+/]{40,}", 4, "length(x.m) = 40 AND regexp_matches(x.m, '[A-Z]') AND regexp_matches(x.m, '[a-z]') AND regexp_matches(x.m, '[0-9]')")}, {_sql_spans(ENDPOINT, 5, "true")})) AS s
  FROM t WHERE rid IN (SELECT rid FROM base)),
weak AS (
  SELECT rid, s.start AS st, s.ord AS ord, s.start + s.n AS en FROM w
  WHERE s.ord <> 4 OR NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.st < w.s.start + w.s.n AND w.s.start < b.en)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak WHERE ord = 4 AND rid IN (SELECT rid FROM base WHERE ord = 1)),
linked AS (
  SELECT a.rid, a.st, a.ord, a.en FROM weak a JOIN parts o ON a.rid = o.rid AND abs(a.st - o.st) <= {SCOPE}
  GROUP BY ALL
  HAVING (a.ord = 4 AND bool_or(o.ord = 1)) OR (a.ord = 3 AND bool_or(o.ord <> 1)) OR (a.ord = 5 AND bool_or(o.ord = 1) AND bool_or(o.ord <> 1))),
named AS (SELECT *, ['assign', 'access', 'hex', 'login', 'opaque', 'endpoint'][ord + 1] || ':' || st || ':' || en AS r FROM (SELECT * FROM base UNION ALL SELECT * FROM linked))
SELECT t.doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  sha256(coalesce(string_agg(r, ',' ORDER BY st, ord) FILTER (ord < 3), '')) AS base_sha256, coalesce(string_agg(r, ',' ORDER BY st, ord), '') AS spans
FROM t LEFT JOIN named USING (rid) GROUP BY t.rid, t.doc_id
"""
