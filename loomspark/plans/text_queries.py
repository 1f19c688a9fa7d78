"""Catalogue: text, date and hash functions over whole tables."""

from __future__ import annotations

from ipaddress import ip_address, ip_network
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.plans import fixtures as X
from loomspark.session import fence, read_table


def tokenize_terms(spark, sf):
    rows = X.docs(spark, sf).select("doc_id", F.explode(T.terms("body")).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("documents"))


def content_hash_fnv1a(spark, sf):
    return X.docs(spark, sf).select("doc_id", T.fnv1a("body").alias("content_hash"))


def doc_id_sha16(spark, sf):
    return X.docs(spark, sf).select("doc_id", T.doc_id("body").alias("content_id"), T.doc_id("body", "dream-").alias("dream_id"))


def extract_l0(spark, sf):
    return X.docs(spark, sf).select("doc_id", T.lead("body").alias("l0"))


def dream_l0(spark, sf):
    return X.docs(spark, sf).select("doc_id", T.first_line("body").alias("l0"))


def binarize_embedding(spark, sf):
    rows = X.vectors(spark, sf).select(F.explode(T.sign_tokens("vec")).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def extract_dates(spark, sf):
    return X.dated(spark, sf).select("doc_id", F.explode(T.dates("body")).alias("day"))


def dates_to_periods(spark, sf):
    rows = fence(X.dated(spark, sf), days=T.dates("body"))
    return rows.select(F.explode(T.periods("days")).alias("period")).groupBy("period").agg(F.count("*").alias("n"))


def period_edges(spark, sf):
    """Edges from each dated document to its periods."""
    rows = fence(X.dated(spark, sf), days=T.dates("body"))
    return rows.select("doc_id", F.explode(T.periods("days")).alias("period"), F.lit("occurred_in").alias("edge_type"), F.lit(1.0).alias("weight"))


def temporal_proximity(spark, sf):
    """Every dated document against the quarter that the middle of its year begins."""
    rows = fence(X.dated(spark, sf), days=T.dates("body"))
    rows = fence(rows, ranges=T.query_ranges(F.concat(F.lit("orders in Q3 "), F.year(F.get("days", F.lit(0))).cast("string"))))
    return rows.select("doc_id", F.round(T.proximity("days", "ranges"), 6).alias("proximity"))


def query_periods(spark, sf):
    """Periods that each document's own text names when it is read as a query."""
    rows = fence(X.dated(spark, sf), ranges=T.query_ranges("body"))
    return rows.select("doc_id", F.explode(T.range_periods("ranges")).alias("period"))


#: Every way to exclude, and two that are none.
CUES = ("beside", "besides", "but not", "except", "EXCEPT  for", "excluding", "other than", "Without", "not about", "not including", "not related to", "not using", "not ", "isn't", "aren’t about", "wasn't related to", "weren't using")
NO_CUES = ("apart from", "not")


def negation_parse(spark, sf):
    """Every conversation turn as a query: its first half, a cue (each in turn), and the terms of its second."""
    rows = fence(read_table(spark, sf, "conversations"), t=T.terms("text"))
    cues = [*CUES, *NO_CUES]
    cue = F.element_at(F.array(*[F.lit(c) for c in cues]), (F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(cues))) + 1).cast("int"))
    half = F.expr("cast(size(t) div 2 as int)")
    q = F.concat(F.array_join(F.slice("t", F.lit(1), half), " "), F.lit(" "), cue, F.lit(" "), F.array_join(F.slice("t", half + 1, F.size("t")), ", "))
    rows = fence(rows.select("conv_id", "turn", q.alias("q")), n=T.negation("q"))
    return rows.select("conv_id", "turn", F.col("n.clean").alias("clean"), F.array_join("n.excluded", "|").alias("excluded"))


def negation_penalty(spark, sf):
    """Every document against three excluded terms that are common in its languages."""
    excluded = F.array(F.lit("the"), F.lit("tion"), F.lit("que"))
    return X.docs(spark, sf).select("doc_id", F.round(T.negation_penalty("body", excluded), 6).alias("penalty"))


#: What follows a turn's first word: specific terms, some of them with parts that end in no border.
TAILS = ("", " Redis-Kx_ here", " Abc-def_ and Redis-Kx_ do", " aBc Ab Redis-2-", " Xyz_ Éabc Okta")


def should_expand(spark, sf):
    """Every turn, and its first word with terms that do or don't count as specific."""
    made = F.array("text", *[F.concat(F.substring_index("text", " ", 1), F.lit(t)) for t in TAILS])
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(made).alias("form", "q"))
    return rows.select("conv_id", "turn", F.col("form").cast("long").alias("form"), T.should_expand("q").alias("expand"))


def clean_base64(spark, sf):
    html = F.concat("html", F.lit(" ![x](data:image/png;base64,iVBORw0KGgo=) data:image/gif;base64,R0lGODlh "))
    return read_table(spark, sf, "pages").select("page_id", F.md5(F.encode(T.without_images(html), "UTF-8")).alias("digest"), F.length(T.without_images(html)).cast("long").alias("length"))


#: Hosts whose addresses follow from no page: all kinds of IPv6 addresses and names.
HOSTS = ("[::1]", "[::]:8080", "[fd00::7]", "[fe80::7]", "[2001:db8::1]", "[2001:0db8:0000::1]", "[2001:4860:4860::8888]", "[2001:3::1]", "[64:ff9b:1::1]", "[ff02::1]", "[::ffff:10.0.0.1]", "[::ffff:a00:1]", "[::ffff:8.8.8.8]", "me@0.0.0.7", "localhost:7", "metadata.google.internal", "10.example.org", "127.0.0.1.example.org")
#: First and last addresses of networks, whose neighbours lie outside.
EDGES_V4 = tuple(str(a) for n in map(ip_network, (*T.LOCAL_V4, *T.PUBLIC_V4, "100.64.0.0/10", "224.0.0.0/4")) for a in (max(int(n[0]) - 1, 0), int(n[0]), int(n[-1]), min(int(n[-1]) + 1, (1 << 32) - 1)))


def _known(host: str) -> bool:
    """What the standard library says of a host."""
    name = urlsplit(f"http://{host}").hostname or ""
    try:
        address = ip_address(name)
    except ValueError:
        return name in T.LOCAL_NAMES
    return address.is_private or address.is_loopback or address.is_link_local


def blocked_url(spark, sf):
    """Every page's address, addresses at the ends of networks moved by nothing, and one drawn from the page's number."""
    dotted = lambda n: F.concat_ws(".", *[F.expr(f"cast(shiftright({n}, {s}) & 255 as string)") for s in (24, 16, 8, 0)])
    pages = read_table(spark, sf, "pages").withColumn("drawn", F.expr("page_id * 2654435761 % 4294967296"))
    fixed = [F.lit(f"http://{host}/x") for host in (*HOSTS, *[str(ip_address(int(a))) for a in EDGES_V4])]
    rows = pages.select("page_id", F.explode(F.array("url", F.concat(F.lit("http://u@"), dotted("drawn"), F.lit(":80?q")), *fixed)).alias("url"))
    return rows.select("page_id", "url", T.blocked_url("url").alias("blocked"))


def doc_language(spark, sf):
    """Programming language by the extension of each page's path."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".RS", ".tsx", ".md", ".h", "")]), (F.col("page_id") % 6 + 1).cast("int"))
    return read_table(spark, sf, "pages").select("page_id", T.language_of(F.concat("url", F.lit("/file"), ext)).alias("language"))


Q3 = "[{'s': make_date(year(days[1]), 7, 1), 'e': make_date(year(days[1]), 9, 30)}]"
PERIODS = "list_distinct(flatten(list_transform(days, lambda d: ['month:' || strftime(d, '%Y-%m'), 'quarter:' || strftime(d, '%Y') || '-Q' || quarter(d), 'year:' || strftime(d, '%Y')])))"
DATA = "data:image/[^;]+;base64,[A-Za-z0-9+/=]+"
V4_RANGES = lambda nets: ", ".join(f"({int(n[0])}, {int(n[-1])})" for n in map(ip_network, nets))
KNOWN = ", ".join(f"('http://{h}/x', {_known(h)})" for h in (*HOSTS, *[str(ip_address(int(a))) for a in EDGES_V4]))

QUERIES = {
    "tokenize_terms": (tokenize_terms, f"""WITH {X.DOCS}, t AS (SELECT doc_id, unnest({X.sql_terms('body')}) AS term FROM docs) SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
FROM t GROUP BY term"""),
    "content_hash_fnv1a": (
        content_hash_fnv1a,
        """WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS HUGEINT)) AS bytes FROM documents)
SELECT doc_id, CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS VARCHAR) AS content_hash FROM b""",
    ),
    "doc_id_sha16": (doc_id_sha16, "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id, 'dream-' || substr(sha256(text), 1, 16) AS dream_id FROM documents"),
    "extract_l0": (
        extract_l0,
        """WITH w AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), f AS (SELECT *, regexp_extract(t, '^[^.!?]*[.!?]') AS s FROM w)
SELECT doc_id, CASE WHEN length(s) > 0 AND length(s) <= 200 THEN s WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, 200), '\\s+\\S*$', '') || '…' END AS l0 FROM f""",
    ),
    "dream_l0": (dream_l0, "WITH w AS (SELECT doc_id, split_part(trim(text, ' '), chr(10), 1) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END AS l0 FROM w"),
    "binarize_embedding": (binarize_embedding, """WITH t AS (SELECT unnest(list_transform(embedding, lambda v, i: CASE WHEN v > 0 THEN 'embedding_one_' ELSE 'embedding_zero_' END || (i - 1))) AS token
FROM embeddings) SELECT token, count(*) AS n FROM t GROUP BY token"""),
    "extract_dates": (extract_dates, f"WITH {X.DATES} SELECT doc_id, unnest(days) AS day FROM dates"),
    "dates_to_periods": (dates_to_periods, f"WITH {X.DATES}, p AS (SELECT unnest({PERIODS}) AS period FROM dates) SELECT period, count(*) AS n FROM p GROUP BY period"),
    "period_edges": (period_edges, f"WITH {X.DATES} SELECT doc_id, unnest({PERIODS}) AS period, 'occurred_in' AS edge_type, CAST(1.0 AS DOUBLE) AS weight FROM dates"),
    "temporal_proximity": (
        temporal_proximity,
        f"""WITH {X.DATES}, s AS (SELECT doc_id, unnest(days) AS d, make_date(year(days[1]), 7, 1) AS a, make_date(year(days[1]), 9, 30) AS b FROM dates) SELECT doc_id,
round(max(exp(-pow(greatest(0, a - d, d - b), 2) / 450)), 6) AS proximity FROM s GROUP BY doc_id""",
    ),
    "query_periods": (
        query_periods,
        f"""WITH {X.DATED}, r AS (SELECT doc_id, {X.SQL_ISO} AS iso, {X.SQL_MONTH} AS mon FROM dated), d AS (SELECT doc_id, unnest(list_concat(iso, mon)) AS day FROM r)
SELECT DISTINCT doc_id, unnest(['month:' || strftime(day, '%Y-%m'), 'quarter:' || strftime(day, '%Y') || '-Q' || quarter(day)]) AS period FROM d""",
    ),
    "negation_parse": (
        negation_parse,
        f"""WITH t AS (SELECT conv_id, turn, {X.sql_terms('text')} AS t FROM conversations), h AS (SELECT *, t[1:len(t) // 2] AS a, t[len(t) // 2 + 1:] AS b,
([{", ".join("'" + c.replace("'", "''") + "'" for c in (*CUES, *NO_CUES))}])[(conv_id * 5 + turn) % {len(CUES) + len(NO_CUES)} + 1] AS cue, (conv_id * 5 + turn) % {len(CUES) + len(NO_CUES)} < {len(CUES)} AS real FROM t),
q AS (SELECT *, array_to_string(a, ' ') || ' ' || cue || ' ' || array_to_string(b, ', ') AS q FROM h)
SELECT conv_id, turn, CASE WHEN real AND len(a) > 0 AND len(b) > 0 THEN array_to_string(a, ' ') ELSE q END AS clean, CASE WHEN real THEN array_to_string(b, '|') ELSE '' END AS excluded FROM q""",
    ),
    "negation_penalty": (negation_penalty, """SELECT doc_id,
round(pow(0.1, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'que') AS INTEGER)), 6) AS penalty
FROM documents"""),
    "should_expand": (
        should_expand,
        f"""WITH f AS (SELECT conv_id, turn, text, split_part(text, ' ', 1) AS w FROM conversations),
q AS (SELECT conv_id, turn, 0 AS form, text AS q FROM f UNION ALL SELECT conv_id, turn, i, w || t FROM f, (VALUES {", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(TAILS))}) v(i, t)),
t AS (SELECT *, regexp_replace(q, '([^\\p{{L}}\\p{{N}}_-])', '\\1\\1', 'g') AS spaced FROM q)
SELECT conv_id, turn, form::BIGINT AS form, len(list_filter(regexp_split_to_array(q, '\\s+'),
lambda w: w <> '')) <= 2 OR len(regexp_extract_all(spaced, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z][A-Za-z0-9]{{2,}}(-[A-Za-z0-9]+)*($|[^\\p{{L}}\\p{{N}}_])')) < 2 AS expand FROM t""",
    ),
    "clean_base64": (
        clean_base64,
        f"""WITH h AS (SELECT page_id, html || ' ![x](data:image/png;base64,iVBORw0KGgo=) data:image/gif;base64,R0lGODlh ' AS h FROM pages), c AS (SELECT page_id,
regexp_replace(regexp_replace(h, '\\({DATA}\\)', '[IMG]', 'g'), '{DATA}', '[IMG]', 'g') AS t FROM h) SELECT page_id, md5(t) AS digest, length(t) AS length
FROM c""",
    ),
    "blocked_url": (
        blocked_url,
        f"""WITH d AS (SELECT page_id, page_id * 2654435761 % 4294967296 AS n FROM pages), dotted AS (SELECT *, (n >> 24) || '.' || (n >> 16 & 255) || '.' || (n >> 8 & 255) || '.' || (n & 255) AS a FROM d)
SELECT page_id, url, false AS blocked FROM pages
UNION ALL SELECT page_id, 'http://u@' || a || ':80?q', EXISTS (SELECT 1 FROM (VALUES {V4_RANGES(T.LOCAL_V4)}) r(low, high) WHERE n BETWEEN low AND high)
  AND NOT EXISTS (SELECT 1 FROM (VALUES {V4_RANGES(T.PUBLIC_V4)}) r(low, high) WHERE n BETWEEN low AND high) FROM dotted
UNION ALL SELECT page_id, u, known FROM pages, (VALUES {KNOWN}) v(u, known)""",
    ),
    "doc_language": (doc_language, "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'tsx' WHEN 4 THEN 'c' END AS language FROM pages"),
}
