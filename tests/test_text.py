import datetime as dt
import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.chunking import chunk_files, chunk_text, outline, semantic_chunks, split_text, symbol_chunks, token_measure
from loomspark.functions.stemming import stem


def value(spark, text, make, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(make("t").alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [("due 2024-02-30 or 2024-02-29", [dt.date(2024, 2, 29)]), ("in march 2025, May 2024", [dt.date(2024, 5, 15), dt.date(2025, 3, 15)]), ("", []), ("x2024-01-01", [])])
def test_dates(spark, text, expected):
    assert value(spark, text, T.dates) == expected


def test_periods_and_ranges(spark):
    assert value(spark, "Q1 2024", lambda c: T.range_periods(T.query_ranges(c))) == ["month:2024-01", "month:2024-02", "month:2024-03", "quarter:2024-Q1"]
    assert value(spark, "2024-05-06", lambda c: T.range_periods(T.query_ranges(c))) == ["month:2024-05", "quarter:2024-Q2"]


@pytest.mark.parametrize(
    "text, clean, excluded",
    [("auth changes besides OAuth and SSO", "auth changes", ["oauth", "sso"]), ("excluding tests, docs", "excluding tests, docs", ["tests", "docs"]), ("plain words", "plain words", []), ("storage but not S3 or GCS", "storage", ["s3", "gcs"])],
)
def test_negation(spark, text, clean, excluded):
    got = value(spark, text, T.negation)
    assert (got["clean"], got["excluded"]) == (clean, excluded)


@pytest.mark.parametrize("cue", ["beside", "besides", "except", "except  for", "isn't", "weren’t about", "not related to", "NOT using", "without", "not including", "not "])
def test_cues(spark, cue):
    assert value(spark, f"big caches {cue} tests, docs", T.negation)["excluded"] == ["tests", "docs"]


def test_words_that_only_look_like_cues(spark):
    for text in ("not now", "exceptional speed wins", "withoutx y", "all apart from Redis", "leaving out x"):
        assert value(spark, text, T.negation)["excluded"] == []


def test_specific_terms_of_any_length(spark):
    assert value(spark, "Abc" + "-x" * 50_000 + " Def stays here", T.should_expand) is False
    assert value(spark, "what does Abc-def_ and Redis-Kx_ do here", T.should_expand) is False
    assert value(spark, "what does Abc_ and Redis do here", T.should_expand) is True


def test_penalty_and_expansion(spark):
    assert value(spark, "uses OAuth and sso", lambda c: T.negation_penalty(c, F.array(F.lit("oauth"), F.lit("sso"), F.lit("x")))) == pytest.approx(0.01)
    assert value(spark, "two words", T.should_expand) is True
    assert value(spark, "how does Redis talk to Okta", T.should_expand) is False


@pytest.mark.parametrize("text, lead", [("One. Two.", "One."), ("no stop", "no stop"), ("a" * 100 + " " + "b" * 150, "a" * 100 + "…"), ("  x! y", "x!")])
def test_lead(spark, text, lead):
    assert value(spark, text, T.lead) == lead


def test_fnv1a(spark):
    assert value(spark, "abc", T.fnv1a) == "16654208175385433931"
    assert value(spark, "", T.fnv1a) == "14695981039346656037"
    assert value(spark, None, T.fnv1a) is None


def test_decay(spark):
    row = spark.sql("select timestamp'2024-01-11 00:00:00' as now, timestamp'2024-01-01 00:00:00' as last, cast(null as timestamp) as none")
    got = row.select(T.usage_decay(F.lit(5), F.col("last"), F.col("now")).alias("a"), T.usage_decay(F.lit(None), F.col("none"), F.col("now")).alias("b")).first()
    assert got["a"] == pytest.approx((1 - 0.5 * 10 / 365) * 1.1)
    assert got["b"] == pytest.approx(0.5)


def test_blocked(spark):
    """Addresses in and around every network, and drawn ones, as the standard library sees them; names and malformed hosts."""
    rng, want = random.Random(4), {}
    for network in map(ipaddress.ip_network, (*T.LOCAL_V4, *T.PUBLIC_V4, *T.LOCAL_V6, *T.PUBLIC_V6, T.MAPPED, "100.64.0.0/10", "224.0.0.0/4", "ff00::/8")):
        for number in (int(network[0]) - 1, int(network[0]), int(network[-1]), int(network[-1]) + 1, rng.randint(int(network[0]), int(network[-1])), rng.getrandbits(network.max_prefixlen)):
            if not 0 <= number < 1 << network.max_prefixlen:
                continue
            address = type(network[0])(number)
            local = address.is_private or address.is_loopback or address.is_link_local
            for host in (str(address),) if network.version == 4 else (f"[{address}]", f"[{address.exploded}]:80"):
                want[f"http://{host}/x"] = want[f"https://u:p@{host}?q"] = local
    for host, local in (("localhost", True), ("LOCALHOST:80", True), ("localhost.", True), ("example.org", False), ("10.example.org", False), ("1.2.3", False), ("256.1.1.1", False), ("10.0.0.1@8.8.8.8", False), ("8.8.8.8@10.0.0.1", True), ("[::1", True), ("[1::2::3]", True), ("[fe80::1%eth0]", True)):
        want[f"http://{host}/"] = local
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", T.blocked_url("u").alias("b")).collect()
    assert {r["u"]: r["b"] for r in got} == want
    assert value(spark, None, T.blocked_url) is None


def test_blocked_reads_an_address_once(spark):
    """The expression names the address a bounded number of times: it was over a thousand."""
    plan = spark.createDataFrame([("http://[::1]/",)], "u string").select(T.blocked_url("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(u") <= 2 and len(plan) < 60_000


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("generalizations", "gener"), ("adjustment", "adjust"), ("controlling", "control"), ("filing", "file")])
def test_stem(word, want):
    assert stem(word) == want


def test_split_text():
    text = "First part. Second one.\n\nThird paragraph here."
    assert split_text(text, 30) == ["First part. Second one.", "Third paragraph here."]
    assert split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert split_text("", 10) == split_text("  \n", 10) == []
    assert split_text("# A\nbody\n## B\nmore", 100, headings=True) == ["# A\nbody", "## B\nmore"]


def test_split_by_tokens():
    text = "One two three. Four five six seven.\n\nEight nine. " * 20
    words = lambda t: len(t.split())
    parts = split_text(text, 7, measure=words)
    assert max(map(words, parts)) <= 7 and " ".join(parts).split() == text.split() and parts[0] == "One two three. Four five six seven."
    import public_tokenizers

    measure = token_measure(public_tokenizers.path("byte_bpe_50k.json"))
    parts = split_text(text, 16, measure=measure)
    assert max(map(measure, parts)) <= 16 and " ".join(parts).split() == text.split()


def test_chunks_keep_all_text(spark):
    docs = spark.createDataFrame([(1, "word " * 1000), (2, None), (3, "")], "doc_id long, body string")
    got = chunk_text(docs, 64).collect()
    assert {r["doc_id"] for r in got} == {1}
    assert sum(r["body"].count("word") for r in got) == 1000 and max(len(r["body"]) for r in got) <= 64


def test_symbols(spark):
    code = "import x\nclass A:\n    def f(self):\n        pass\n\ndef g():\n    return 1"
    files = spark.createDataFrame([("src/a.py", code), ("b.txt", "def no(): pass")], "path string, body string")
    got = [(r["line_no"], r["end_line"], r["header"]) for r in symbol_chunks(files).orderBy("line_no").collect()]
    assert got == [(2, 5, "# class A (a.py:2)"), (3, 5, "# def f (a.py:3)"), (6, 7, "# def g (a.py:6)")]


def test_symbols_stay_in_their_file(spark):
    code = "class A:\n    def f():\n        class B:\n            x\n        def g():\n            y\n    z\n\tdef t():\ndef h():\n    w"
    files = spark.createDataFrame([("a.py", code), ("b.py", "x = 1"), ("c.py", None)], "path string, body string")
    chunks = symbol_chunks(files)
    got = [(r["line_no"], r["end_line"], r["body"].count("\n")) for r in chunks.orderBy("line_no").collect()]
    assert got == [(1, 8, 7), (2, 7, 5), (3, 4, 1), (5, 7, 2), (8, 8, 0), (9, 10, 1)]
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()  # no line is shuffled or joined with its file's text


SOURCES = {
    "m.rs": ["pub(crate) async fn run(x: u8) {", "impl<T> Store for Disk {", "    let fn_ = 1;", "struct Point;", "macro_rules! hash {"],
    "m.ts": ["export default class App {", "export const go = async (x) => {", "function plain() {", "interface Shape {", "const n = 5;", "let f = x => x"],
    "m.go": ["func (s *Store) Get(k string) string {", "type Store struct {", "type Reader interface {", "type Name string", "var x = 1"],
    "m.java": ["public static void main(String[] args) {", "  return go(1);", "public final class A {", "protected List<String> names() {", "    call(x);"],
    "m.cpp": ["namespace net {", "static inline int add(int a, int b) {", "int declared(int a);", "else if (x) {", "class Socket : Base {"],
    "m.rb": ["module Net", "  def self.open(x)", "class Conn", "x = 1"],
}
FOUND = {
    "m.rs": [("fn", "run"), ("impl", "Store for Disk"), ("struct", "Point"), ("macro_rules", "hash")],
    "m.ts": [("class", "App"), ("fn", "go"), ("fn", "plain"), ("interface", "Shape"), ("fn", "f")],
    "m.go": [("fn", "Get"), ("struct", "Store"), ("interface", "Reader"), ("type", "Name")],
    "m.java": [("method", "main"), ("class", "A"), ("method", "names")],
    "m.cpp": [("namespace", "net"), ("fn", "add"), ("class", "Socket")],
    "m.rb": [("module", "Net"), ("def", "open"), ("class", "Conn")],
}


def test_outlines_of_all_languages(spark):
    files = spark.createDataFrame([(p, "\n".join(lines)) for p, lines in SOURCES.items()], "path string, body string")
    got = {}
    for r in outline(files).orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append((r["kind"], r["name"]))
    assert got == FOUND


def test_semantic_chunks(spark):
    rows = [(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [1.0, 0.1]), (1, 2, "c", [0.0, 1.0])]
    got = semantic_chunks(spark.createDataFrame(rows, "doc_id long, pos int, body string, vec array<double>")).orderBy("chunk_no").collect()
    assert [r["body"] for r in got] == ["a b", "c"]
    long = [(1, i, "word" * 5, [1.0, 0.0]) for i in range(10)] + [(1, 10, "end", [0.0, 1.0])]
    got = semantic_chunks(spark.createDataFrame(long, "doc_id long, pos int, body string, vec array<double>"), size=63).orderBy("chunk_no").collect()
    assert [len(r["body"].split()) for r in got] == [3, 3, 3, 1, 1] and got[-1]["body"] == "end"
    slow = [(1, i, str(i), [np.cos(i / 2), np.sin(i / 2)]) for i in range(4)]  # each is near the one before, the last far from the mean
    got = semantic_chunks(spark.createDataFrame([(a, b, c, [float(x) for x in v]) for a, b, c, v in slow], "doc_id long, pos int, body string, vec array<double>"), 0.6).orderBy("chunk_no").collect()
    assert [r["body"] for r in got] == ["0 1 2", "3"]


def test_files_are_chunked_by_kind(spark):
    files = [("a.py", "def f():\n    pass\n\ndef g():\n    pass"), ("b.py", "x = 1\n" * 15), ("c.md", "# A\none\n# B\ntwo"), ("d.txt", "just text"), ("e.txt", None)]
    got = {}
    for r in chunk_files(spark.createDataFrame(files, "path string, body string"), 30).orderBy("path", "chunk_no").collect():
        got.setdefault(r["path"], []).append(r["body"].split("\n")[0])
    assert got == {"a.py": ["# def f (a.py:1)", "# def g (a.py:4)"], "b.py": ["x = 1", "x = 1"], "c.md": ["# A", "# B"], "d.txt": ["just text"]}


def test_periods_of_a_day_are_those_of_an_array_of_it(spark):
    days = spark.sql("select cast(d as date) as d from values ('1995-01-01'), ('2001-08-31'), ('2000-02-29'), ('0999-12-31'), ('0001-01-01'), ('9999-10-10'), (null) as t(d)")
    assert days.where(~T.day_periods("d").eqNullSafe(T.periods(F.array("d")))).count() == 0
