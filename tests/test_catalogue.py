import hashlib
import re
from collections import Counter

import pytest

from loomspark.functions.chunking import split_text
from loomspark.functions.stemming import stem
from loomspark.plans import catalogue
from oracle import same

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, catalogue.queries()[name], SQL[name], sf)


def test_every_query_has_sql_or_a_test_of_its_own():
    """fiedler, full_analysis and rmt_novel: test_whole_graph.py; markdown_chunks: test_markdown.py; the others below."""
    assert set(catalogue.queries()) - set(SQL) == {"fiedler", "full_analysis", "rmt_novel", "text_chunks", "stemmed_terms", "markdown_chunks"}


def test_text_chunks_equal_plain_splitting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r["doc_id"], i, hashlib.md5(c.encode()).hexdigest(), len(c)) for r in docs for i, c in enumerate(split_text(r["text"]))}
    assert {tuple(r) for r in catalogue.queries()["text_chunks"](spark, sf).collect()} == want


def test_stemmed_terms_equal_plain_stemming(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter(stem(t.lower()) for text in texts for t in re.findall(r"\w+", text) if len(t) <= 64)
    assert {r["stem"]: r["n"] for r in catalogue.queries()["stemmed_terms"](spark, sf).collect()} == want


def test_entry_point_imports():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
