"""Markdown blocks and chunks: everything covered, budgets kept, fences, lists and tables whole."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions.markdown import blocks, chunk_function, chunk_markdown, chunks
from loomspark.plans import record_queries as Q

TEXT = """Intro line
goes on.

# One #
para a. Sentence two is here. Third one follows now.

```py
# not a heading

x = 1
```
## Two
- item

  more of it
- second
1) other

| a | b |
|---|---|
| 1 | 2 |
### Deep
~~~~
``` inside
~~~~
# Last
end"""


def test_blocks():
    got = [(b.kind, " > ".join(b.path), TEXT[b.start : b.end].split("\n")[0]) for b in blocks(TEXT)]
    assert got == [("text", "", "Intro line"), ("heading", "One", "# One #"), ("text", "One", "para a. Sentence two is here. Third one follows now."), ("fence", "One", "```py"), ("heading", "One > Two", "## Two"), ("list", "One > Two", "- item"), ("table", "One > Two", "| a | b |"), ("heading", "One > Two > Deep", "### Deep"), ("fence", "One > Two > Deep", "~~~~"), ("heading", "Last", "# Last"), ("text", "Last", "end")]
    assert [b.kind for b in blocks("```\nnever closed\n\n# x")] == ["fence"] and list(blocks(" \n\t\n")) == []


def held(text, budget, measure=len):
    """Chunks of a text, after the properties that all must have."""
    found, at, seen = list(chunks(text, budget, measure)), 0, ""
    whole = [(b.start, b.end, b.kind) for b in blocks(text) if b.kind in ("fence", "list", "table")]
    for _, first, last, tokens, body in found:
        assert at <= first and text[first:last] == body and tokens == measure(body) > 0
        at, seen = last, seen + body
        assert all(first >= end or last <= start or (first <= start and last >= len(text[:end].rstrip())) for start, end, _ in whole)
        inside = [b for b in blocks(text) if first <= b.start < last]
        assert tokens <= budget or len(inside) == 1 and inside[0].kind != "text" or len(body.split()) == 1
    assert "".join(seen.split()) == "".join(text.split())
    return found


@pytest.mark.parametrize("budget", [8, 30, 60, 10_000])
def test_chunks_of_a_text(budget):
    found = held(TEXT, budget)
    assert [p for p, *_ in found][-1] == "Last" and (budget < 10_000 or [p for p, *_ in found] == ["", "One", "One > Two", "One > Two > Deep", "Last"])


def test_chunks_of_random_texts():
    rng = random.Random(6)
    parts = ["# A", "## B b", "```", "~~~", "- i", "  cont", "1. n", "| r | s |", "word " * 9, "Some text. More.", "", "", "\tx"]
    for _ in range(300):
        held("\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), rng.choice([5, 20, 80]))


def test_query_keeps_budget_and_blocks(spark, sf):
    import public_tokenizers

    from loomspark.functions.chunking import token_measure

    measure = token_measure(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["body"] for r in Q.markdown_docs(spark, sf).collect()}
    got = {}
    for r in Q.markdown_chunks(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["path"], r["first"], r["last"], r["tokens"], r["digest"]))
    assert set(got) == set(docs)
    for i in sorted(docs)[:40]:
        want = held(docs[i], 64, measure)
        assert sorted(got[i]) == [(n, p, a, b, t, hashlib.md5(c.encode()).hexdigest()) for n, (p, a, b, t, c) in enumerate(want)]


def test_as_sql_and_odd_rows(spark):
    spark.udtf.register("chunks", chunk_function())
    docs = spark.createDataFrame([(1, "# T\n\na b"), (2, None), (3, ""), (None, "x"), (None, "x")], "doc_id long, body string").withColumn("other", F.lit(1))
    docs.createOrReplaceTempView("md")
    rows = spark.sql("SELECT d.doc_id, c.chunk_no, c.path, c.body FROM md d, LATERAL chunks(d.body, 256) c").collect()
    assert sorted((r["doc_id"] or 0, r["chunk_no"], r["path"], r["body"]) for r in rows) == [(0, 0, "", "x"), (0, 0, "", "x"), (1, 0, "T", "# T\n\na b")]
    assert chunk_markdown(docs).columns == ["doc_id", "other", "chunk_no", "path", "first", "last", "tokens", "body"] and chunk_markdown(docs.limit(0)).count() == 0


def test_token_lengths_by_pieces():
    """Lengths equal the library's on odd white space and for all prefixes, which need few calls of it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomspark.functions.chunking import split_text, token_measure

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, measure = Tokenizer.from_file(path), token_measure(path)
    plain = lambda t: len(library.encode(t, add_special_tokens=False))
    rng, parts = random.Random(1), ["a", "B", "\u00e9", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "'s", "1", "22", ".", "<|endoftext|>", "\u6f22", "the", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        first = measure.prefixes(text)
        assert measure(text) == plain(text) and [first(n) for n in range(len(text) + 1)] == [plain(text[:n]) for n in range(len(text) + 1)]
    words = " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(4000))
    calls, counted = [], measure.counted
    measure.counted = lambda piece: calls.append(len(piece)) or counted(piece)
    assert split_text(words, 64, measure=measure) == split_text(words, 64, measure=plain)
    assert sum(calls) < len(words) / 4
