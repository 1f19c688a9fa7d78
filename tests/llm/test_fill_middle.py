"""Chunks and counts against plain tokenizing, and texts back from outputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm.fill_middle import LEAST, MOST, Counted, Summaries, chunks, fill_in_middle, restored

TOKENS = re.compile("[A-Za-z]+|[^A-Za-z]")


def texts():
    rng = random.Random(3)
    letters = "abcXYZ  \n.,;0123éüß漢字🙂́'"
    made = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 31, 32, 33, 64, 65, 100, 1000, 20_000)]
    return ["", "a", "é", "🙂", *made, "a" * 30_000, " " * 10_000, "漢" * 9000, "ab " * 5000, "x" * MOST, "x" * (MOST + 1) + "é" * 9]


@pytest.mark.parametrize("text", texts(), ids=len)
def test_counts_and_places_equal_plain_tokens(text):
    data = text.encode()
    parts = list(chunks(data))
    assert b"".join(data[a:b] for a, b in parts) == data and all(0 < b - a <= MOST for a, b in parts)
    assert all(b - a >= LEAST - 3 for a, b in parts[:-1])
    tokens = TOKENS.findall(text)
    counted = Counted(text, Summaries())
    assert counted.n == len(tokens) and counted.chars[-1] == len(text)
    starts = np.cumsum([0, *map(len, tokens)])
    rng = random.Random(1)
    for k in {0, len(tokens), *(rng.randint(0, len(tokens)) for _ in range(200))}:
        assert counted.place(k) == starts[k]


def test_shared_passages_share_chunks():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage, kept = words(2000), Summaries()
    Counted(words(50) + passage, kept)
    kept.hits = kept.asked = 0
    Counted(words(73) + passage + words(20), kept)
    assert kept.hits / kept.asked > 0.9


def test_outputs_of_every_form(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = fill_in_middle(docs).join(docs.select("doc_id", "text"), "doc_id").withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count() and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert r["back"] == r["text"] and r["n"] == len(TOKENS.findall(r["text"]))
        if r["form"] != "plain":
            i, j = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            p, m, s = r["text"][:i], r["text"][i:j], r["text"][j:]
            assert r["output"] == (f"<P>{p}<S>{s}<M>{m}" if r["form"] == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some text here"), (3, "has <M> inside"), (4, "same words"), (4, "same words"), (5, "long " * 200_000), (6, "\n\t "), (7, "<<S"), (8, "P>é")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, form string")
    got = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r["doc_id"] or 0, r["back"]) for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["form"] == "plain" and by[i]["prefix_chars"] is None for i in (1, 2, 3)) and by[1]["n"] == 0 and by[5]["n"] == 400_000
    assert fill_in_middle(df.limit(0)).count() == 0
