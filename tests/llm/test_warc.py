"""Archives written and read back in splits of any size; records hidden in payloads."""

import hashlib

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from loomspark.llm import warc
from loomspark.session import scratch_path

PAGES = "page_id long, url string, html string"


def plain(rows):
    """Expected records as the contract states them."""
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != page_id
        out.append((page_id is None, page_id or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


def back(manifest, split=warc.SPLIT):
    rows = warc.read_warc(manifest, split).collect()
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in rows)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in rows if r["payload"] is not None)
    return sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


FAKE = warc.record(99, "http://x", b"inner" * 30, hashlib.sha256(b"inner" * 30).hexdigest(), None).decode()
HIDDEN = [
    (1, "http://a", FAKE),
    (2, "http://a", FAKE * 5 + "tail"),
    (3, "http://b\r\nWARC-Type: x", "WARC/1.1\r\n" * 300),
    (4, None, "WARC/1.1\r\nContent-Length: 10\r\n\r\n" * 80),
    (5, "http://c", "WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"),
    (6, "http://d", "\r\n\r\n" * 50 + FAKE[:200]),
    (7, "http://e " + "u" * 200_000, "é漢🙂" * 400),
    (8, "http://f", "WARC/1.1\r\n"),
    *((i, f"http://g/{i}", f"page {i} " * (i % 37)) for i in range(9, 120)),
]


@pytest.mark.parametrize("split", [499, 50_000, warc.SPLIT])
def test_records_inside_payloads_are_rejected(spark, split):
    manifest = warc.write_warc(spark.createDataFrame(HIDDEN, PAGES).coalesce(1), scratch_path(spark, "warc"))
    assert back(manifest, split) == plain(HIDDEN)
    marks = warc.entries(manifest, split)
    if split < 50_000:
        assert warc.links(manifest, split).count() > marks.count()  # some looked like records


def test_copies_become_revisits(spark):
    long, short = "x" * 100, "y" * 99
    rows = [(i, f"u{i}", long) for i in range(300, 0, -1)] + [(i, None, short) for i in range(301, 311)] + [(400, "u", "é" * 50), (401, "u", "é" * 50)]
    got = back(warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(7), scratch_path(spark, "warc")), 5000)
    assert got == plain(rows) and sum(r[4] == "revisit" for r in got) == 300


def test_odd_rows(spark):
    big = "z" * 3_000_000
    rows = [(None, None, None), (None, "u", big), (2, "u", big), (2, "u", big), (1, "", ""), (1, "", ""), (5, "u", big), (None, "v", "q" * 200), (None, "v", "q" * 200)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], PAGES + ", digest int, salt string")
    got = back(warc.write_warc(df, scratch_path(spark, "warc")))
    assert got == plain(rows)
    empty = warc.write_warc(df.limit(0), scratch_path(spark, "warc"))
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


def test_a_broken_file_is_an_error(spark):
    where = scratch_path(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame(HIDDEN[8:], PAGES).coalesce(1), where)
    name = manifest.first()["path"]
    fs, path = pyarrow.fs.FileSystem.from_uri(name)
    with fs.open_input_file(path) as f:
        data = f.read()
    with fs.open_output_stream(path) as f:
        f.write(data.replace(b"Content-Length: ", b"Content-Length: 9", 1))
    with pytest.raises(ValueError, match="no chain"):
        warc.read_warc(manifest)
    cut = manifest.withColumn("size", F.lit(len(data) - 3).cast("long"))
    with pytest.raises(ValueError, match="no chain"):
        warc.read_warc(cut)
