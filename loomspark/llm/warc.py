"""WARC archives: written as one file per task, read back in splits along verified chains of records.

Any split of a file may hold the magic of a record, at its true start or inside a payload. So a task emits every place
that looks like a record of its split with the place where the next one would start, and where the chain from it leaves
the split. Pointer jumping over these links from the start of each file, twice as far a round, marks the place at which
its true chain enters each split; what merely looks like a record inside a payload is never reached. Then each split
yields the records from its entry on. A chain that doesn't arrive at the end of its file is an error.

Equal payloads of at least REVISIT bytes are stored once: the row with the smallest page_id is the response, the others
become revisit records that name it. Groups are dealt out by (payload, salt), so copies of any number meet in parts.

Defined results: a null html is an empty payload; a null url is left out; rows with a null page_id revisit but are
never referred to, so of a group of them alone all are responses; of repeated rows with the smallest page_id all are
responses; extra columns are ignored; an empty table gives no files and no rows. A record is in memory as a whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tokens import released
from loomspark.session import materialize, scratch_path

VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT = 100
SPLIT, SPLITS_A_TASK = 8 << 20, 16
HEADER = 64 << 10
#: The tables have no time of capture; a fixed date lets reruns agree.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]{1,18})\r\n", re.IGNORECASE)
AWKWARD = re.compile(r"[\x00-\x20\x7f]")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_record_schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def with_revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to names the row whose equal payload stands for this one's."""
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), (F.octet_length(html) >= least).alias("large"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    parts = materialize(rows.where("large").groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.count("*").alias("n")), "payload-parts")
    firsts = parts.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    known = materialize(parts.select("digest", "salt").join(firsts, "digest"), "payload-firsts")
    found = rows.join(known, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit without its payload, as the bytes of a WARC record."""
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + AWKWARD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        other = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
        head += [f"WARC-Refers-To: <urn:uuid:{other}>", f"Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + END + block + END


def parsed(data: bytes) -> tuple:
    """The columns of RECORD from a record's bytes; payload_bytes and the digest of a revisit are the full payload's."""
    head, _, block = data[: -len(END)].partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(END)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    size = int(LENGTH.search(http + b"\r\n")[1])
    return number("Page-ID"), fields.get("WARC-Target-URI"), kind, number("Refers-To-Page-ID"), digest, size, payload if kind == "response" else None


def write_warc(pages: DataFrame, directory: str, least: int = REVISIT, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) into WARC files under directory; returns the manifest (path, size, records). Files
    of lost or repeated task attempts aren't in it."""

    @released
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, size, n, name = None, 0, 0, f"{directory}/{uuid.uuid4().hex}.warc"
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if sink is None:
                    fs, path = pyarrow.fs.FileSystem.from_uri(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(path)
                data = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py(), date)
                sink.write(data)
                size, n = size + len(data), n + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return materialize(with_revisits(pages, least).mapInArrow(write, "path string, size long, records long"), "warc-manifest")


def splits(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, size, begin) of the splits of all files, dealt out evenly."""
    rows = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split))).alias("begin"))
    return dealt(rows, "path", "begin")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows for splits over as many tasks, or fewer of SPLITS_A_TASK where there are more splits than a cluster's partitions."""
    n, least = rows.count(), 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(n, max(least, n // SPLITS_A_TASK))), *keys)


class Reader:
    """Byte ranges of a file, wherever it is."""

    def __init__(self, name: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        self.file = fs.open_input_file(path)

    def __call__(self, begin: int, n: int) -> bytes:
        return self.file.read_at(n, begin)


def _next(data: bytes, at: int, begin: int, size: int, read: Reader, before: int | None = None) -> int | None:
    """Where the record after the one that seems to start at `at` would start; None if this can't be one. data is the
    file's from begin on; header and end are read apart where they lie beyond. A header ends before the next place, `before`."""
    low, seen = at - begin, len(data) - (at - begin)
    end = data.find(END, low, len(data) if before is None else before - begin)
    head = data[low : end + 2]
    while end < 0 and before is None and at + seen < size:
        seen = max(HEADER, 2 * seen)
        further = read(at, seen)
        end = further.find(END)
        head = further[: end + 2]
        end = end + low if end >= 0 else end
    found = LENGTH.findall(head) if end >= 0 else []
    if len(found) != 1:
        return None
    after = begin + end + len(END) + int(found[0]) + len(END)
    if after > size:
        return None
    tail = after - len(END) - begin
    return after if (data[tail : tail + len(END)] if tail + len(END) <= len(data) else read(after - len(END), len(END))) == END else None


def links(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, at, out): places that look like records, and the first place beyond their split that the chain from them
    reaches. Chains that break off within the split are left out."""

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                read, begin, size = Reader(part["path"]), part["begin"], part["size"]
                end = min(begin + split, size)
                data = read(begin, split + len(VERSION) - 1)
                places, at = [], data.find(VERSION)
                while at >= 0:
                    places.append(begin + at)
                    at = data.find(VERSION, at + 1)
                outs: dict[int, int] = {}
                for at, before in zip(reversed(places), [None, *reversed(places[1:])]):  # later ones first: each link is followed once
                    after = _next(data, at, begin, size, read, before)
                    out = after if after is None or after >= end else outs.get(after)
                    if out is not None:
                        outs[at] = out
                yield pa.RecordBatch.from_pydict({"path": pa.array([part["path"]] * len(outs), pa.string()), "at": pa.array(list(outs), pa.int64()), "out": pa.array(list(outs.values()), pa.int64())})

    return splits(manifest, split).mapInArrow(scan, "path string, at long, out long")


def entries(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, at): where the chain from each file's start enters its splits, and the file's end if it arrives there."""
    jumps = materialize(links(manifest, split), "warc-links")
    reached = manifest.where("size > 0").select("path", F.lit(0).cast("long").alias("at"))
    longest = manifest.agg(F.max("size")).first()[0] or 0
    step = 1
    while step <= -(-longest // split):
        further = reached.join(jumps, ["path", "at"]).select("path", F.col("out").alias("at"))
        reached = materialize(reached.union(further).distinct(), "warc-reached")
        step *= 2
        if step <= -(-longest // split):
            beyond = jumps.select("path", F.col("at").alias("out"), F.col("out").alias("far"))
            jumps = materialize(jumps.join(beyond, ["path", "out"]).select("path", "at", F.col("far").alias("out")), "warc-jumps")
    return reached


def read_warc(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of the files of a manifest (path, size), in the columns of RECORD; payload is null for a revisit."""
    marks = entries(manifest, split)
    whole = manifest.where("size > 0").select("path", F.col("size").alias("at")).join(marks, ["path", "at"], "left_anti")
    broken = [r["path"] for r in whole.select("path").limit(5).collect()]
    if broken:
        raise ValueError(f"no chain of records reaches the end of {broken}")
    parts = marks.join(manifest.select("path", "size"), "path").where("at < size").select("path", "size", "at", F.expr(f"at div {split}").alias("part"))

    @released
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark in batch.to_pylist():
                read, at, rows, held = Reader(mark["path"]), mark["at"], [], 0
                end = min((mark["part"] + 1) * split, mark["size"])
                begin, data = at, read(at, end - at)
                while at < end:
                    after = _next(data, at, begin, mark["size"], read)
                    piece = data[at - begin : after - begin] if after <= end else read(at, after - at)
                    rows.append(parsed(piece))
                    at, held = after, held + len(piece)
                    if held > 4 << 20 or at >= end:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _record_schema)], schema=_record_schema)
                        rows, held = [], 0

    return dealt(parts, "path", "part").mapInArrow(records, RECORD)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
