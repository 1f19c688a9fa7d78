"""Fill-in-the-middle examples, cuts located by memoized content-defined chunks.

A gear hash of the last WINDOW bytes cuts texts into chunks, so that passages which texts share are cut alike wherever
they stand. A chunk's summary (tokens, code points, whether its ends are letters) is kept by its content. Chunk counts add
up to the counts before each chunk, one less wherever a run of letters goes on across a border; the chunk that holds
a cut follows by bisection, and only that chunk is walked.

Tokens are runs of A-Z and a-z and all other single code points; they cover a text, so a cut before token k is where it
starts. The cuts and the form follow from a SHA-256 of the doc_id, so reruns agree.

Defined results: a null text is empty, an empty text is plain; a null doc_id hashes as the word null; repeated rows each
get their row; extra columns are left out; an empty table gives no rows. Texts of any length are cut whole, in memory in
proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tokens import released

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those cut, and of 100 cut ones, those in suffix-prefix-middle order.
CUT, SPM = 90, 20
#: Bytes that the rolling hash sees; its low bits that are zero at a border; least and most bytes of a chunk.
WINDOW, BITS, LEAST, MOST = 32, 8, 64, 4096
#: Bytes of chunks and summaries that a worker keeps.
KEPT_BYTES, ROW_BYTES = 48 << 20, 300
TOKEN = re.compile(rb"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f\xc0-\xff]")
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def _gear() -> np.ndarray:
    """256 fixed random words, by SplitMix64 steps."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(32)


GEAR = _gear().astype(np.uint32)


def borders(data: np.ndarray) -> np.ndarray:
    """Ascending places where a chunk may end: the gear hash of the WINDOW bytes before is zero in its top BITS and a
    code point starts there. The hash of 2w bytes is made of two of w bytes, so a few passes give all hashes."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    h, width = GEAR[data], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, width * 2
    at = np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint32(32 - BITS) == 0) + WINDOW
    return at[(data[at] & 0xC0) != 0x80]


def chunks(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of UTF-8 data, which they cover."""
    view = np.frombuffer(data, np.uint8)
    found, start, n = borders(view).tolist(), 0, len(data)
    found.append(n)
    for end in found:
        while end - start > MOST:  # no border within reach
            cut = start + MOST
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            yield start, cut
            start = cut
        if end - start >= LEAST or end == n > start:
            yield start, end
            start = end


class Summaries:
    """Summaries by content: (tokens, code points, starts with a letter, ends with a letter). A hit is a chunk equal in all
    its bytes. The older half is dropped when KEPT_BYTES are reached."""

    def __init__(self):
        self.young, self.old, self.held, self.hits, self.asked = {}, {}, 0, 0, 0

    def __getitem__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        self.asked += 1
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = (len(TOKEN.findall(chunk)), len(chunk.decode()), bool(LETTER[chunk[0]]), bool(LETTER[chunk[-1]]))
            else:
                self.hits += 1
            if self.held > KEPT_BYTES // 2:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk) + ROW_BYTES
        else:
            self.hits += 1
        return found


class Counted:
    """A text's chunks with the tokens and code points before each."""

    def __init__(self, text: str, summaries: Summaries):
        data = text.encode()
        self.pieces = [data[a:b] for a, b in chunks(data)]
        found = [summaries[p] for p in self.pieces]
        self.joined = [False, *(a[3] and b[2] for a, b in zip(found, found[1:]))][: len(found)]
        self.before = [0, *accumulate(f[0] - j for f, j in zip(found, self.joined))]
        self.chars = [0, *accumulate(f[1] for f in found)]
        self.n = self.before[-1]

    def place(self, k: int) -> int:
        """Code points before token k; all of them for k = n."""
        if k == self.n:
            return self.chars[-1]
        at = bisect_right(self.before, k) - 1
        local = k - self.before[at] + self.joined[at]
        piece = self.pieces[at]
        start = next(islice(TOKEN.finditer(piece), local, None)).start()
        return self.chars[at] + len(piece[:start].decode())


def example(text: str, counted: Counted, h: list[int]) -> tuple[str, int | None, int | None, str]:
    """(form, prefix_chars, middle_chars, output) of a text under four random numbers."""
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= CUT:
        return "plain", None, None, text
    a, b = sorted((h[0] % (counted.n + 1), h[1] % (counted.n + 1)))
    i, j = counted.place(a), counted.place(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < SPM:
        return "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_summaries = Summaries()


@released
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, h in zip(batch.column("text"), batch.column("h").to_pylist()):
            text = text.as_py()
            counted = Counted(text, _summaries)
            rows.append((counted.n, *example(text, counted, h)))
        n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: str = "1:") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text)."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_examples, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part of a cut text holds a mark, so the marks split it exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(order)


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok,
    [('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, 'null')), 8 * i + 1, 8))::BIGINT for i in range(4)] AS h
  FROM documents
), c AS (
  SELECT *, len(tok)::BIGINT AS n, least(h[1] % (len(tok) + 1), h[2] % (len(tok) + 1)) AS a, greatest(h[1] % (len(tok) + 1), h[2] % (len(tok) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, n, form, text, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid, array_to_string(tok[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
