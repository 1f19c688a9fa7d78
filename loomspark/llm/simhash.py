"""SimHash near-duplicates by multi-index hashing.

Fingerprints are counted in numpy per document. Two fingerprints at Hamming distance 3 or less have a 32-bit half that
differs in at most one bit: the table holds every distinct fingerprint under both halves, probes are a half itself and
the half with one set bit cleared (of two halves one bit apart exactly one has the bit set), and matches are verified
on all 64 bits. Copies share a fingerprint and meet only as one. A half that more than HOT distinct fingerprints share
is compared in blocks of BLOCK, each task returning a spanning forest of its links instead of all pairs.

Defined results: a null text has no words, hence fingerprint zero, linked like any other; a null doc_id gets its
group's smallest doc_id (null if the group has none); repeated rows each get their row; extra columns are ignored; an
empty table gives no rows; texts of any length are hashed whole. keep_one() keeps extra columns; of rows equal in doc_id
and text that differ in them it keeps any one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.components import connected_components
from loomspark.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
HOT = 64
BLOCK = 1024
PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included; a bit is set if it is in over half of the hashes."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
    k = min(SHINGLE, len(words))
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[k - 1 + i : k - 1 + i + PIECE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(values.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, text_hash long, fp long")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the probing and the table fingerprints of one block pair, as edges to the smallest of a group."""
    probes, table = pdf.fp[pdf.probing].unique(), pdf.fp[~pdf.probing].unique()
    near = np.bitwise_count((probes[:, None] ^ table[None, :]).view(np.uint64)) <= DISTANCE  # of signed numbers it would count the magnitude's bits
    top = np.iinfo(np.int64).max
    rows, cols = probes.copy(), table.copy()
    while len(rows) and len(cols):
        new_rows = np.minimum(rows, np.where(near, cols[None, :], top).min(1))
        new_cols = np.minimum(cols, np.where(near, new_rows[:, None], top).min(0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    out = pd.DataFrame({"a": np.concatenate([probes, table]), "b": np.concatenate([rows, cols])})
    return out[out.a != out.b].drop_duplicates()


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of distinct (column fp) as all pairs within DISTANCE would."""
    low, high = F.expr("fp & 4294967295"), F.expr("shiftrightunsigned(fp, 32)")
    halves = distinct.select("fp", F.posexplode(F.array(low, high)).alias("part", "half"))
    halves = halves.select("fp", F.col("half"), F.expr("half | shiftleft(cast(part as long), 32)").alias("key"))
    sizes = halves.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = materialize(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "hot-halves")
    cleared = F.expr("transform(filter(sequence(0, 31), i -> getbit(half, i) = 1), i -> key - shiftleft(1L, i))")
    probes = halves.select("fp", F.explode(F.concat(F.array("key"), cleared)).alias("key"), F.col("key").alias("own"))
    probes = probes.select("fp", "key", (F.col("key") == F.col("own")).alias("same"))
    table = halves.select(F.col("fp").alias("t_fp"), F.col("key").alias("t_key")).join(hot, F.col("t_key") == hot["key"], "left_anti")
    cold = probes.join(
        table,
        (probes["key"] == table["t_key"]) & (F.bit_count(probes["fp"].bitwiseXOR(table["t_fp"])) <= DISTANCE) & (~probes["same"] | (probes["fp"] < table["t_fp"])),
    ).select(F.col("fp").alias("a"), F.col("t_fp").alias("b"))
    if hot.isEmpty():
        return cold
    counts = probes.join(hot, "key").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("p_blocks"))
    sides = hot.join(counts, "key")
    ask = probes.join(sides, "key").select("key", "fp", F.lit(True).alias("probing"), F.pmod(F.xxhash64("fp"), "p_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    held = halves.join(sides, "key").select("key", "fp", F.lit(False).alias("probing"), F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("fp"), "blocks").alias("j"))
    return cold.union(ask.union(held).groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root): root names the group, as the smallest fingerprint that fp reaches."""
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(marked.select("fp").distinct(), "distinct-fingerprints")
    roots = connected_components(links(distinct))
    rows = marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return rows.select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that the row's group reaches."""
    grouped = materialize(simhash_groups(docs), "simhash-groups")
    smallest = materialize(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return grouped.join(smallest, "root").select("doc_id", "fp", "component_id")


def joined_groups(*methods: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Groups that the links of all methods form together. Each method gives (doc_id, text_hash, root) of every row, equal texts
    under one root."""

    def groups(docs: DataFrame) -> DataFrame:
        found = [materialize(method(docs).select("doc_id", "text_hash", "root"), "groups") for method in methods]
        own = lambda table, i: table.select("text_hash", F.concat(F.lit(f"{i}:"), F.col("root").cast("string")).alias(f"root{i}")).distinct()
        texts = own(found[0], 0)
        for i, table in enumerate(found[1:], 1):
            texts = texts.join(own(table, i), "text_hash")
        texts = materialize(texts, "texts")
        edges = texts.select(F.explode(F.array(*[F.struct(F.col("root0").alias("a"), F.col(f"root{i}").alias("b")) for i in range(1, len(found))])).alias("e")).select("e.a", "e.b")
        tops = connected_components(edges).select(F.col("node").alias("root0"), "root")
        return found[0].select("doc_id", "text_hash").join(texts.select("text_hash", "root0").join(tops, "root0"), "text_hash").select("doc_id", "text_hash", "root")

    return groups


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = simhash_groups) -> DataFrame:
    """Rows of docs, one of each group: the smallest doc_id (nulls last), of its rows the smallest text hash."""
    grouped = groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = materialize(grouped.groupBy("root").agg(first, F.count("*").alias("rows")).select(F.col("first.doc_id").alias("__doc"), F.col("first.text_hash").alias("__hash")), "kept")
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__doc"]) & (keyed["__own"] == kept["__hash"]))
    if rows.groupBy("__doc", "__hash").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["__doc", "__hash"])
    return rows.select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
