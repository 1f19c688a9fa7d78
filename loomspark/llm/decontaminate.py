"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of word characters, known by a 64-bit hash. A seed is the Karp-Rabin hash of a run of
MIN_MATCH tokens. One pass over the documents keeps the seeds that a Bloom filter of the benchmark's seeds may hold
(of bounded size; what it lets through in vain only costs); a join on each item's rarest seeds, as many as
decide, finds the items that may share enough of their places with a text, each distinct text and item once, and counts
them. Each such pair is tiled: the longest match of unmarked
tokens is marked again and again until none of MIN_MATCH tokens is left. An item's coverage is the share of its tokens
that tiles mark, in any order, so that reordered passages count; from THRESHOLD on the document is contaminated.

Defined results: a null text or item has no tokens and matches nothing; items shorter than MIN_MATCH tokens match as a
whole; repeated items and repeated rows each get their rows; null ids are kept; extra columns are ignored by
contaminated() and kept by clean(). An empty benchmark contaminates nothing, an empty table gives no rows. Texts of any
length are tiled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from loomspark.llm.tokens import Kept, hold, released
from loomspark.session import materialize

MIN_MATCH = 5
THRESHOLD = 0.5
GROUP_TOKENS = 1 << 18
CACHE = 150_000
#: Of the Bloom filter: probes of a seed, bits for each, and the base-2 logarithm of its least and most bits (16 MB).
PROBES, BITS_EACH, LEAST_BITS, MOST_BITS = 4, 64, 15, 27
BITMAP = 1 << 15
#: A text meets so many items in a row of the comparison; a pair with more seed hits is tiled row by row.
ITEMS_EACH, HITS = 256, 1 << 18
WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _hashed(piece: str) -> bytes:
    return np.array([xxhash.xxh64_intdigest(w) for w in tokens(piece)], np.uint64).tobytes()


_known = Kept(_hashed, CACHE)


def token_ids(text: str | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(_known.__getitem__, (text or "").split())), np.uint64)


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids."""
    size = max(0, len(ids) - n + 1)
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = out * _BASE + ids[j : j + size]
    return out


def tile(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length) from seed hits of n tokens, longest first; ties go to the earlier
    place in the item, then in the document."""
    same = np.ones(len(at_doc), bool)
    for j in range(n):
        same &= doc[at_doc + j] == item[at_item + j]
    p, q = at_doc[same], at_item[same]
    order = np.lexsort((q, p - q))
    p, q = p[order], q[order]
    tiles = []
    while len(p):
        first = np.flatnonzero((np.diff(p - q, prepend=(p - q)[0] - 1) != 0) | (np.diff(q, prepend=-2) != 1))
        length = np.diff(first, append=len(p)) + n - 1
        best = np.lexsort((p[first], q[first], -length))[0]
        at, in_item, size = int(p[first[best]]), int(q[first[best]]), int(length[best])
        tiles.append((at, in_item, size))
        free = ((p + n <= at) | (p >= at + size)) & ((q + n <= in_item) | (q >= in_item + size))
        p, q = p[free], q[free]
    return tiles


def tile_by_rows(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """The same tiles in memory of the document's size: for each place of the item in turn, the lengths of the matches
    that end there and at each place of the document."""
    open_doc, open_item, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    while True:
        best, run = (0, 0, 0), np.zeros(len(doc) + 1, np.int32)
        for q, token in enumerate(item):
            run[1:] = np.where((doc == token) & open_doc, run[:-1] + 1, 0) if open_item[q] else 0
            at = int(run.argmax())
            if run[at] > best[0]:
                best = int(run[at]), at - int(run[at]), q + 1 - int(run[at])
        size, at, in_item = best
        if size < n:
            return tiles
        tiles.append((at, in_item, size))
        open_doc[at : at + size] = open_item[in_item : in_item + size] = False


def tiles_of(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH, most_hits: int = HITS) -> list[tuple[int, int, int]]:
    """Greedy tiles of a pair; matches have min_match tokens or more, or all of a shorter item."""
    n = min(min_match, len(item))
    if not n:
        return []
    of_doc, of_item = rolled(doc, n), rolled(item, n)
    order = np.argsort(of_item, kind="stable")
    low, high = (np.searchsorted(of_item[order], of_doc, side) for side in ("left", "right"))
    counts = high - low
    met = np.flatnonzero(counts)
    total = int(counts[met].sum())
    if not total:
        return []
    if total <= most_hits:
        at_doc = np.repeat(met, counts[met])
        nth = np.arange(total) - np.repeat(np.cumsum(counts[met]) - counts[met], counts[met])
        return tile(doc, item, at_doc, order[np.repeat(low[met], counts[met]) + nth], n)
    inside = np.zeros(len(doc) + 1, np.int64)  # only runs of places that some seed covers can match
    np.add.at(inside, met, 1)
    np.add.at(inside, met + n, -1)
    kept = np.flatnonzero(np.cumsum(inside[:-1]))
    breaks = np.flatnonzero(np.diff(kept) > 1) + 1
    none = np.setdiff1d(np.arange(len(item) + 1, dtype=np.uint64), item)[:1]  # a token that the item lacks
    where = np.insert(kept, breaks, -1)
    packed = np.insert(doc[kept], breaks, none)
    return [(int(where[p]), q, size) for p, q, size in tile_by_rows(packed, item, n)]


def coverage(text: str | None, item: str | None, min_match: int = MIN_MATCH) -> tuple[float, int]:
    """(share of the item's tokens that tiles of the text mark, number of tiles)."""
    doc, own = token_ids(text), token_ids(item)
    tiles = tiles_of(doc, own, min_match)
    return (sum(t[2] for t in tiles) / len(own) if len(own) else 0.0), len(tiles)


def _text_key(text: str) -> list[Column]:
    """A text by 128 bits."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(ia, ib, text, n, size, seeds) of each distinct item text with tokens: its seeds of n tokens by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_known)
        for batch in batches:
            ids = [token_ids(t) for t in batch.column("text").to_pylist()]
            lengths = [min(MIN_MATCH, len(i)) for i in ids]
            seeds = [rolled(i, n).view(np.int64) if n else np.zeros(0, np.int64) for i, n in zip(ids, lengths)]
            made = [pa.array(lengths, pa.int32()), pa.array([len(i) for i in ids], pa.int64()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["ia", "ib", "text", "n", "size", "seeds"])

    rows = benchmark.where("text is not null").select(*[c.alias(f"i{name}") for c, name in zip(_text_key("text"), "ab")], "text").dropDuplicates(["ia", "ib"])
    return rows.mapInArrow(run, "ia long, ib long, text string, n int, size long, seeds array<long>").where("n > 0")


def bloom(seeds: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of seeds (seed): at most 2^MOST_BITS bits reach the driver, whatever the number of seeds."""
    n = seeds.count()
    mask = (1 << min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))) - 1
    step = F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(1))
    at = seeds.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (F.col("seed").bitwiseAND(F.lit(mask)) + i * step).bitwiseAND(F.lit(mask)))).alias("at"))
    parts = at.groupBy(F.expr(f"at div {BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BITMAP))).alias("bits"))
    out = np.zeros((mask + 1) // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _may_hold(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Places of seeds that the filter may hold."""
    mask, found = np.uint64(len(bits) * 8 - 1), np.arange(len(seeds))
    for i in range(PROBES):
        own = seeds[found]
        at = ((own & mask) + np.uint64(i) * ((own >> np.uint64(32)) & mask | np.uint64(1))) & mask
        found = found[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return found


def seeded(docs: DataFrame, lengths: list[int], bits: np.ndarray, every: bool) -> DataFrame:
    """docs with __seeds, the distinct seeds of a text that the filter may hold; only rows that have some, or every row."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 16 MB at most
    names = docs.columns

    def found_in(texts: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        flat, ends = np.concatenate(texts), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        left = ends[owner] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
        rows, seeds = [], []
        for n in lengths:
            hashes = rolled(flat, n)
            at = _may_hold(held.value, hashes)
            at = at[left[at] >= n]
            rows.append(owner[at])
            seeds.append(hashes[at])
        rows, seeds = np.concatenate(rows), np.concatenate(seeds)
        cuts = np.searchsorted(rows[order := np.argsort(rows, kind="stable")], np.arange(1, len(texts)))
        return [np.unique(s).view(np.int64) for s in np.split(seeds[order], cuts)]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_known)
        for batch in batches:
            out: list[np.ndarray] = []
            group: list[np.ndarray] = []
            size = 0
            for text in batch.column("text"):
                group.append(token_ids(text.as_py()))
                size += len(group[-1])
                if size > GROUP_TOKENS:
                    out += found_in(group)
                    group, size = [], 0
            out += found_in(group) if group else []
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*names, "__seeds"])
            yield made if every else made.filter(pa.array([len(s) > 0 for s in out], pa.bool_()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("__seeds", ArrayType(LongType())))


@released
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coverage of the items of each row by its text."""
    hold(_known)
    for batch in batches:
        rows = []
        for a, b, text, items in zip(*(batch.column(c) for c in ("a", "b", "text", "items"))):
            doc = token_ids(text.as_py())
            for item in items.as_py():
                own = token_ids(item["text"])
                tiles = tiles_of(doc, own)
                rows.append((a.as_py(), b.as_py(), item["ia"], item["ib"], sum(t[2] for t in tiles) / len(own), len(tiles)))
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "b", "ia", "ib", "coverage", "n_tiles"])


def rarest(own: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(ia, ib, seed): of each item's seed places (ia, ib, n, size, seed) the rarest in texts (a, b, seed), so many that a text
    without any of them lacks too many places to cover the item. Seeds that many items share thus meet no text, unless an
    item has no other."""
    common = placed.groupBy("seed").agg(F.count("*").alias("texts"))
    needed = F.ceil(threshold * F.col("size") / F.col("n") - 1e-9)  # places that a text must share
    by_item = W.partitionBy("ia", "ib")
    ranked = own.join(common, "seed", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    ranked = ranked.withColumn("place", F.row_number().over(by_item.orderBy("texts", "seed"))).withColumn("places", F.count("*").over(by_item))
    return ranked.where((F.col("place") <= F.col("places") - needed + 1) & (F.col("texts") > 0)).select("ia", "ib", "seed").distinct()


def _search(docs: DataFrame, benchmark: DataFrame, threshold: float, every: bool) -> tuple[DataFrame, DataFrame] | None:
    """(docs with a, b and __seeds, found): found (a, b, ia, ib, coverage, n_tiles) of texts and items; None if the
    benchmark has no tokens."""
    items = materialize(item_seeds(benchmark), "items")
    lengths = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]  # MIN_MATCH numbers at most
    if not lengths:
        return None
    own = items.select("ia", "ib", "n", "size", F.explode("seeds").alias("seed"))
    bits = bloom(own.select("seed").distinct())
    marked = seeded(docs, lengths, bits, every).select("*", *[c.alias(f"__{name}") for c, name in zip(_text_key("text"), "ab")])
    marked = materialize(marked, "seeded")
    texts = marked.where(F.size("__seeds") > 0).select(F.col("__a").alias("a"), F.col("__b").alias("b"), "text", F.col("__seeds").alias("seeds")).dropDuplicates(["a", "b"])
    texts = materialize(texts, "seeded-texts")
    placed = texts.select("a", "b", F.explode(F.array_distinct("seeds")).alias("seed"))
    candidates = materialize(placed.join(rarest(own, placed, threshold), "seed").select("a", "b", "ia", "ib").distinct(), "candidates")
    pairs = candidates.join(own, ["ia", "ib"]).join(placed, ["a", "b", "seed"]).groupBy("a", "b", "ia", "ib").agg(F.count("*").alias("places"), F.first("n").alias("n"), F.first("size").alias("size"))
    pairs = pairs.where(F.col("places") * F.col("n") >= threshold * F.col("size"))  # tiles can't cover more
    part = F.pmod(F.xxhash64("ia", "ib"), F.ceil(F.count("*").over(W.partitionBy("a", "b")) / ITEMS_EACH))
    asked = pairs.withColumn("part", part).join(items.select("ia", "ib", F.col("text").alias("item")), ["ia", "ib"])
    asked = asked.groupBy("a", "b", "part").agg(F.collect_list(F.struct("ia", "ib", F.col("item").alias("text"))).alias("items"))
    rows = asked.join(texts.select("a", "b", "text"), ["a", "b"]).select("a", "b", "text", "items")
    found = rows.mapInArrow(_compared, "a long, b long, ia long, ib long, coverage double, n_tiles int").where(F.col("coverage") >= threshold)
    return marked, materialize(found, "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of every document and item with coverage of threshold or more."""
    searched = _search(docs.select("doc_id", "text"), benchmark, threshold, False)
    if searched is None:
        kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, coverage double, n_tiles int"
        return docs.sparkSession.createDataFrame([], kinds)
    marked, found = searched
    items = benchmark.select("item_id", *[c.alias(f"i{name}") for c, name in zip(_text_key("text"), "ab")])
    rows = marked.select("doc_id", F.col("__a").alias("a"), F.col("__b").alias("b")).join(found, ["a", "b"])
    return rows.join(items, ["ia", "ib"]).select("doc_id", "item_id", "coverage", "n_tiles")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that no item contaminates. Only rows that share a seed are shuffled."""
    searched = _search(docs, benchmark, threshold, True)
    if searched is None:
        return docs
    marked, found = searched
    gone = found.select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct()
    untouched = marked.where(F.size("__seeds") == 0)
    return untouched.unionByName(marked.where(F.size("__seeds") > 0).join(gone, ["__a", "__b"], "left_anti").select(*marked.columns)).select(*docs.columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
