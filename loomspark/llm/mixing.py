"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, documents in a hashed order, are packed into blocks of BLOCK_WORDS words. The mix has as many
slots as its targets fill: whole passes over the source's blocks, then part of one. Slot k of a source reads block
perm(k mod blocks) under the permutation of (source, k div blocks); as a source's last block is shorter, the part of a
pass takes it with the probability of any other word and counts it by its own words. Output shards draw their source counts by a pseudorandom permutation of all slots: the multinomial draw
conditioned on the totals, so that every source comes within half a block of its target instead of a random distance.
Permutations are swap-or-not shuffles, exact bijections of any range.

Defined results: a null text has size 0 and is never taken; a null source is a source, last in order; repeated rows
are packed one by one; a null doc_id is a key like others; extra columns are kept by mixed_documents() and ignored
otherwise; an empty table gives an empty result. Of rows equal in doc_id, source and text that differ in extra columns
mixed_documents() keeps any one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.session import fence, materialize

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
WEIGHTS = (1, 2, 3)
MOST = 3
CHUNK = 16384
SEED = 20
ROUNDS = 10
DOCS_PER_BUCKET = 512


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: a bijection of range(n) that key selects."""

    def step(acc: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - acc, n)
        swap = F.pmod(F.xxhash64(key, i + F.lit(rounds), F.greatest(acc, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), x, step)


def passes(per: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Adds whole (passes over all blocks), extra (1 if the part of a pass after them has the last, short block) and slots.

    The part is as many full blocks as come nearest to the words left, so that it misses them by half a block at most."""
    full, last = F.col("blocks") - 1, F.col("source_size") - (F.col("blocks") - 1) * block_words
    left, half = F.col("target") - F.col("whole") * F.col("source_size"), block_words / 2
    luck = F.pmod(F.xxhash64(F.lit(seed), "rank"), F.lit(1 << 20)) / float(1 << 20)
    extra = (left > full * block_words + half) | ((left >= last - half) & (luck * F.col("source_size") < left))
    nearest = F.floor((left - F.col("extra") * last) / block_words + 0.5)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0))
    per = per.withColumn("extra", F.when((left > 0) & extra, 1).otherwise(0))
    return per.withColumn("slots", F.col("whole") * F.col("blocks") + F.col("extra") + F.least(full, F.greatest(nearest, F.lit(0))) * (F.col("blocks") > 0).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per source: rank, source_size, target, blocks, whole, extra, slots, first_slot.

    Sources rank by code point, null last; weights repeat in that order. The targets share all words by weight, none
    above MOST times its source: filling up to a common level per weight, capped sources first.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    by_cap = W.orderBy(F.lit(MOST) * F.col("source_size") / F.col("weight"), "rank")
    before, onward, all_rows = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing), W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(all_rows) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward))
    per = per.withColumn("level", F.max("level").over(all_rows))
    per = per.withColumn("target", F.least((F.lit(MOST) * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")))
    per = passes(per.withColumn("blocks", F.ceil(F.col("source_size") / block_words)), block_words, seed)
    first = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("first_slot", F.coalesce(F.sum("slots").over(first), F.lit(0))).withColumn("all_slots", F.sum("slots").over(all_rows))


def place(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's first word (off) in its source's packed words: a prefix sum over hashed buckets, then within."""
    rows = sizes.join(targets.select(F.col("source").alias("t_source"), "rank", "docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.expr(f"1 + docs div {DOCS_PER_BUCKET}"))).drop("docs")
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    base = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("rank", "bucket").orderBy("doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(base, ["rank", "bucket"]).withColumn("off", F.col("base") + F.col("within")).drop("base", "within", "bucket")


def slots(targets: DataFrame, partitions: int, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: (rank, block, epoch, shard, slot)."""
    rows = targets.where("slots > 0").select("rank", "blocks", "whole", "extra", "slots", "first_slot", "all_slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    rows = rows.repartition(partitions, "rank", "chunk")
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1
    rows = rows.select("rank", "blocks", "whole", "extra", "first_slot", "all_slots", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("k"))
    rows = rows.select("rank", "blocks", "whole", "extra", "all_slots", F.expr("k div blocks").alias("epoch"), F.pmod("k", "blocks").alias("index"), (F.col("first_slot") + F.col("k")).alias("draw"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "rank", "epoch"))
    place_ = permuted(F.col("draw"), F.col("all_slots"), F.lit(seed))
    part = F.col("epoch") == F.col("whole")
    own = F.col("index") - F.when(part, F.col("extra")).otherwise(0)  # -1: the last block, out of turn
    among = F.when(part, F.greatest(F.col("blocks") - 1, F.lit(1))).otherwise(F.col("blocks"))
    block = F.when(own < 0, F.col("blocks") - 1).otherwise(permuted(own, among, F.col("key")))
    rows = rows.select("rank", "epoch", block.alias("block"), place_.alias("at"))
    return rows.select("rank", "block", "epoch", F.expr(f"at div {shard_slots}").alias("shard"), F.pmod("at", F.lit(shard_slots)).alias("slot"))


def block_pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that it reaches into: first word within the document and number of words."""
    rows = placed.where("size > 0").select("rank", "off", "size", F.explode(F.expr(f"sequence(off div {block_words}, (off + size - 1) div {block_words})")).alias("block"))
    low = F.greatest("off", F.col("block") * block_words)
    high = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.select("rank", "off", "block", (low - F.col("off")).alias("first"), (high - low).alias("words"))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed documents, pieces of the mix): pieces (rank, off, first, words, epoch, shard, slot), (rank, off) names a
    document of placed with size > 0."""
    spark = docs.sparkSession
    sizes = materialize(sized(docs), "mix-sizes")
    targets = materialize(source_targets(sizes, block_words, seed=seed), "mix-targets")
    placed = materialize(place(sizes, targets), "mix-placed")
    partitions = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = slots(targets, partitions, seed, shard_slots)
    return placed, drawn.join(block_pieces(placed, block_words).hint("merge"), ["rank", "block"])  # neither side is small


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: per document and epoch the words taken, in their order; columns as in docs.

    The words keep the white space after them; n_chars, where there is such a column, is counted anew.
    """
    placed, pieces = mix(docs, seed)
    taken = pieces.groupBy("rank", "off", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("__spans"), F.sum("words").alias("__taken"))
    keys = placed.where("size > 0").select("rank", "off", F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.col("size").alias("__size"))
    taken = taken.join(keys, ["rank", "off"]).drop("rank", "off", "epoch")
    texts = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    repeated = placed.groupBy("doc_id", "source", "text_hash").count().where("count > 1").limit(1).count()
    if repeated:
        texts = texts.dropDuplicates(["doc_id", "source", "__own"])
    rows = texts.join(taken, texts["doc_id"].eqNullSafe(taken["__doc"]) & texts["source"].eqNullSafe(taken["__source"]) & (texts["__own"] == taken["__hash"]))
    part = F.col("__taken") < F.col("__size")
    tokens = F.regexp_extract_all("text", F.lit(f"{WORD}[{SPACE}]*"), F.lit(0))
    rows = fence(rows, __tokens=F.when(part, tokens))
    cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__tokens"), (s["first"] + 1).cast("int"), s["words"].cast("int")))), "")
    rows = rows.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words taken of each document, and their places in the output: (shard, slot, words), null if none is taken."""
    placed, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = pieces.groupBy("rank", "off").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "slot", "words"))).alias("places")).select(F.col("rank").alias("p_rank"), F.col("off").alias("p_off"), "taken", "places")
    rows = placed.join(taken, (placed["rank"] == taken["p_rank"]) & (placed["off"] == taken["p_off"]) & (placed["size"] > 0), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "places")
