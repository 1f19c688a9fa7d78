"""Prefix trie of conversations by vertical bitmaps.

Conversations are rebuilt as digests of their turns and dealt out by ranges of conv_id. A task cuts its range into shards
of a bounded number of conversations and turns, with a bit for each conversation. Per position and turn an index holds the
bitset of the conversations that have it there. From the root on, depth first, a node's bitset meets the posting of the
next turn of its lowest member; the intersection is a child, its popcount the members, and what is left of the node's
bitset gives the other children. A bitset of the conversations of a length gives the members that end at a node.

Nodes of shards meet by their key, a chained 128-bit digest of their turns, in aggregates of bounded state. Sums over
subtrees are made within shards again, each node counting in one shard only, that of its smallest member, where all its
prefixes are nodes too; so no depth costs a round. Ending members are hashed as a stream in the order of shards, as SHA-256
asks; a node's list is never held whole. A conversation's turns (some 200 bytes each, without the texts) are in one task.

Defined results: turns in the order of turn (nulls first), ties by the digest of role and text; null role or text is
empty; repeated rows are turns of their own; rows with a null conv_id take no part; an empty table has no nodes; extra
columns are ignored; texts of any length are digested whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.tokens import released
from loomspark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of the same twenty begin with the first one's turns, HEADS - 1 at most.
FAMILY, HEADS = 20, 4
#: Conversations and turns of a shard at most (one conversation may have more turns).
SHARD_CONVS, SHARD_TURNS = 4096, 1 << 17
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
LOCAL = "shard long, pre long, stop long, key binary, up long, depth long, words long, n long, low long, inner boolean, ends string"
_local_schema = pa.schema([("shard", pa.int64()), ("pre", pa.int64()), ("stop", pa.int64()), ("key", pa.binary()), ("up", pa.int64()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("inner", pa.bool_()), ("ends", pa.string())])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words) of every turn, pos from 1; digest names role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, heads: Column | None = None) -> DataFrame:
    """(conv_id, part, pos, digest, words) of turns (as of numbered()): a mark for each conversation (part -1), the first h
    turns of the conversation at the start of its twenty (part 0), and its own after its first h (part 1). heads is h as a
    function of conv_id; crc32 of the decimal conv_id, modulo HEADS, if not given."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS if heads is None else heads
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    first = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    shared = convs.join(first, "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "words")
    own = turns.withColumn("h", h).where("pos > h").select("conv_id", F.lit(1).alias("part"), "pos", "digest", "words")
    mark = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    return mark.unionByName(shared).unionByName(own)


def bits(of: int) -> Iterator[int]:
    """Places of the bits of a bitset, ascending."""
    while of:
        low = of & -of
        yield low.bit_length() - 1
        of ^= low


def shard_nodes(ids: list[int], turns: list[list[tuple[str, int]]]) -> list[list]:
    """Rows of LOCAL of a shard's conversations in ascending order of ids: nodes depth first. pre and stop enclose a node's
    subtree, up is its parent's pre; turns are (digest, words)."""
    index: dict[tuple[int, str], int] = {}
    lengths: dict[int, int] = {}
    for i, found in enumerate(turns):
        bit = 1 << i
        for at, (digest, _) in enumerate(found):
            index[at, digest] = index.get((at, digest), 0) | bit
        lengths[len(found)] = lengths.get(len(found), 0) | bit
    rows, shard = [], ids[0]
    stack = [((1 << len(ids)) - 1, 0, ROOT, -1, 0)]
    while stack:
        members, depth, key, up, words = stack.pop()
        if members < 0:  # all of the subtree is done
            rows[up][2] = len(rows)
            continue
        pre, ending = len(rows), members & lengths.get(depth, 0)
        low = ids[(members & -members).bit_length() - 1]
        rows.append([shard, pre, 0, key, up, depth, words, members.bit_count(), low, members != ending, ",".join([str(ids[i]) for i in bits(ending)])])
        stack.append((-1, 0, b"", pre, 0))
        left, children = members ^ ending, []
        while left:
            digest, n = turns[(left & -left).bit_length() - 1][depth]
            child = left & index[depth, digest]
            left ^= child
            children.append((child, depth + 1, hashlib.blake2b(key + bytes.fromhex(digest), digest_size=16).digest(), pre, n))
        stack.extend(reversed(children))
    return rows


def _shards(most_convs: int, most_turns: int):
    @released
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, turns, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = shard_nodes(ids, turns)
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000]), _local_schema)], schema=_local_schema)

        for batch in batches:
            for conv_id, part, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "digest", "words"))):
                if part >= 0:
                    turns[-1].append((digest, words))
                    n += 1
                    continue
                if len(ids) >= most_convs or n >= most_turns:
                    yield from flush()
                    ids, turns, n = [], [], 0
                ids.append(conv_id)
                turns.append([])
        if ids:
            yield from flush()

    return nodes


def local_nodes(rows: DataFrame, most_convs: int = SHARD_CONVS, most_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of each shard, in the columns of LOCAL, from rows as of rebuilt()."""
    dealt = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return dealt.mapInArrow(_shards(most_convs, most_turns), LOCAL)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from parts of lists, sorted by key and shard."""
    key, state, keys, hashes = None, None, [], []
    for batch in batches:
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
        keys, hashes = [], []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


@released
def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the subtrees of a shard's nodes, sorted by shard and pre: each yields its key, what its subtree counts
    here, its children that count here, and its parent's smallest member."""
    held, shard = [], None

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        column = lambda name: t[name].to_numpy()
        own, pre, stop, up = column("own").astype(bool), column("pre"), column("stop"), column("up")
        sums = []
        for value in (np.where(own & ~column("inner").astype(bool), 1, 0), np.where(own, column("saved"), 0)):
            total = np.concatenate([[0], np.cumsum(value)])
            sums.append(total[stop] - total[pre])
        children = np.bincount(up[own & (up >= 0)], minlength=len(pre))
        parents = pa.array(np.where(up >= 0, column("conv_id")[np.maximum(up, 0)], 0), mask=up < 0)
        return pa.RecordBatch.from_arrays([t["key"].combine_chunks(), pa.array(sums[0]), pa.array(sums[1]), pa.array(children.astype(np.int64)), parents], ["key", "leaves", "saved", "children", "parent_conv_id"])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if shard is not None and shards[a] != shard:
                yield flush(held)
                held = []
            shard = shards[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield flush(held)


def prefix_trie(conversations: DataFrame, most_convs: int = SHARD_CONVS, most_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key) of every node of the
    trie of rebuilt conversations (conv_id, turn, role, text)."""
    turns = materialize(numbered(conversations), "turns")
    local = materialize(local_nodes(rebuilt(turns), most_convs, most_turns), "trie-local")
    nodes = local.groupBy("key").agg(F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.max("inner").alias("inner"), F.min("shard").alias("owner"))
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")
    placed = local.select("shard", "pre", "stop", "up", "key").join(nodes.select("key", "conv_id", "saved", "inner", "owner"), "key")
    placed = placed.select("shard", "pre", "stop", "up", "key", "conv_id", "saved", "inner", (F.col("shard") == F.col("owner")).alias("own"))
    sums = placed.repartition("shard").sortWithinPartitions("shard", "pre").mapInArrow(_subtrees, "key binary, leaves long, saved long, children long, parent_conv_id long")
    sums = sums.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children"), F.max("parent_conv_id").alias("parent_conv_id"))
    ends = local.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_ends, "key binary, ends_sha256 string")
    rows = nodes.drop("saved").join(sums, "key").join(ends, "key", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "key")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key")


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))) % 4 AS h  -- CRC-32
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.digest, o.words FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.digest, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
), m AS (
  SELECT c.conv_id, 0 AS depth, '' AS path, 0 AS words FROM c UNION ALL SELECT * FROM p
), last AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY 1),
n AS (
  SELECT path, depth, any_value(words) AS words, min(m.conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN depth = last THEN m.conv_id::VARCHAR END, ',' ORDER BY m.conv_id), '') AS ends
  FROM m JOIN last USING (conv_id) GROUP BY path, depth
), k AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT substr(n.path, 1, 32 * d) AS path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM n) n LEFT JOIN k ON k.path = n.path GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = substr(n.path, 1, 32 * (n.depth - 1))
"""
