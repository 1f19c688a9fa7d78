"""The prefix trie against a plain one, over shards of any size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomspark.llm.prefix_trie import bits, prefix_trie, shard_nodes

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(found)] for c, found in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(found) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in list(members.items()))


def trie(df, **sizes):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in prefix_trie(df, **sizes).collect())


def some(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(0, n):
        if c % 20 == 0 and rng.random() < 0.2:
            continue  # its family has no first conversation
        for turn in range(rng.choice([1, 1, 2, 3, 6, 12])):
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "long text here 　 x"])))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"most_convs": 1}, {"most_convs": 7, "most_turns": 9}])
def test_equals_a_plain_trie(spark, sizes):
    rows = some(160, 5)
    assert trie(spark.createDataFrame(rows, ROWS).repartition(5), **sizes) == plain(rows)


def test_one_first_turn_for_a_third_and_many_copies(spark):
    rows = [(c, t, "user", "hello there" if t == 0 and c % 3 == 0 else f"{c % 5} {t}") for c in range(600) for t in range(4)]
    assert trie(spark.createDataFrame(rows, ROWS), most_convs=50) == plain(rows)


def test_odd_rows(spark):
    odd = [(None, 1, "user", "x"), (3, None, None, None), (3, None, None, None), (3, 2, "user", ""), (4, 0, "user", "w " * 50_000), (-20, 0, "user", "a"), (-21, 0, "b", "c")]
    df = spark.createDataFrame([(*r, 1, "k") for r in odd], ROWS + ", depth int, key string")
    want = [r for r in odd if r[0] is None or r[0] >= 0]
    assert trie(df.where("conv_id is null or conv_id >= 0")) == plain(want)
    assert sum(r[3] for r in trie(df) if r[1] == 0) == 4
    assert prefix_trie(df.limit(0)).count() == 0


def test_a_long_conversation_and_a_turnless_one(spark):
    turnless = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(200, t, "user", f"t{t % 7}") for t in range(5000)] + [(turnless, 0, "user", "gone")]
    got = trie(spark.createDataFrame(rows, ROWS), most_turns=100)
    assert got == plain([*rows]) if len(rows) < 100 else len(got) == 5001
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 2 and root[7] == hashlib.sha256(str(turnless).encode()).hexdigest()


def test_bitsets():
    assert list(bits(0b101001)) == [0, 3, 5] and list(bits(0)) == []
    nodes = shard_nodes([5, 9], [[("00", 1), ("01", 2)], [("00", 1)]])
    assert [(n[1], n[2], n[4], n[5], n[7], n[8], n[9], n[10]) for n in nodes] == [(0, 3, -1, 0, 2, 5, True, ""), (1, 3, 0, 1, 2, 5, True, "9"), (2, 3, 1, 2, 1, 5, False, "5")]
