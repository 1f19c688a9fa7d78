"""op10's draw of every document against a plain one: hashes, permutations, packing and slots in Python."""

import math
import random
import struct
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from loomspark.llm import mixing

from test_operators import brute_targets


def hashed(*values):
    """Spark's xxhash64: strings by their UTF-8, ("i", x) as 32 and plain numbers as 64 bits; nulls leave the hash alone."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def permuted(x, n, key):
    for i in range(mixing.ROUNDS):
        other = (hashed(key, ("i", i)) % n - x) % n
        if hashed(key, ("i", i + mixing.ROUNDS), max(x, other)) % 2:
            x = other
    return x


def drawn(rows):
    """(doc_id, source, size) -> sorted (shard, slot, words) of each row."""
    sizes, docs = Counter(), defaultdict(list)
    for i, source, text in rows:
        size = len((text or "").split())
        sizes[source] += size
        docs[source].append((i, hashed(text or ""), size))
    target = brute_targets(dict(sizes))
    ranked = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    plans = []
    for rank, source in enumerate(ranked, 1):
        total, b = sizes[source], mixing.BLOCK_WORDS
        blocks = -(-total // b)
        whole = math.floor(target[source] / max(total, 1)) if total else 0
        left, full, last = target[source] - whole * total, blocks - 1, total - (blocks - 1) * b
        luck = hashed(("i", mixing.SEED), ("i", rank)) % (1 << 20) / (1 << 20)
        extra = int(left > 0 and (left > full * b + b / 2 or (left >= last - b / 2 and luck * total < left)))
        part = min(full, max(0, math.floor((left - extra * last) / b + 0.5))) if blocks else 0
        plans.append((rank, source, blocks, whole, extra, whole * blocks + extra + part))
    every, first, owner = sum(p[-1] for p in plans), 0, defaultdict(list)
    for rank, source, blocks, whole, extra, slots in plans:
        n = 1 + len(docs[source]) // mixing.DOCS_PER_BUCKET
        order = sorted(docs[source], key=lambda d: (hashed(d[0], d[1]) % n, d[0] is not None, d[0] or 0, d[1]))
        words = [k for k, d in enumerate(order) for _ in range(d[2])]
        for k in range(slots):
            epoch, index = divmod(k, blocks)
            place = permuted(first + k, every, ("i", mixing.SEED))
            own, among = (index - extra, max(blocks - 1, 1)) if epoch == whole else (index, blocks)
            block = blocks - 1 if own < 0 else permuted(own, among, hashed(("i", mixing.SEED), ("i", rank), epoch))
            for at, n_words in Counter(words[block * mixing.BLOCK_WORDS : (block + 1) * mixing.BLOCK_WORDS]).items():
                owner[order[at][0], source, order[at][2]].append((*divmod(place, mixing.SHARD_SLOTS), n_words))
        first += slots
    return {key: sorted(places) for key, places in owner.items()}


def test_every_document_is_drawn_as_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing.slots, "__defaults__", (mixing.SEED, 16))
    monkeypatch.setattr(mixing.mix, "__defaults__", (mixing.SEED, mixing.BLOCK_WORDS, 16))
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    rng = random.Random(8)
    rows = [(i, rng.choice(["big", "big", "big", "b", "é", None]), "w " * rng.choice([0, 1, 7, 40, 200])) for i in range(700)] + [(None, "b", "no id"), (800, "tiny", "one two three")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = drawn(rows)
    got = mixing.op10_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, s, _ in rows}
    assert {(r["doc_id"], source[r["doc_id"]], r["size"]): sorted(tuple(p) for p in r["places"]) for r in got if r["taken"]} == want
    assert all(r["taken"] == sum(p["words"] for p in r["places"] or []) for r in got)
    shards = {p[0] for places in want.values() for p in places}
    assert len(shards) > 5 and shards == set(range(len(shards)))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op10_mix_sources(spark, str(tmp_path)).count() == 0
