"""Token counts by rank-synchronous merging.

Pre-tokens that a batch of texts does not share with earlier ones become one ragged numpy array of symbols. Round by
round every sequence applies its lowest-ranked pair at all its places at once (the first place only, where the merge
could bring up a pair of lower rank), until none is left; the surviving symbols are the tokens.

Pieces between white space are split into pre-tokens here where Python and the tokenizers library agree on letters, and by
the library's own normalizer and pre-tokenizer elsewhere; merges are ours for all. Only byte-level BPE files are taken.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null and repeated doc_ids each get their row; extra
columns are ignored; an empty table gives no rows; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tokens import byte_letters, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 500_000
#: Longer pieces, such as lines of a script without spaces, are counted anew each time, so that the cache's bytes are bounded.
KEPT_CHARS = 64
GROUP_CHARS = 1 << 20
#: The tokenizer's normalizer and word pattern that the fast path implements (fixed values of the public file).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair merges over ragged arrays of symbol ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[chr(letters[b])] for b in range(256)], np.int32)
        self.final = np.array([vocab[chr(letters[b]) + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in (*zip(*pairs), [a + b for a, b in pairs]))
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], made.astype(np.int32)
        lowest = np.full(self.base, NONE, np.int64)
        ranks = np.arange(len(keys))
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self.unsafe = lowest[made] < ranks

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that each non-empty word ends up with."""
        out = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, lens, who = self.inner[raw], out.copy(), np.arange(len(words))
        ends = np.cumsum(lens) - 1
        sym[ends] = self.final[raw[ends]]
        while len(who):
            starts = np.cumsum(lens) - lens
            rank = np.full(len(sym), NONE, np.int64)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[starts + lens - 1] = NONE
            low = np.minimum.reduceat(rank, starts)
            active = low < NONE
            out[who[~active]] = lens[~active]
            stay = np.repeat(active, lens)
            sym, rank = sym[stay], rank[stay]
            who, lens, low = who[active], lens[active], low[active]
            if not len(who):
                break
            owner = np.repeat(np.arange(len(who)), lens)
            at = np.flatnonzero(rank == low[owner])
            fresh = np.diff(at, prepend=-2) != 1
            at = at[(at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]) % 2 == 0]
            first = np.diff(owner[at], prepend=-1) != 0
            at = at[first | ~self.unsafe[rank[at]]]
            sym[at] = self.made[rank[at]]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            sym = sym[left]
            lens = lens - np.bincount(owner[at], minlength=len(who))
        return out


class Counter:
    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or [pre]
        if model["type"] != "BPE" or not any(p.get("type") == "ByteLevel" for p in steps) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback")):
            raise ValueError(f"{name}: merges need a byte-level BPE file")
        self.known = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and steps[0].get("pattern") == {"Regex": WORDS}
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        special = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(special)) if special else None
        self.words, self.beyond = regex.compile(WORDS), re.compile("[^\0-\u052f]")
        self.odd_space, self.space = re.compile("[\x1c-\x1f]"), re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.bytes = {letter: byte for byte, letter in byte_letters().items()}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Runs of non-space characters after normalization, and how many special strings were taken out."""
        n = 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            n, found = len(parts) - 1, []
            for part in parts:
                found += self.pieces(part)[0]
            return found, n
        if not self.known:
            return [text], n
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return ([p for p in self.space.split(text) if p] if self.odd_space.search(text) else text.split()), n

    def split(self, piece: str) -> list[bytes]:
        """The piece's pre-tokens."""
        if self.known and not self.beyond.search(piece):
            return [w.encode() for w in self.words.findall(piece)]
        plain = self.tok.normalizer.normalize_str(piece) if self.tok.normalizer else piece
        return [bytes(map(self.bytes.__getitem__, map(ord, w))) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(plain)]

    def learn(self, unknown: list[str]) -> None:
        split = list(map(self.split, unknown))
        words = list({w for s in split for w in s if w})
        size = dict(zip(words, self.merges.counts(words).tolist())) if words else {}
        self.young.update((p, sum(size[w] for w in s if w)) for p, s in zip(unknown, split))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        needed = set().union(*(p for p, _ in cut))
        if len(self.young) + len(needed) > CACHE:
            self.old, self.young = self.young, {}
        unknown = needed - self.young.keys()
        again = unknown & self.old.keys()
        self.young.update((p, self.old[p]) for p in again)
        fresh = list(unknown - again)
        self.learn(fresh)
        found = [n + sum(map(self.young.__getitem__, p)) for p, n in cut]
        for piece in fresh:
            if len(piece) > KEPT_CHARS:
                del self.young[piece]
        return found


_counters: dict[str, Counter] = {}


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(name) or _counters.setdefault(name, Counter(name))
        for batch in batches:
            counts, group, chars = [], [], 0
            for text in batch.column("text"):
                group.append(text.as_py())
                chars += len(group[-1])
                if chars > GROUP_CHARS:
                    counts += counter.counts(group)
                    group, chars = [], 0
            counts += counter.counts(group)
            size = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_count(tokenizer), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
