"""Token-ID output as Arrow IPC files with fixed-size-list batches, and the way back.

A shard is one partition: its documents in ascending doc_id order, ids concatenated (END_ID after each document) and
cut into sequences of `seq_len`. Its file holds record batches of ROWS sequences with `ids` (fixed-size list of uint16,
or uint32 where the vocabulary needs it) and `mask` (fixed-size list of bool, false for the padding of the shard's last
sequence), so that sequence i is a view into the mapped file. An index file beside it holds doc_id, start and n_tokens.
Shards follow each other in doc_id order; the manifest says which files count, so those of lost or repeated task
attempts are never read. Input whose partitions already cover disjoint ranges of doc_id is not shuffled.

Defined results: a null text is empty (its end id only); null doc_ids come first; repeated doc_ids are ordered by the
hash of their text; extra columns are ignored; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import ctypes
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.session import materialize, scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SEQ_LEN = 1024
ROWS = 1024
CACHE = 400_000
KEPT_CHARS = 64
#: The public pattern by which byte-level BPE splits text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


_caches: list[Kept] = []


class Kept(dict):
    """Bounded cache in two generations: what is asked for again survives when the younger one is full. Keys longer than
    KEPT_CHARS, such as lines of a script without spaces, are made anew each time, so that its bytes are bounded too."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}
        _caches.append(self)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEPT_CHARS:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def hold(*caches: Kept) -> None:
    """Empty all other caches of this worker: operators that follow each other in one don't add up."""
    for cache in _caches:
        if not any(cache is c for c in caches):
            cache.clear()
            cache.old = {}
    _caches[:] = caches


def released(run: Callable) -> Callable:
    """run, a function of batches, so that at its end a worker that may then wait gives back the memory it has freed."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian bytes of `dtype`.

    Between two non-space characters a single space always starts a new word under WORDS, so pieces cut there are
    encoded by the library once and kept. Texts with special strings, and other kinds of tokenizer, go to it whole.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        special = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(special)) if special else None
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_words = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.words, self.letters, self.model = regex.compile(WORDS), byte_letters(), self.tok.model
        self.ascii_words = re.compile(WORDS.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+"), re.ASCII)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.beyond, self.awkward, self.between = re.compile("[^\0-ԯ]"), re.compile(r" \s|\s |^ | $"), re.compile(r"(?<=\S) (?=\S)")
        self.word, self.first = Kept(self._word, CACHE // 2), Kept(self._pieces, CACHE // 8)
        self.rest = Kept(lambda piece: self._pieces(" " + piece), CACHE)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # such bytes but the space stand for themselves
            spelled = word.replace(" ", chr(self.letters[32]))
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _pieces(self, piece: str) -> bytes:
        if piece.isascii():
            words = self.ascii_words.findall(piece)
        elif self.beyond.search(piece):
            return self._whole(piece)
        else:
            words = self.words.findall(piece)
        return self._word(words[0]) if len(words) == 1 else b"".join(map(self.word.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        if not self.by_words or (self.special and self.special.search(text)):
            return self._whole(text)
        pieces = self.between.split(text) if self.awkward.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    found = _encoders[name]
    hold(found.word, found.first, found.rest)
    return found


class ShardWriter:
    def __init__(self, directory: str, shard: int, dtype: np.dtype, seq_len: int):
        self.name = f"{directory}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        self.fs, path = pyarrow.fs.FileSystem.from_uri(self.name)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.kind, self.seq_len = pa.from_numpy_dtype(dtype), seq_len
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = self.fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.dtype, self.parts, self.held, self.total = dtype, [], 0, 0
        self.docs: tuple[list, list, list] = [], [], []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        for column, value in zip(self.docs, (doc_id, self.total, n)):
            column.append(value)
        self.parts.append(ids)
        self.held, self.total = self.held + n, self.total + n
        if self.held >= self.seq_len * ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        block = self.seq_len * ROWS
        full = len(ids) // block * block
        for i in range(0, full, block):
            self._batch(ids[i : i + block], block)
        rest = ids[full:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.parts, self.held = [rest.tobytes()], len(rest)

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.seq_len), pa.FixedSizeListArray.from_arrays(mask, self.seq_len)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.sink.close()
        index = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.docs], ["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(pyarrow.fs.FileSystem.from_uri(self.name)[1] + ".index") as sink, pa.ipc.new_file(sink, index.schema) as file:
            file.write_batch(index)


class TokenFile:
    """Random access to a shard: views of the mapped file where the store is local."""

    def __init__(self, name: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        with fs.open_input_file(path + ".index") as f:
            self.index = pa.ipc.open_file(f).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i; ids is a view without a copy."""
        batch = self.file.get_batch(i // ROWS)
        return self._ids(i // ROWS)[i % ROWS * self.seq_len :][: self.seq_len], batch.column("mask")[i % ROWS].values

    def _ids(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column("ids").values.to_numpy(zero_copy_only=True)

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start in the shard, ids) of each document."""
        block, at, ids = ROWS * self.seq_len, -1, None
        for doc_id, start, n in zip(*(self.index[c].to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            found = []
            for b in range(start // block, (start + n - 1) // block + 1):
                if b != at:
                    at, ids = b, self._ids(b)
                found.append(ids[max(0, start - b * block) : start + n - b * block])
            yield doc_id, start, found[0] if len(found) == 1 else np.concatenate(found)


def _writer(directory: str, name: str, end_id: int, seq_len: int):
    @released
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, out, first, last = encoder(name), None, None, None
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if out is None:
                    out, first = ShardWriter(directory, TaskContext.get().partitionId(), encode.dtype, seq_len), doc_id
                out.add(doc_id, encode(text.as_py() or "") + end)
                last = doc_id
        if out is not None:
            out.close()
            row = {"path": out.name, "first_doc": first, "last_doc": last, "n_docs": len(out.docs[0]), "n_tokens": out.total, "shard": TaskContext.get().partitionId()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.int64())]))

    return write


def _disjoint(ranges: DataFrame) -> bool:
    """Whether rows (low, high, empty) are disjoint ranges without nulls; one row per partition."""
    after = F.lead("low").over(W.orderBy("low", "high"))
    return ranges.withColumn("next", after).where("nulls > 0 or high >= next").isEmpty()


def write_tokens(docs: DataFrame, directory: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write docs to Arrow files in `directory`; returns the manifest, one row per shard with `start`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id", F.spark_partition_id().alias("pid"))
    ranges = ids.groupBy("pid").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    write = _writer(directory, tokenizer, end_id, seq_len)
    schema = "path string, first_doc long, last_doc long, n_docs long, n_tokens long, shard long"
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    manifest = None
    if _disjoint(ranges):
        manifest = materialize(rows.sortWithinPartitions("doc_id", hashed).mapInArrow(write, schema), "manifest")
        written = manifest.select(F.col("first_doc").alias("low"), F.col("last_doc").alias("high"), F.lit(0).alias("nulls"))
        if not _disjoint(written):
            manifest = None
    if manifest is None:
        dealt = rows.withColumn("text_hash", hashed).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
        manifest = materialize(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash").drop("text_hash").mapInArrow(write, schema), "manifest")
    before = W.orderBy(F.col("first_doc").asc_nulls_first(), F.col("last_doc").asc_nulls_first(), "shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            file = TokenFile(shard["path"])
            crcs = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in file.documents()), np.int64, len(file.index))
            starts = file.index["start"].to_numpy() + shard["start"]
            for i in range(0, len(crcs), 10_000):
                part = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([file.index["doc_id"].combine_chunks()[part], pa.array(starts[part]), file.index["n_tokens"].combine_chunks()[part], pa.array(crcs[part])], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest; a task per shard or few."""
    shards = manifest.select("path", "start", "shard")
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    manifest = write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer)
    return read_documents(materialize(manifest, "manifest"))


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    return token_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
