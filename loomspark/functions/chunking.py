"""Chunkers: column functions for code outlines and sentence windows, a small packer for plain text."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.text import cosine, language_of
from loomspark.session import fence

CAPACITY = 1024
#: Boundaries at which text may be cut, the strongest first.
BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))
HEADING = re.compile(r"\n(?=#{1,6} )")

NAME = "[\\p{L}\\p{N}_]+"
#: Words that open a declaration, per language; the declared name follows.
OPENERS = {
    "c": "enum struct union",
    "cpp": "class enum namespace struct union",
    "go": "func type",
    "java": "class enum interface record",
    "javascript": "class function",
    "python": "class def",
    "ruby": "class def module",
    "rust": "enum fn impl macro_rules mod struct trait union",
    "typescript": "class enum function interface namespace type",
}
#: Words that may stand before an opener or a signature.
MODIFIERS = "abstract async const constexpr default export extern final inline override private protected pub public sealed static typedef unsafe virtual"
#: Openers that are called otherwise as kinds, languages that follow another's rules, and those whose functions have no opener.
CALLED = {"func": "fn", "function": "fn"}
SAME_AS = {"tsx": "typescript"}
BY_SIGNATURE = {"c": "fn", "cpp": "fn", "java": "method"}
#: Words that begin statements, which look like signatures otherwise.
STATEMENTS = "case delete else goto if new return switch throw while for"


Measure = Callable[[str], int]


#: A text up to the end of a word that ASCII white space follows: byte-level pre-tokens never reach over such a place.
PIECE = re.compile(r"\s*\S+(?:(?![ \t\r\n])\s+\S+)*|\s+")
PLAIN_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")  # the same of ASCII
#: Pieces of at most SHORT characters are counted once; a worker keeps KEPT of them.
SHORT, KEPT = 48, 200_000


def _by_pieces(tokenizer: str) -> bool:
    """Whether a tokenizer's file says that tokens don't depend on the text beyond a piece."""
    spec = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
    split = spec.get("pre_tokenizer") or {}
    whole = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    added = [t for t in spec.get("added_tokens") or [] if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
    return bool(whole and not added and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


class TokenMeasure:
    """Lengths in tokens of a public tokenizer's file; each worker loads it once. Where tokens don't reach over the
    white space between words, a text's length is the sum of its pieces', and pieces come again and again."""

    def __init__(self, tokenizer: str):
        self.path, self.loaded, self.pieces = tokenizer, None, False
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return {"path": self.path, "loaded": None, "pieces": False, "known": {}}

    def counted(self, piece: str) -> int:
        n = len(self.loaded.encode(piece, add_special_tokens=False))
        if len(piece) <= SHORT:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[piece] = n
        return n

    def __call__(self, text: str) -> int:
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded, self.pieces = Tokenizer.from_file(self.path), _by_pieces(self.path)
        if not self.pieces:
            return len(self.loaded.encode(text, add_special_tokens=False))
        known, total = self.known, 0
        for piece in (PLAIN_PIECE if text.isascii() else PIECE).findall(text):
            n = known.get(piece)
            total += self.counted(piece) if n is None else n
        return total

    def prefixes(self, text: str) -> Callable[[int], int]:
        """The length of a text's first n characters as a function of n, which counts each piece of the text once."""
        self("")
        if not self.pieces:
            return lambda n: self(text[:n])
        ends, sums = [0], [0]
        counted = lambda piece: self.counted(piece) if (n := self.known.get(piece)) is None else n
        rest = (PLAIN_PIECE if text.isascii() else PIECE).finditer(text)

        def first(n: int) -> int:
            while ends[-1] < n:
                piece = next(rest)
                ends.append(piece.end())
                sums.append(sums[-1] + counted(piece[0]))
            i = bisect_right(ends, n) - 1
            return sums[i] + (counted(text[ends[i] : n]) if ends[i] < n else 0)

        return first


def token_measure(tokenizer: str) -> Measure:
    return TokenMeasure(tokenizer)


def _fitting(text: str, capacity: int, measure: Measure) -> int:
    """The longest prefix of text, in characters, whose measure is within capacity (one character at least)."""
    first = measure.prefixes(text) if isinstance(measure, TokenMeasure) else lambda n: measure(text[:n])
    low, high = 1, min(len(text), max(2, capacity))
    while high < len(text) and first(high) <= capacity:  # so that a long text isn't measured whole
        low, high = high, min(len(text), 2 * high)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if first(middle) <= capacity else (low, middle - 1)
    return low


def split_text(text: str, capacity: int = CAPACITY, headings: bool = False, measure: Measure = len) -> list[str]:
    """Chunks of at most `capacity` characters, or whatever measure counts, cut at the strongest boundary that fits; a
    longer word is cut hard."""
    if headings:
        return [c for part in HEADING.split(text) for c in split_text(part, capacity, measure=measure)]
    text = text.strip()
    out = []
    while text:
        fit = _fitting(text, capacity, measure)
        if fit == len(text):
            break
        window = text[: fit + 1]
        at = next((m[-1] for b in BREAKS if (m := [x.start() for x in b.finditer(window) if x.start() > 0])), fit)
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def chunk_text(docs: DataFrame, capacity: int = CAPACITY, headings: bool = False, measure: Measure = len) -> DataFrame:
    """(doc_id, chunk_no, body) of docs (doc_id, body); null or blank bodies have no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [split_text(b or "", capacity, headings, measure) for b in pdf.body]
            n = [len(p) for p in parts]
            yield pd.DataFrame({"doc_id": pdf.doc_id.repeat(n).to_numpy(), "chunk_no": pd.Series([i for k in n for i in range(k)], dtype="int64"), "body": pd.Series([c for p in parts for c in p], dtype=object)})

    return docs.select("doc_id", "body").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_no long, body string")


def symbol_of(line: str | Column, language: str) -> Column:
    """struct(kind, name) of the declaration that a line begins, null if it begins none."""
    rules = SAME_AS.get(language, language)
    lead = f"^\\s*(?:(?:{'|'.join(MODIFIERS.split())})(?:\\([^)]*\\))?\\s+){{0,6}}"
    opened = f"{lead}({'|'.join(OPENERS[rules].split())})\\b!?(?:<[^>]*>)?\\s+(?:\\([^)]*\\)\\s*)?(?:self[.])?({NAME}(?:\\s+for\\s+{NAME})?)"
    table = F.create_map(*[F.lit(x) for pair in CALLED.items() for x in pair])

    def opening(word: Column) -> Column:
        kind = F.coalesce(F.try_element_at(table, word), word)
        if rules == "go":  # the kind of a named type stands after its name
            kind = F.coalesce(F.nullif(F.regexp_extract(line, "^\\s*type\\s+\\w+\\s+(struct|interface)\\b", 1), F.lit("")), kind)
        return F.when(word != "", F.struct(kind.alias("kind"), F.regexp_extract(line, opened, 2).alias("name")))

    # The word is looked for once and used by name.
    found = F.get(F.transform(F.array(F.regexp_extract(line, opened, 1)), opening), F.lit(0))
    other = None
    if rules in ("javascript", "typescript"):
        other = "fn", F.regexp_extract(line, f"{lead}(?:let|var)?\\s*(\\w+)\\s*=\\s*(?:async\\s*)?(?:function\\b|\\([^=]*=>|\\w+\\s*=>|\\([^)]*$)", 1)
    elif rules in BY_SIGNATURE:
        signed = F.regexp_extract(line, "^\\s*(?:[A-Za-z_][\\w<>\\[\\],.:]*[\\s*&]+){1,6}([A-Za-z_][\\w:~]*)\\s*\\([^;]*$", 1)
        other = BY_SIGNATURE[rules], F.when(F.regexp_extract(line, "^\\s*(\\w+)", 1).isin(*STATEMENTS.split()), "").otherwise(signed)
    return found if other is None else F.coalesce(found, F.when(other[1] != "", F.struct(F.lit(other[0]).alias("kind"), other[1].alias("name"))))


def _symbols(files: DataFrame) -> DataFrame:
    """(path, lines, symbols) of files in a known language: symbols is an array of struct(line_no, depth, s, text), a line that
    begins a symbol each. A file's lines stay in its row: no line is shuffled."""
    known = fence(files.select("path", "body"), language=language_of("path")).where("language is not null and body is not null")
    known = fence(known.select("path", "language", "body"), lines=F.split("body", "\r?\n")).select("path", "language", "lines")

    def symbol(text: Column, at: Column) -> Column:
        found = F.lit(None).cast("struct<kind:string,name:string>")
        for language in sorted({*OPENERS, *SAME_AS}):
            found = F.when(F.col("language") == language, symbol_of(text, language)).otherwise(found)
        return F.struct((at + 1).cast("long").alias("line_no"), found.alias("s"), text.alias("text"))

    def placed(x: Column) -> Column:
        indent = F.regexp_extract(x["text"], "^(\\s*)", 1)
        tabs, width = F.length(F.regexp_replace(indent, "[^\t]", "")), F.floor(F.length(indent) / 4)
        depth = F.when(F.contains(indent, F.lit("\t")), tabs).otherwise(width).cast("long")
        return F.struct(x["line_no"].alias("line_no"), depth.alias("depth"), x["s"].alias("s"), x["text"].alias("text"))

    symbols = F.transform(F.filter(F.transform("lines", symbol), lambda x: x["s"].isNotNull()), placed)
    return fence(known, symbols=symbols).select("path", "lines", "symbols")


def outline(files: DataFrame) -> DataFrame:
    """(path, line_no, depth, kind, name, text) of every line that begins a symbol; files has (path, body)."""
    return _symbols(files).select("path", F.inline("symbols")).select("path", "line_no", "depth", "s.kind", "s.name", "text")


def symbol_chunks(files: DataFrame) -> DataFrame:
    """(path, line_no, end_line, header, body): a chunk per symbol, to the line before the next of depth no greater.

    For each depth of a file, the symbols of at most that depth in order: the next of these closes one of just that depth."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = fence(_symbols(files), name=name, depths=F.array_distinct(F.transform("symbols", lambda x: x["depth"])))

    def chunk(x: Column, after: Column) -> Column:
        end = F.coalesce(after["line_no"] - 1, F.size("lines").cast("long"))
        header = F.concat(F.lit("# "), x["s"]["kind"], F.lit(" "), x["s"]["name"], F.lit(" ("), "name", F.lit(":"), x["line_no"].cast("string"), F.lit(")"))
        # By places: slice() in a lambda copies the whole array for each symbol.
        body = F.array_join(F.transform(F.sequence(x["line_no"], end), lambda i: F.get("lines", (i - 1).cast("int"))), "\n")
        return F.struct(x["line_no"].alias("line_no"), end.alias("end_line"), header.alias("header"), body.alias("body"))

    def closed(depth: Column) -> Column:
        upper = F.filter("symbols", lambda x: x["depth"] <= depth)
        pairs = lambda u: F.filter(F.transform(u, lambda x, i: F.struct(x.alias("x"), F.get(u, i + 1).alias("after"))), lambda p: p["x"]["depth"] == depth)
        return F.transform(F.get(F.transform(F.array(upper), pairs), F.lit(0)), lambda p: chunk(p["x"], p["after"]))

    return rows.select("path", F.inline(F.flatten(F.transform("depths", closed))))


def semantic_chunks(sentences: DataFrame, threshold: float = 0.5, joiner: str = " ", window: int = 3, size: int = 2048) -> DataFrame:
    """(doc_id, chunk_no, body) of sentences (doc_id, pos, body, vec): a chunk ends where a sentence's cosine to the mean of
    up to `window` before it falls below threshold, and where it would pass another multiple of `size` characters."""
    order = W.partitionBy("doc_id").orderBy("pos")
    before = F.collect_list("vec").over(order.rowsBetween(-window, -1))
    mean = F.aggregate(F.slice("before", 2, window), F.get("before", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    rows = sentences.withColumn("before", before).withColumn("mean", F.when(F.size("before") > 0, mean))
    rows = rows.withColumn("cut", F.when(F.col("mean").isNotNull() & (cosine("vec", "mean") < threshold), 1).otherwise(0))
    rows = rows.withColumn("topic", F.sum("cut").over(order))
    within = W.partitionBy("doc_id", "topic").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.floor(F.coalesce(F.sum(F.length("body") + len(joiner)).over(within), F.lit(0)) / size))
    rows = rows.withColumn("chunk_no", F.dense_rank().over(W.partitionBy("doc_id").orderBy("topic", "part")) - 1)
    return rows.groupBy("doc_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"]), joiner).alias("body"))


def sentences(text: str | Column) -> Column:
    """Sentences of a text, cut after . ! ? before white space."""
    return F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.trim(s) != "")


def chunk_files(files: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(path, chunk_no, body) of files (path, body) by their extension: code by symbols, or as text of twice the
    capacity where it has none; Markdown by headings; the rest as text."""
    kind = F.when(language_of("path").isNotNull(), "code").when(F.lower("path").rlike("[.](md|markdown)$"), "markdown").otherwise("text")
    rows = files.select("path", "body", kind.alias("kind"))
    code = rows.where("kind = 'code'").select("path", "body")
    symbols = symbol_chunks(code).where(F.trim("body") != "")
    numbered = symbols.select("path", (F.row_number().over(W.partitionBy("path").orderBy("line_no")) - 1).cast("long").alias("chunk_no"), F.concat("header", F.lit("\n"), "body").alias("body"))
    plain = lambda df, size, headings: chunk_text(df.select(F.col("path").alias("doc_id"), "body"), size, headings).withColumnRenamed("doc_id", "path")
    bare = code.join(symbols.select("path").distinct(), "path", "left_anti")
    parts = numbered.unionByName(plain(bare, 2 * capacity, False))
    return parts.unionByName(plain(rows.where("kind = 'markdown'"), capacity, True)).unionByName(plain(rows.where("kind = 'text'"), capacity, False))
