"""Markdown in chunks of a token budget, as a table function: blocks under their headings, whole fences, lists and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.chunking import Measure, split_text, token_measure

BUDGET = 256
HEAD, FENCE = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$"), re.compile(r" {0,3}(`{3,}|~{3,})")
ITEM, ROW = re.compile(r" {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]+|$)"), re.compile(r"[ \t]*\|")
CHUNK = "chunk_no long, path string, first long, last long, tokens long, body string"


@dataclass(frozen=True)
class Block:
    """Text from start to end (exclusive) of a kind: heading, fence, list, table or text; path holds the headings above it."""

    kind: str
    path: tuple[str, ...]
    start: int
    end: int


def blocks(text: str) -> Iterator[Block]:
    """Blocks in order; blank lines between them belong to none. A fence that nothing closes reaches to the end."""
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    path: list[tuple[int, str]] = []
    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r\n")
        if not line.strip():
            i += 1
            continue
        first, names = i, tuple(name for _, name in path)
        if head := HEAD.match(line):
            level = len(head[1])
            path = [p for p in path if p[0] < level] + [(level, (head[2] or "").strip())]
            kind, i, names = "heading", i + 1, tuple(name for _, name in path)
        elif fence := FENCE.match(line):
            mark = fence[1]
            kind, i = "fence", i + 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i].rstrip("\r\n")):
                i += 1
            i = min(i + 1, len(lines))
        elif ITEM.match(line):
            kind, i = "list", i + 1
            while i < len(lines):
                next_ = i
                while next_ < len(lines) and not lines[next_].strip():
                    next_ += 1
                after = lines[next_].rstrip("\r\n") if next_ < len(lines) else ""
                if HEAD.match(after) or (next_ > i and not (ITEM.match(after) or after.startswith(("  ", "\t")))):
                    break
                i = next_ + 1
        else:
            kind = "table" if ROW.match(line) else "text"
            same = (lambda x: ROW.match(x)) if kind == "table" else (lambda x: x.strip() and not (HEAD.match(x) or FENCE.match(x) or ITEM.match(x) or ROW.match(x)))
            i += 1
            while i < len(lines) and same(lines[i].rstrip("\r\n")):
                i += 1
        yield Block(kind, names, starts[first], starts[i])


def chunks(text: str | None, budget: int, measure: Measure) -> Iterator[tuple[str, int, int, int, str]]:
    """(path, first, last, tokens, body): blocks packed one after another as long as they stay under one heading and within
    the budget. A heading stays with what follows it. Text over the budget is split at sentences and words; a fence, list or
    table over it is a chunk of its own."""
    held: list[Block] = []

    def made(part: list[Block]) -> tuple[str, int, int, int, str]:
        body = text[part[0].start : part[-1].end].rstrip()
        return " > ".join(part[-1].path), part[0].start, part[0].start + len(body), measure(body), body

    for block in blocks(text or ""):
        apart = held and block.kind == "heading" and held[-1].kind != "heading"
        if held and (apart or measure(text[held[0].start : block.end].rstrip()) > budget):
            yield made(held)
            held = []
        body = text[block.start : block.end].rstrip()
        if block.kind == "text" and not held and measure(body) > budget:
            at = block.start
            for part in split_text(body, budget, measure=measure):
                at = text.index(part, at)
                yield " > ".join(block.path), at, at + len(part), measure(part), part
                at += len(part)
            continue
        held.append(block)
    if held:
        yield made(held)


def chunk_function(tokenizer: str | None = None):
    """A table function of (body, budget) with the columns of CHUNK; lengths are tokens of a tokenizer's file, or characters
    without one."""
    measure: Measure = token_measure(tokenizer) if tokenizer else len

    @F.udtf(returnType=CHUNK)
    class MarkdownChunks:
        def eval(self, body: str, budget: int) -> Iterator[tuple]:
            for number, (path, first, last, tokens, part) in enumerate(chunks(body, budget, measure)):
                yield number, path, first, last, tokens, part

    return MarkdownChunks


def chunk_markdown(docs: DataFrame, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """docs (with body) joined laterally with their chunks, in place of body; null or blank bodies have none. As SQL:
    `SELECT d.doc_id, c.* FROM docs d, LATERAL chunks(d.body, 256) c` once chunk_function() is registered."""
    made = chunk_function(tokenizer)
    rows = docs.withColumnRenamed("body", "__body")
    return rows.lateralJoin(made(F.col("__body").outer(), F.lit(budget))).drop("__body")
