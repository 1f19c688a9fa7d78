"""Embedding providers: any function of a list of texts to a list of vectors, called in batches inside tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.streaming.access import breaker_steps

BATCH = 64
#: What models of a family want before a query and a document (fixed values).
PREFIXES = {"nomic": ("search_query: ", "search_document: "), "e5": ("query: ", "passage: ")}


def prefix(model: str, query: bool) -> str:
    """The task prefix of a model's family, empty if it has none."""
    return next((p[0 if query else 1] for family, p in PREFIXES.items() if family in model.lower()), "")


def embed_with(provider: Callable[[list[str]], list], text: str | Column, batch: int = BATCH, lead: str = "") -> Column:
    """Vectors of texts by provider; null for null texts, for batches that fail, and while a task's breaker is open."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state: tuple[int, float] = (0, 0.0)
        for series in batches:
            out = pd.Series([None] * len(series), index=series.index, dtype=object)
            asked = series.dropna()
            for i in range(0, len(asked), batch):
                part = asked.iloc[i : i + batch]
                now = time.time()
                if breaker_steps(state, now, True)[1] == "open":
                    continue
                try:
                    for at, vector in zip(part.index, provider([lead + t for t in part]), strict=True):
                        out[at] = vector
                    ok = True
                except Exception:  # a provider may fail in any way; its batch stays null
                    ok = False
                state, _ = breaker_steps(state, now, ok)
            yield out

    return F.pandas_udf(run, "array<float>")(text)
