"""Documents and consolidation as streams: ingest that counts each batch once, and the gate that says which corpora are due."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from loomspark.plans.engine import Memory

LEAST = 20


def ingest(memory: Memory, rows: DataFrame, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Start to ingest a stream of rows (as Memory.add takes them). The commit that adds a batch carries the stream's name
    and the batch's number, so a batch that is given again after a restart finds its commit and adds nothing; one that
    failed before its commit left nothing that a reader sees. trigger as of writeStream.trigger."""

    def one(batch: DataFrame, number: int) -> None:
        memory.add(batch, batch=(name, number)).count()

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def due_corpora(documents: DataFrame, least: int = LEAST, quiet_ms: int = 0) -> DataFrame:
    """(corpus, docs, last_doc_count) each time a corpus of a stream of documents (corpus, ...) falls due: with `least`
    documents and as many more than at its last cycle, which counts as run then. The state is two numbers a corpus. With
    quiet_ms a timer says so, that long after the corpus's last row, so that a run of small batches gives one cycle."""
    columns = ["corpus", "docs", "last_doc_count"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        docs, last = state.get if state.exists else (0, 0)
        docs += sum(len(part) for part in batches)
        ask = state.hasTimedOut or not quiet_ms
        due = ask and docs >= least and docs - last >= least
        state.update((docs, docs if due else last))
        if not ask:
            state.setTimeoutDuration(quiet_ms)
        if due:
            yield pd.DataFrame([(key[0], docs, last)], columns=columns)

    timer = "ProcessingTimeTimeout" if quiet_ms else "NoTimeout"
    return documents.select("corpus").groupBy("corpus").applyInPandasWithState(run, "corpus string, docs long, last_doc_count long", "docs long, last long", "append", timer)
