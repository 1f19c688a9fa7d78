"""Streaming twins: access counters, windows with late data, and the circuit breaker as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILURES, COOLDOWN_S = 3, 60


def with_time(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def access_counters(events: DataFrame) -> DataFrame:
    """(doc_id, agent_id, access_count, last_accessed); update mode keeps the table current."""
    return events.groupBy("doc_id", "agent_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = with_time(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    rows = with_time(events, late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = with_time(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def breaker_steps(state: tuple[int, float], at: float, ok: bool, failures: int = FAILURES, cooldown: float = COOLDOWN_S) -> tuple[tuple[int, float], str]:
    """One call's outcome on a breaker of state (failures in a row, time it opened or 0): new state and what the call
    met: `closed`, `half_open`, or `open` if it was refused."""
    count, opened = state
    if opened and at - opened < cooldown:
        return state, "open"
    met = "half_open" if opened else "closed"
    if ok:
        return (0, 0.0), met
    count += 1
    return ((count, at) if opened or count >= failures else (count, 0.0)), met


def breaker(calls: DataFrame, failures: int = FAILURES, cooldown: float = COOLDOWN_S, streaming: bool = True) -> DataFrame:
    """(service, at, ok, met) for calls (service, at, ok), each service's calls in the order of time."""
    schema = "service string, at timestamp, ok boolean, met string"

    def walk(rows: pd.DataFrame, state: tuple[int, float]) -> tuple[list[str], tuple[int, float]]:
        met = []
        for at, ok in zip(rows["at"], rows["ok"]):
            state, how = breaker_steps(state, at.timestamp(), bool(ok), failures, cooldown)
            met.append(how)
        return met, state

    def sorted_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Services one after another in the order of time; only a service's state is carried from batch to batch."""
        service, state = None, (0, 0.0)
        for rows in batches:
            for name, part in rows.groupby("service", sort=False, dropna=False):
                if name != service:
                    service, state = name, (0, 0.0)
                met, state = walk(part, state)
                yield part.assign(met=met)[["service", "at", "ok", "met"]]

    if not streaming:
        return calls.select("service", "at", "ok").repartition("service").sortWithinPartitions("service", "at", "ok").mapInPandas(sorted_batches, schema)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "ok"])
        met, held = walk(rows, (int(held[0]), float(held[1])))
        state.update(held)
        yield rows.assign(service=key[0], met=met)[["service", "at", "ok", "met"]]

    return calls.groupBy("service").applyInPandasWithState(run, schema, "failures long, opened double", "append", "NoTimeout")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, as a table in the driver's memory sink; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
