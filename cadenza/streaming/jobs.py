"""Stateful stream operators: a job registry with bounded admission and expiry, and watermarked blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(running: list[tuple[float, int]], at: float, seconds: float, job: int, slots: int, ttl: float) -> tuple[list[tuple[float, int]], str]:
    """Running jobs (end, id) after a submission at ``at``, and what became of it: admitted, or rejected with all slots taken."""
    running = [(e, j) for e, j in running if e > at]
    if len(running) >= slots:
        return running, "rejected"
    return sorted([*running, (at + min(seconds * 60, ttl), job)]), "admitted"


def replay_jobs(jobs: DataFrame, slots: int, ttl: float) -> DataFrame:
    """(user_id, id, outcome) of submissions (user_id, id, at, seconds) in order of time, per user, as a batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, running = [], []
        for r in pdf.sort_values(["at", "id"]).itertuples():
            running, what = step(running, r.at, r.seconds, r.id, slots, ttl)
            out.append((r.user_id, r.id, what))
        return pd.DataFrame(out, columns=["user_id", "id", "outcome"])

    return jobs.groupBy("user_id").applyInPandas(run, "user_id bigint, id bigint, outcome string")


def stream_jobs(jobs: DataFrame, slots: int = 8, ttl: float = 3600.0) -> DataFrame:
    """The same over a stream: running jobs are kept per user until they expire by processing time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        running = [(e, j) for e, j in zip(*state.get)] if state.exists else []
        out = []
        for pdf in batches:
            for r in pdf.sort_values(["at", "id"]).itertuples():
                running, what = step(running, r.at, r.seconds, r.id, slots, ttl)
                out.append((key[0], r.id, what))
        state.update(([e for e, _ in running], [j for _, j in running]))
        state.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame(out, columns=["user_id", "id", "outcome"])

    return jobs.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, id bigint, outcome string", "ends array<double>, ids array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_blocks(events: DataFrame, at: str, by: str, value: str, length: str = "4 seconds", late: str = "10 minutes", full: int | None = None) -> DataFrame:
    """Tumbling blocks with a watermark; with ``full``, only blocks of that many rows (a partial block is dropped, never padded)."""
    x = events.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    x = x.select(F.col("window.start").alias("start"), by, "n", "total")
    return x if full is None else x.where(F.col("n") == full)


def stream_latest(log: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeated deliveries of an append log dropped within the watermark."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
