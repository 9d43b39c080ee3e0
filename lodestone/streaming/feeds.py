"""Streams: change feeds, logs whose last line counts, job files, and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("staged", "failed")


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        out = []
        for frame in rows:
            for seq, payload in zip(*(frame.sort_values("seq")[c] for c in ("seq", "payload"))):
                if payload != known:
                    out.append((key[0], int(seq), payload))
                    known = payload
        if out:
            self.last.update((known,))
        yield pd.DataFrame(out, columns=["job_id", "seq", "payload"])

    def close(self) -> None:
        pass


def change_feed(updates: DataFrame) -> DataFrame:
    """T-01: (job_id, seq, payload) of a stream, those only that differ from the job's last payload."""
    return updates.groupBy("job_id").transformWithStateInPandas(_Changes(), "job_id string, seq long, payload string", "append", "none")


def deduplicated(log: DataFrame, keys: list[str], event_time: str, keep_for: str = "1 day") -> DataFrame:
    """T-04, T-05, T-07: the first line of each key within a time; state older than that goes."""
    return log.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(keys)


def run_jobs(files: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """T-02, T-03: handle each batch of new job files once; a retry is a new file."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()


def job_states(checks: DataFrame) -> DataFrame:
    """T-02: terminal state of jobs from their files' checks (job_id, reason)."""
    bad = F.sum(F.col("reason").isNotNull().cast("long"))
    out = checks.groupBy("job_id").agg(F.count("*").alias("file_count"), bad.alias("failure_count"))
    return out.withColumn("status", F.when(F.col("failure_count") > 0, TERMINAL[1]).otherwise(TERMINAL[0])).withColumn("progress", F.lit(100))


def tumbling(events: DataFrame, size: str, late: str | None = None, *keys: str) -> DataFrame:
    """Windows of one size; beyond the reference, for streams with late rows."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions that end after a gap; beyond the reference."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
