"""Event streams: sessions, deliveries once, and first-terminal-wins run state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import EVENT_STATUS, TERMINAL


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The event table as a stream of Parquet files; times as TIMESTAMP, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    status = F.create_map(*(F.lit(x) for kv in EVENT_STATUS.items() for x in kv))[F.col("event_type")]
    return raw.select(F.col("user_id").alias("process_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """process_id, since, until, n of sessions that a pause of `gap` has closed."""
    window = F.session_window("ts", gap).alias("w")
    closed = events.withWatermark("ts", late).groupBy("process_id", window).agg(F.count("*").alias("n"), F.max("ts").alias("until"))
    return closed.select("process_id", F.col("w.start").alias("since"), "until", "n")


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """since, status, n of tumbling or sliding windows."""
    window = F.window("ts", size, slide).alias("w") if slide else F.window("ts", size).alias("w")
    return events.withWatermark("ts", late).groupBy(window, "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "status", "n")


def deliveries_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (process, sequence number) once, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["process_id", "seq"])


def run_states(events: DataFrame) -> DataFrame:
    """process_id, status, terminal, n_events after each trigger: the first terminal state stays.

    Within a trigger events are taken by (ts, seq); across triggers in order of arrival.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, terminal, n = state.get if state.exists else (None, False, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        for s in rows["status"]:
            n += 1
            if not terminal:
                status, terminal = s, s in TERMINAL
        state.update((status, terminal, n))
        yield pd.DataFrame({"process_id": [key[0]], "status": [status], "terminal": [terminal], "n_events": [n]})

    return events.groupBy("process_id").applyInPandasWithState(
        fold, "process_id long, status string, terminal boolean, n_events long", "status string, terminal boolean, n_events long", "update", "NoTimeout"
    )
