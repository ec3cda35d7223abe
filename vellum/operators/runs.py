"""Folds of job events into run tables; every state rule is a plain aggregate or window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import EVENT_STATUS, TERMINAL


def run_events(events: DataFrame) -> DataFrame:
    """process_id, seq, ts, status, value of the sample event table."""
    status = F.create_map(*(F.lit(x) for kv in EVENT_STATUS.items() for x in kv))[F.col("event_type")]
    return events.select(F.col("user_id").alias("process_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), "value")


def terminal_state(rows: DataFrame) -> DataFrame:
    """process_id, status, n_events: the first terminal state wins, else the last state (by ts, seq)."""
    at = F.struct("ts", "seq")
    first = F.min_by("status", F.when(F.col("status").isin(*TERMINAL), at))
    per = rows.groupBy("process_id").agg(first.alias("first_terminal"), F.max_by("status", at).alias("last"), F.count("*").alias("n_events"))
    return per.select("process_id", F.coalesce("first_terminal", "last").alias("status"), F.col("first_terminal").isNotNull().alias("terminal"), "n_events")


def latest_values(rows: DataFrame) -> DataFrame:
    """process_id and the latest non-null value, first and last time: an upsert that skips nulls."""
    at = F.struct("ts", "seq")
    return rows.groupBy("process_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("latest_value"))


def list_page(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Latest runs first, those without a start before all; the page is the feature."""
    return runs.orderBy(F.desc_nulls_first("started_at"), F.asc("process_id")).offset(offset).limit(limit)


def islands(rows: DataFrame, flag: str) -> DataFrame:
    """process_id, value, since, until, n: contiguous stretches of one value of `flag`."""
    order = Window.partitionBy("process_id").orderBy("ts", "seq")
    steps = rows.withColumn("before", F.lag(flag).over(order))
    steps = steps.withColumn("fresh", F.when(F.col("before").isNull() | (F.col("before") != F.col(flag)), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy("process_id", "island", F.col(flag).alias("value")).agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("n"))


def sessions(rows: DataFrame, gap_seconds: int) -> DataFrame:
    """process_id, since, until, n: stretches without a pause of gap_seconds or more."""
    order = Window.partitionBy("process_id").orderBy("ts", "seq")
    steps = rows.withColumn("before", F.lag("ts").over(order))
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    steps = steps.withColumn("island", F.sum(F.when(F.col("before").isNull() | (pause >= gap_seconds * 1_000_000), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy("process_id", "island").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("n")).drop("island")


def consecutive_failures(rows: DataFrame, status: str = "failed") -> DataFrame:
    """process_id, longest: the longest row of one status without another between."""
    runs = islands(rows, "status").where(F.col("value") == status)
    return runs.groupBy("process_id").agg(F.max("n").alias("longest"))


def claims(operations: DataFrame, stale_seconds: int = 120) -> DataFrame:
    """process_id, claims, reclaims: a claim succeeds first, and again once the one before it is stale.

    Here a claim is stale if the operation before it is older than stale_seconds.
    """
    order = Window.partitionBy("process_id").orderBy("ts", "seq")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    steps = operations.withColumn("pause", pause)
    return steps.groupBy("process_id").agg(F.count_if(F.col("pause").isNull()).alias("claims"), F.count_if(F.col("pause") >= stale_seconds * 1_000_000).alias("reclaims"))


def progress(rows: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """process_id, completed, pending, percent over a fixed list of stages."""
    done = rows.where(F.col("status").isin(*stages)).groupBy("process_id").agg(F.array_sort(F.collect_set("status")).alias("done"))
    every = F.array(*(F.lit(s) for s in stages))
    percent = F.bround(F.size("done") * 100.0 / len(stages), 0).cast("long")
    return done.select("process_id", F.array_join("done", ",").alias("completed"), F.array_join(F.array_sort(F.array_except(every, "done")), ",").alias("pending"), percent.alias("percent"))
