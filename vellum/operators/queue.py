"""Queues, leases and phases as folds over operation logs; batch twins of the streaming states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASES = "job_id string, seq long, owner string, op string, granted boolean, holder string, expires_at long"


def _lease_step(state: tuple[str | None, int, int], op: str, owner: str, at: int, ttl: int, etag: int | None) -> tuple[bool, tuple[str | None, int, int]]:
    """(granted, state) of one operation; a state is (holder, expiry, etag)."""
    holder, expires, version = state
    if op == "claim":
        if holder is None or expires <= at:
            return True, (owner, at + max(1, ttl), version + 1)
        return False, state
    if op in ("release", "ack") and holder == owner and (etag is None or etag == version):
        return True, (None, 0, version + 1)
    return False, state


def leases(operations: DataFrame) -> DataFrame:
    """Whether each operation (job_id, seq, at, owner, op, ttl, etag) was granted, and who holds the lease after it.

    A claim succeeds on a free or expired lease; a release or acknowledgement needs the holder and its etag.
    """

    def kernel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state, rows = (None, 0, 0), []
        for r in frame.sort_values(["at", "seq"]).itertuples():
            granted, state = _lease_step(state, r.op, r.owner, int(r.at), int(r.ttl), None if pd.isna(r.etag) else int(r.etag))
            rows.append((key[0], r.seq, r.owner, r.op, granted, state[0], state[1]))
        return pd.DataFrame(rows, columns=["job_id", "seq", "owner", "op", "granted", "holder", "expires_at"])

    return operations.groupBy("job_id").applyInPandas(kernel, LEASES)


def lease_stream(operations: DataFrame) -> DataFrame:
    """The same over a stream; the state of a job is its holder, expiry and version."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, rows = (state.get if state.exists else (None, 0, 0)), []
        for r in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
            granted, held = _lease_step(tuple(held), r.op, r.owner, int(r.at), int(r.ttl), None if pd.isna(r.etag) else int(r.etag))
            rows.append((key[0], r.seq, r.owner, r.op, granted, held[0], held[1]))
        state.update(held)
        yield pd.DataFrame(rows, columns=["job_id", "seq", "owner", "op", "granted", "holder", "expires_at"])

    return operations.groupBy("job_id").applyInPandasWithState(fold, LEASES, "holder string, expires_at long, version long", "append", "NoTimeout")


def phases(records: DataFrame, queued: DataFrame, claims: DataFrame) -> DataFrame:
    """job_id, phase: the durable record if there is one (accepted never overwrites another), else claimed, else queued."""
    at = F.struct("at", "seq")
    fixed = records.groupBy("job_id").agg(F.max_by("phase", F.when(F.col("phase") != "accepted", at)).alias("strong"), F.max_by("phase", at).alias("any"))
    jobs = queued.select("job_id").union(claims.select("job_id")).union(records.select("job_id")).distinct()
    rows = jobs.join(fixed, "job_id", "left").join(queued.select("job_id", F.lit(True).alias("q")).distinct(), "job_id", "left").join(claims.select("job_id", F.lit(True).alias("c")).distinct(), "job_id", "left")
    phase = F.coalesce("strong", "any", F.when(F.col("q") & F.col("c"), "claimed"), F.when(F.col("q"), "queued"))
    return rows.select("job_id", phase.alias("phase"))


def oldest_first(jobs: DataFrame, capacity: int) -> DataFrame:
    """job_id, place, accepted: first in, first out by (queued_at, job_id); beyond capacity a job is refused.

    queued_at is a time or seconds; without one a job comes first. Places are counted within days, and the days' own
    counts are added up, so that no task sorts more than a day.
    """
    timed = "timestamp" in jobs.schema["queued_at"].dataType.simpleString()
    day = F.unix_date(F.to_date("queued_at")) if timed else F.floor(F.col("queued_at") / 86_400)
    dated = jobs.select("job_id", "queued_at", F.coalesce(day.cast("long"), F.lit(-(1 << 62))).alias("day"))
    # a row for each day
    days = dated.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    own = F.row_number().over(Window.partitionBy("day").orderBy("queued_at", "job_id"))
    placed = dated.withColumn("own", own).join(days, "day").withColumn("place", F.col("own") + F.coalesce("before", F.lit(0)))
    return placed.select("job_id", "place", (F.col("place") <= capacity).alias("accepted"))


def expired(records: DataFrame, now: int, retention: int) -> DataFrame:
    """Terminal records older than the retention, oldest first."""
    return records.where((F.col("recorded_at") <= now - retention) & F.col("phase").isin("accepted", "cancelled", "failed")).orderBy("recorded_at", "job_id")


def deliveries_once(deliveries: DataFrame) -> DataFrame:
    """process_id, deliveries, effective: the first delivery counts, later ones and those after a terminal state do nothing."""
    order = Window.partitionBy("process_id").orderBy("at", "seq")
    return deliveries.withColumn("k", F.row_number().over(order)).groupBy("process_id").agg(F.count("*").alias("deliveries"), F.count_if((F.col("k") == 1) & ~F.col("terminal")).alias("effective"))


def submissions(attempts: DataFrame, stale: int = 120) -> DataFrame:
    """process_id, status, may_claim of the latest submission row: failed ones and stale starts may be taken over."""
    latest = attempts.groupBy("process_id").agg(F.max_by(F.struct("status", "started_at", "now"), F.struct("now", "seq")).alias("r")).select("process_id", "r.*")
    free = (F.col("status") == "submission_failed") | ((F.col("status") == "submitting") & (F.col("started_at").isNull() | (F.col("started_at") <= F.col("now") - F.greatest(F.lit(1), F.lit(stale)))))
    return latest.select("process_id", "status", free.alias("may_claim"))


def cancel_outcome(rows: DataFrame) -> DataFrame:
    """job_id, outcome of a cancel request by what is known of the job, strongest first."""
    c = F.col
    outcome = (
        F.when(c("cancelled_here"), "conflict").when(c("queued") & ~c("claimed"), "cancelled").when(c("claimed") | c("in_flight"), "requested").when(c("row_status").isin("succeeded", "failed", "cancelled"), "conflict")
        .when(c("row_status").isNull() & c("phase").isin("cancelled", "failed"), "conflict").when(c("phase") == "accepted", F.when(c("ready"), "forwarded").otherwise("wake")).otherwise("unavailable")
    )
    return rows.select("job_id", outcome.alias("outcome"))


def status_of(rows: DataFrame) -> DataFrame:
    """job_id, status, origin: the run table's row, else the task's state, else the queue's phase."""
    return rows.select("job_id", F.coalesce("row_status", "task_status", "phase", F.lit("unknown")).alias("status"), F.when(F.col("row_status").isNotNull(), "table").when(F.col("task_status").isNotNull(), "task").when(F.col("phase").isNotNull(), "queue").otherwise("none").alias("origin"))


def may_stop(guards: DataFrame) -> DataFrame:
    """host, may_stop: only where every guard is known and idle."""
    return guards.groupBy("host").agg(F.coalesce(F.bool_and(F.coalesce(F.col("idle"), F.lit(False))), F.lit(False)).alias("may_stop"))


def lifecycle(events: DataFrame, idle_timeout: int) -> DataFrame:
    """host, seq, state, generation after each event: stopped, starting, ready, busy, and stopped again when idle too long."""

    def kernel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state, generation, since, rows = "stopped", 0, None, []
        for r in frame.sort_values(["at", "seq"]).itertuples():
            if state == "ready" and since is not None and r.at - since >= idle_timeout:
                state, since = "stopped", None
            if r.event == "wake" and state == "stopped":
                state, generation = "starting", generation + 1
            elif r.event == "healthy" and state == "starting":
                state, since = "ready", r.at
            elif r.event == "work" and state in ("ready", "busy"):
                state, since = "busy", None
            elif r.event == "idle" and state == "busy":
                state, since = "ready", r.at
            elif r.event == "lost":
                state, since = "stopped", None
            rows.append((key[0], r.seq, state, generation))
        return pd.DataFrame(rows, columns=["host", "seq", "state", "generation"])

    return events.groupBy("host").applyInPandas(kernel, "host string, seq long, state string, generation int")
