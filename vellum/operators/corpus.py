"""Corpus analytics: case files to facts, decision events, reconciliation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CASE = "status string, usage struct<calls:long,total_tokens:long,cost_usd:double>, metrics struct<regions:long,agreed:long,selected:long,fallback:long,italics:long>"
STAGES = ("extract", "align", "vote", "select", "assemble", "validate")


def cases(files: DataFrame) -> DataFrame:
    """case_id and typed facts of case files (case_id, status_json); what is missing or of the wrong type is zero."""
    r = F.from_json("status_json", CASE)
    zero = F.lit(0).cast("long")
    names = ("regions", "agreed", "selected", "fallback", "italics")
    return files.select(
        "case_id", F.coalesce(r["status"], F.lit("missing")).alias("status"), *(F.coalesce(r["metrics"][n], zero).alias(n) for n in names),
        F.coalesce(r["usage"]["calls"], zero).alias("calls"), F.coalesce(r["usage"]["total_tokens"], zero).alias("tokens"), F.coalesce(r["usage"]["cost_usd"], F.lit(0.0)).alias("cost_usd"),
    )


def decision_events(facts: DataFrame) -> DataFrame:
    """case_id, sequence, stage, outcome, n: one event for each stage that has something to say, in stage order."""
    feeds = F.array(
        F.struct(F.lit("extract").alias("stage"), F.col("status").alias("outcome"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("vote").alias("stage"), F.lit("agreed").alias("outcome"), F.col("agreed").alias("n")),
        F.struct(F.lit("select").alias("stage"), F.lit("selected").alias("outcome"), F.col("selected").alias("n")),
        F.struct(F.lit("assemble").alias("stage"), F.lit("fallback").alias("outcome"), F.col("fallback").alias("n")),
    )
    rows = facts.select("case_id", F.posexplode(F.filter(feeds, lambda e: e["n"] > 0)).alias("k", "e"))
    return rows.select("case_id", (F.col("k") + 1).alias("sequence"), "e.stage", "e.outcome", "e.n")


def reconciliation(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """case_id, calls_agree, tokens_agree, cost_agrees, regions_agree between case facts and the usage ledger."""
    sums = ledger.groupBy("case_id").agg(F.sum("calls").alias("c"), F.sum("tokens").alias("t"), F.sum("cost_usd").alias("u"))
    both = facts.join(sums, "case_id", "left").fillna(0, ["c", "t", "u"])
    return both.select(
        "case_id", (F.col("calls") == F.col("c")).alias("calls_agree"), (F.col("tokens") == F.col("t")).alias("tokens_agree"), (F.abs(F.col("cost_usd") - F.col("u")) <= 1e-6).alias("cost_agrees"),
        (F.col("agreed") + F.col("selected") + F.col("fallback") == F.col("regions")).alias("regions_agree"),
    )


def summary(facts: DataFrame) -> DataFrame:
    """One row: sums, shares and the cost distribution of all cases."""
    sums = [F.sum(c).alias(c) for c in ("regions", "agreed", "selected", "fallback", "italics", "calls", "tokens")]
    c = F.col("cost_usd")
    return facts.agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "complete").alias("complete"), *sums, F.round(F.sum(c), 6).alias("cost"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"))


def status_counts(facts: DataFrame) -> DataFrame:
    """counts: all states with their numbers as one line of text, sorted."""
    per = facts.groupBy("status").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string"))))
    return per.agg(F.array_join(pairs, ", ").alias("counts"))


def report(found: DataFrame) -> DataFrame:
    """line_no, line of a Markdown table of a one-row summary."""
    names = found.columns
    cells = F.array(*(F.concat(F.lit(f"| {n} | "), F.col(n).cast("string"), F.lit(" |")) for n in names))
    return found.select(F.posexplode(F.concat(F.array(F.lit("| figure | value |"), F.lit("|---|---|")), cells)).alias("line_no", "line"))


def safe_names(items: DataFrame) -> DataFrame:
    """id, name: names with other characters as dashes; the second of a name gets -2, the third -3."""
    bare = F.lower(F.regexp_replace(F.regexp_replace("name", "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""))
    rows = items.select("id", F.when(bare == "", "case").otherwise(bare).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return rows.withColumn("k", k).select("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("name"))


def artifact_keys(runs: DataFrame, prefix: str) -> DataFrame:
    """process_id, key: prefix/YYYY/MM/DD/process/name with base names only."""
    name = F.regexp_replace(F.substring_index("name", "/", -1), "[^A-Za-z0-9._-]", "_")
    return runs.select("process_id", F.concat_ws("/", F.lit(prefix), F.date_format("started_at", "yyyy/MM/dd"), F.col("process_id").cast("string"), name).alias("key"))


def timeline(events: DataFrame) -> DataFrame:
    """process_id, ndjson: audit events in order, null fields dropped."""
    one = F.to_json(F.struct("ts", "stage", "status", "detail"), {"ignoreNullFields": "true"})
    per = events.select("process_id", "seq", one.alias("line")).groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return per.select("process_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("ndjson"))
