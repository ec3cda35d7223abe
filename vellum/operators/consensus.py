"""Baselines, votes and selection over several versions of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import BASELINE
from vellum.functions.text import comparison_key, non_space_bytes, word_count


def source_facts(versions: DataFrame) -> DataFrame:
    """doc_id, source, words, units, bytes, reasons: what the absolute floors say about each version."""
    text = F.coalesce("text", F.lit(""))
    units = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long")
    facts = versions.select("doc_id", "source", word_count(text).alias("words"), units.alias("units"), non_space_bytes(text).alias("bytes"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("words") < BASELINE.min_words, F.lit("words")),
            F.when(F.col("units") < BASELINE.min_units, F.lit("units")),
            F.when(F.col("bytes") < BASELINE.min_bytes, F.lit("bytes")),
        )
    )
    return facts.withColumn("reasons", F.array_join(reasons, ","))


def baseline_pick(versions: DataFrame, rank: dict[str, int]) -> DataFrame:
    """One row for each version: outcome is rejected, relative, eligible or selected.

    After the absolute floors a version needs 60 % of the best one's bytes and units; the most complete of
    the rest is selected, ties by balance to the middle version, units, bytes and source rank.
    """
    facts = source_facts(versions)
    best = Window.partitionBy("doc_id")
    passed = F.col("reasons") == ""
    facts = facts.withColumn("top_bytes", F.max(F.when(passed, F.col("bytes"))).over(best)).withColumn("top_units", F.max(F.when(passed, F.col("units"))).over(best))
    near = (F.col("bytes") * 100 >= F.col("top_bytes") * BASELINE.relative_percent) & (F.col("units") * 100 >= F.col("top_units") * BASELINE.relative_percent)
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))[F.col("source")], F.lit(0))
    coverage = F.least(F.floor(F.col("bytes") * 1_000_000 / F.col("top_bytes")), F.floor(F.col("units") * 1_000_000 / F.col("top_units")))
    facts = facts.withColumn("fit", passed & near).withColumn("coverage_ppm", F.when(passed, coverage).cast("long")).withColumn("priority", priority)
    order = Window.partitionBy("doc_id", "fit").orderBy(F.desc("coverage_ppm"), F.desc("units"), F.desc("bytes"), F.desc("priority"))
    first = F.row_number().over(order) == 1
    outcome = F.when(~passed, "rejected").when(~near, "relative").when(first, "selected").otherwise("eligible")
    return facts.select("doc_id", "source", "words", "units", "bytes", "reasons", "coverage_ppm", outcome.alias("outcome"))


def vote(units: DataFrame, rank: dict[str, int]) -> DataFrame:
    """doc_id, region, n_sources, outcome, winner for aligned units (doc_id, region, source, raw).

    Equal bytes agree exactly; equal keys agree nearly; else two or more equal versions are a majority;
    else the region is unresolved and the best-ranked source stands.
    """
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))[F.col("source")], F.lit(0))
    keyed = units.select("doc_id", "region", "source", "raw", comparison_key(F.col("raw")).alias("key"), priority.alias("priority"))
    by_raw = keyed.groupBy("doc_id", "region", "raw", "key").agg(F.count("*").alias("n"), F.max("priority").alias("best"), F.max_by("source", "priority").alias("who"))
    per = by_raw.groupBy("doc_id", "region").agg(
        F.sum("n").alias("n_sources"), F.count("*").alias("n_raw"), F.count_distinct("key").alias("n_key"), F.max("n").alias("most"), F.max_by("who", F.struct("n", "best")).alias("majority"), F.max_by("who", "best").alias("leader")
    )
    outcome = F.when(F.col("n_sources") < 2, "single").when(F.col("n_raw") == 1, "exact_agreement").when(F.col("n_key") == 1, "near_agreement").when(F.col("most") >= 2, "exact_majority").otherwise("unresolved")
    winner = F.when(outcome == "exact_majority", F.col("majority")).otherwise(F.col("leader"))
    return per.select("doc_id", "region", "n_sources", outcome.alias("outcome"), winner.alias("winner"))


def unique_anchor_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, left_no, right_no where a key comes once in either version (doc_id, no, key)."""

    def once(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc_id", "key").agg(F.min("no").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    return once(left, "left_no").join(once(right, "right_no"), ["doc_id", "key"]).select("doc_id", "left_no", "right_no")
