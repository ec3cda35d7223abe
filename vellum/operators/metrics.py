"""Preservation metrics: emphasis, occurrences, page coverage and style claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import ppm


def emphasis_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, protected, retained, lost, added: the k-th occurrence of each emphasised key before and after."""

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("doc_id", "unit_type", "key").orderBy("ord")
        return rows.select("doc_id", "unit_type", "key", F.row_number().over(order).alias("k"), F.lit(True).alias(name))

    both = keyed(before, "was").join(keyed(after, "is"), ["doc_id", "unit_type", "key", "k"], "full")
    was, now = F.col("was").isNotNull(), F.col("is").isNotNull()
    return both.groupBy("doc_id").agg(F.count_if(was).alias("protected"), F.count_if(was & now).alias("retained"), F.count_if(was & ~now).alias("lost"), F.count_if(~was & now).alias("added"))


def reader_report(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id, expected, missing, reordered, role_changed, foreign, recall_ppm of semantic occurrences.

    Both have doc_id, ord, role, digest; the k-th occurrence of a digest meets the k-th. One is reordered if
    its place is not beyond all places met before it.
    """
    order = Window.partitionBy("doc_id", "digest").orderBy("ord")
    a = expected.withColumn("k", F.row_number().over(order))
    b = seen.select("doc_id", "digest", F.col("ord").alias("at"), F.col("role").alias("other"), F.row_number().over(order).alias("k"))
    both = a.join(b, ["doc_id", "digest", "k"], "full")
    reach = F.max("at").over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("ord"), "at").rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("reach", reach)
    there, met = F.col("ord").isNotNull(), F.col("ord").isNotNull() & F.col("at").isNotNull()
    per = rows.groupBy("doc_id").agg(
        F.count_if(there).alias("expected"), F.count_if(there & ~met).alias("missing"), F.count_if(met & (F.col("at") <= F.col("reach"))).alias("reordered"),
        F.count_if(met & (F.col("role") != F.col("other"))).alias("role_changed"), F.count_if(~there).alias("foreign"), F.count_if(met).alias("met"),
    )
    return per.select("doc_id", "expected", "missing", "reordered", "role_changed", "foreign", ppm(F.col("met"), F.col("expected")).alias("recall_ppm"))


def page_proof(coverage: DataFrame) -> DataFrame:
    """doc_id, verified, reason, proof for (doc_id, source, pages, expected, counted): all pages 1..n, counts agree."""
    want = F.when(F.col("counted") > 0, F.sequence(F.lit(1), F.col("counted").cast("int"))).otherwise(F.array().cast("array<int>"))
    pages = F.array_sort(F.array_distinct(F.col("pages").cast("array<int>")))
    reason = F.when(F.col("expected") != F.col("counted"), "count_mismatch").when(pages != want, "pages_missing").otherwise("")
    rows = coverage.select("doc_id", "source", pages.alias("p"), reason.alias("reason"))
    proof = F.sha2(F.concat_ws("\x00", "source", F.array_join("p", ",")), 256)
    return rows.select("doc_id", "source", (F.col("reason") == "").alias("verified"), "reason", F.when(F.col("reason") == "", proof).alias("proof"))


def claim_receipt(claims: DataFrame, events: DataFrame) -> DataFrame:
    """source, evidence, claims, projected, supported, declined, unterminated, repeated.

    Every style claim (doc_id, claim, source, evidence) should end exactly once, by an event (doc_id, claim, outcome).
    """
    ends = events.groupBy("doc_id", "claim").agg(F.count("*").alias("n"), F.min("outcome").alias("outcome"))
    both = claims.join(ends, ["doc_id", "claim"], "left")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("projected", "supported", "declined")]
    return both.groupBy("source", "evidence").agg(F.count("*").alias("claims"), *counts, F.count_if(F.col("n").isNull()).alias("unterminated"), F.count_if(F.col("n") > 1).alias("repeated"))


def overlay(claims: DataFrame) -> DataFrame:
    """doc_id, target, start, end, support: claimed ranges of a target joined where they touch or overlap."""
    order = Window.partitionBy("doc_id", "target").orderBy("start", "end")
    steps = claims.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    steps = steps.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy("doc_id", "target", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("support")).drop("island")
