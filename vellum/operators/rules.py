"""Declarative validation: named predicates over a frame give one row for each violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of every rule whose predicate is not true; null counts as a violation. One pass."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    return rows.select(key, F.explode(failed).alias("rule"))


def qualification(rows: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """key, verdict, reasons: qualified where no reason holds, else failsafe with all reasons in order."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(True)), F.lit(name)) for name, holds in reasons.items())))
    return rows.select(key, F.array_join(held, ",").alias("reasons"), F.when(F.size(held) == 0, "qualified").otherwise("failsafe").alias("verdict"))


def health(components: DataFrame) -> DataFrame:
    """status of (component, state, required) rows: a required one down is unhealthy, any other fault degrades."""
    bad = F.col("state") != "ok"
    worst = components.agg(F.max(F.when(bad & F.col("required"), 2).when(bad, 1).otherwise(0)).alias("w"), F.count("*").alias("components"), F.count_if(bad).alias("faults"))
    return worst.select(F.when(F.col("w") == 2, "unhealthy").when(F.col("w") == 1, "degraded").otherwise("ok").alias("status"), "components", "faults")
