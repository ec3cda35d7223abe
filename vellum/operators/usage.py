"""Token ledgers, prices and cost figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import COST_ALERT, PRICES


#: Costs are summed as whole units of 1e-10 USD (prices have at most four decimals), so no order of addition matters.
UNITS_PER_USD = 1e10


def cost_units(model: Column, prompt: Column, completion: Column, cached: Column, prices: dict[str, tuple[float, float, float]] = PRICES) -> Column:
    """Units of 1e-10 USD; an unknown model is an error, not a zero."""

    def rate(k: int) -> Column:
        known = F.create_map(*(x for name, p in prices.items() for x in (F.lit(name), F.lit(round(p[k] * 10_000)).cast("long"))))[model]
        return F.coalesce(known, F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(model, F.lit("null")))).cast("long"))

    fresh = F.greatest(F.lit(0).cast("long"), prompt - cached)
    return fresh * rate(0) + cached * rate(2) + completion * rate(1)


def ledger_rows(lineitem: DataFrame) -> DataFrame:
    """call_type, model, prompt, completion, cached, order of the sample line items."""
    kind = F.when(F.col("l_returnflag") == "A", "select").when(F.col("l_returnflag") == "N", "review").otherwise("title")
    model = F.when(F.col("l_linestatus") == "O", "large").otherwise("small")
    return lineitem.select(F.col("l_orderkey").alias("case_id"), kind.alias("call_type"), model.alias("model"), (F.col("l_quantity").cast("long") * 100).alias("prompt"), (F.col("l_linenumber") * 10).cast("long").alias("completion"), F.floor(F.col("l_discount") * 100).cast("long").alias("cached"))


_SUMS = ("prompt", "completion", "cached")


def ledger(rows: DataFrame) -> DataFrame:
    """call_type, model, calls, tokens and cost of each pair."""
    sums = rows.groupBy("call_type", "model").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in _SUMS))
    return sums.withColumn("cost_usd", cost_units(F.col("model"), *(F.col(c) for c in _SUMS)).cast("double") / UNITS_PER_USD)


def rollup(rows: DataFrame) -> DataFrame:
    """The ledger with subtotals for each call type and a grand total."""
    return rows.rollup("call_type", "model").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in _SUMS))


def cube(rows: DataFrame) -> DataFrame:
    return rows.cube("call_type", "model").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("calls"), F.sum("prompt").alias("prompt"))


def case_costs(rows: DataFrame) -> DataFrame:
    """case_id, calls, cost_usd, alert."""
    priced = rows.groupBy("case_id", "model").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in _SUMS))
    priced = priced.withColumn("c", cost_units(F.col("model"), *(F.col(c) for c in _SUMS)))
    per = priced.groupBy("case_id").agg(F.sum("calls").alias("calls"), F.sum("c").alias("units"), (F.sum("c").cast("double") / UNITS_PER_USD).alias("cost_usd"))
    return per.withColumn("alert", F.col("cost_usd") >= COST_ALERT)


def cost_distribution(costs: DataFrame) -> DataFrame:
    c, total = F.col("cost_usd"), F.sum("units").cast("double") / UNITS_PER_USD
    return costs.agg(F.count("*").alias("cases"), total.alias("total"), (total / F.count("*")).alias("mean"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"))


def counter_merge(rows: DataFrame, key: str, counters: str) -> DataFrame:
    """name, total: the sum of string-to-number maps over all rows."""
    return rows.select(F.explode(counters).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("total"))
