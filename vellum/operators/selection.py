"""Numbered choices, routing, decisions and delivery: what a selector may pick and what becomes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import numbers


def numbered_choices(regions: DataFrame) -> DataFrame:
    """doc_id, region, choice, candidate: choice 0 is the baseline, the others follow in path order.

    regions has doc_id, region, baseline and paths (array of candidate ids, the baseline among them or not).
    """
    paths = F.concat(F.array("baseline"), F.array_distinct(F.filter("paths", lambda p: p != F.col("baseline"))))
    return regions.select("doc_id", "region", F.posexplode(paths).alias("choice", "candidate"))


def request_digest(choices: DataFrame) -> DataFrame:
    """doc_id, digest of the ordered numbered choices of all regions of a document."""
    entry = F.concat_ws("\x00", "region", F.col("choice").cast("string"), "candidate")
    per = choices.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region", "choice", entry.alias("e")))).alias("a"))
    return per.select("doc_id", F.sha2(F.array_join(F.transform("a", lambda x: x["e"]), "\x01"), 256).alias("digest"))


def decode_response(choices: DataFrame, answers: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, region, candidate, method for answers (doc_id, region, choice, digest).

    An answer counts if it names the request's digest and a choice there is; one answer a region. All other
    regions keep their baseline.
    """
    single = answers.groupBy("doc_id", "region").agg(F.min("choice").alias("choice"), F.count("*").alias("n"), F.min("digest").alias("said")).where("n = 1")
    valid = single.join(digests, "doc_id").where("said = digest").select("doc_id", "region", "choice")
    picked = choices.join(valid, ["doc_id", "region", "choice"]).select("doc_id", "region", "candidate", F.when(F.col("choice") == 0, "untouched_baseline").otherwise("model_selected").alias("method"))
    base = choices.where("choice = 0").select("doc_id", "region", "candidate")
    rest = base.join(picked.select("doc_id", "region"), ["doc_id", "region"], "left_anti").withColumn("method", F.lit("baseline_fallback"))
    return picked.unionByName(rest)


def risk(candidates: DataFrame) -> DataFrame:
    """doc_id, region, risk: format_conflict, protected_payload or ordinary.

    candidates has unit_type, visible (text) and emphasis (profile) of each alternative.
    """
    payload = F.col("unit_type").isin("equation", "table", "table_cell", "reference") | (F.size(numbers(F.col("visible"))) > 0)
    per = candidates.groupBy("doc_id", "region").agg(F.count_distinct("visible").alias("texts"), F.count_distinct("emphasis").alias("formats"), F.bool_or(payload).alias("payload"))
    kind = F.when((F.col("texts") == 1) & (F.col("formats") > 1), "format_conflict").when(F.col("payload"), "protected_payload").otherwise("ordinary")
    return per.select("doc_id", "region", kind.alias("risk"))


def route(risks: DataFrame, first_tier: DataFrame, second_tier: DataFrame) -> DataFrame:
    """doc_id, region, tier, choice: high risk goes to the second tier, ordinary to the first and on failure to the second."""
    one = first_tier.select("doc_id", "region", F.col("choice").alias("c1"))
    two = second_tier.select("doc_id", "region", F.col("choice").alias("c2"))
    rows = risks.join(one, ["doc_id", "region"], "left").join(two, ["doc_id", "region"], "left")
    easy = (F.col("risk") == "ordinary") & F.col("c1").isNotNull()
    tier = F.when(easy, "first").when(F.col("c2").isNotNull(), "second").otherwise("baseline")
    return rows.select("doc_id", "region", tier.alias("tier"), F.when(easy, F.col("c1")).otherwise(F.coalesce("c2", F.lit(0))).alias("choice"))


def italic_preference(versions: DataFrame, rank: dict[str, int]) -> DataFrame:
    """doc_id, region, source: where all agree but for exactly one emphasis profile, the best-ranked source that has it."""
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))[F.col("source")], F.lit(0))
    marked = F.when(F.col("emphasis") != "", F.col("emphasis"))
    per = versions.groupBy("doc_id", "region").agg(
        F.count_distinct("visible").alias("texts"), F.count_distinct(marked).alias("profiles"), F.max_by("source", F.when(marked.isNotNull(), priority)).alias("source"), F.count_if(marked.isNull()).alias("plain")
    )
    return per.where("texts = 1 and profiles = 1 and plain > 0").select("doc_id", "region", "source")


def valid_decisions(decisions: DataFrame, regions: DataFrame) -> DataFrame:
    """Decisions (doc_id, region, candidate) whose candidate is a path of the region."""
    allowed = regions.select("doc_id", "region", F.explode(F.array_union(F.array("baseline"), "paths")).alias("candidate"))
    return decisions.join(allowed, ["doc_id", "region", "candidate"], "left_semi")


def first_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def relaxed_baseline(versions: DataFrame) -> DataFrame:
    """doc_id, source, tier: strict, then without the terminal heading rule, then the largest safe one.

    versions has doc_id, source, bytes and the reasons left at each tier (strict_reasons, relaxed_reasons, unsafe).
    """
    tiers = F.array_compact(F.array(F.when(F.col("strict_reasons") == "", 0), F.when(F.col("relaxed_reasons") == "", 1), F.when(~F.col("unsafe"), 2)))
    ready = versions.withColumn("tier", F.array_min(tiers)).where("tier is not null")
    return first_by(ready, "doc_id", [F.asc("tier"), F.desc("bytes"), F.asc("source")]).select("doc_id", "source", "tier")


def outcome_label(rows: DataFrame) -> DataFrame:
    """doc_id, quality: baseline_fallback if any region is undecided, model_selected if any is the model's, else consensus."""
    per = rows.groupBy("doc_id").agg(F.count_if(F.col("method") == "baseline_fallback").alias("open"), F.count_if(F.col("method") == "model_selected").alias("model"))
    return per.select("doc_id", F.when(F.col("open") > 0, "baseline_fallback").when(F.col("model") > 0, "model_selected").otherwise("consensus").alias("quality"))
