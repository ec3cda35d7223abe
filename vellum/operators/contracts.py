"""Shapes of requests and decisions as named rules over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a selection request (fixed values).
MOST_CANDIDATES, MOST_PATHS, MOST_STEPS, MOST_DISPLAY = 32, 64, 16, 4096
CANDIDATE_TYPES = ("prose", "whitespace", "markdown", "heading", "citation", "equation", "table_cell", "table_row", "figure_caption")
SOURCES = ("grobid", "docling", "marker")
HEX = "^[0-9a-f]{64}$"


def _unique(values: Column) -> Column:
    return F.size(values) == F.size(F.array_distinct(values))


def decision_rules() -> dict[str, Column]:
    """Over region_id, action, candidate_ids: a decision keeps the baseline or selects, and names each candidate once."""
    ids = F.coalesce("candidate_ids", F.array().cast("array<string>"))
    return {
        "region_id": F.length("region_id") > 0,
        "action": F.col("action").isin("keep_baseline", "select_candidates"),
        "kept_without_candidates": (F.col("action") != "keep_baseline") | (F.size(ids) == 0),
        "selected_with_candidates": (F.col("action") != "select_candidates") | (F.size(ids) > 0),
        "candidates_once": _unique(ids),
        "candidates_named": F.forall(ids, lambda x: F.coalesce(x != "", F.lit(False))),
    }


def evidence_rules() -> dict[str, Column]:
    """Over the columns of a candidate's evidence: known source and type, a sound byte range, paired digests, bounded display."""
    visible, ast = F.coalesce(F.col("visible_digest"), F.lit("")), F.coalesce(F.col("ast_digest"), F.lit(""))
    emphasis = F.coalesce("emphasis_ids", F.array().cast("array<string>"))
    return {
        "candidate_id": F.length("candidate_id") > 0,
        "source": F.col("source").isin(*SOURCES),
        "artifact_digest": F.col("artifact_digest").rlike(HEX),
        "candidate_type": F.col("candidate_type").isin(*CANDIDATE_TYPES),
        "byte_range": (F.col("byte_start") >= 0) & (F.col("byte_end") > F.col("byte_start")),
        "digests": ((visible == "") | visible.rlike(HEX)) & ((ast == "") | ast.rlike(HEX)),
        "paired_digests": (visible == "") == (ast == ""),
        "emphasis_has_digests": (F.size(emphasis) == 0) | (visible != ""),
        "emphasis_ids": F.forall(emphasis, lambda x: F.coalesce(x.rlike(HEX), F.lit(False))),
        "display": F.length("display") <= MOST_DISPLAY,
    }


def region_rules() -> dict[str, Column]:
    """Over region_id, baseline, candidates (ids), paths: bounded, unique, every step a candidate, the baseline alone a path."""
    return {
        "region_id": F.length("region_id") > 0,
        "candidates": F.size("candidates").between(1, MOST_CANDIDATES) & _unique(F.col("candidates")),
        "paths": F.size("paths").between(1, MOST_PATHS) & _unique(F.col("paths")),
        "steps": F.forall("paths", lambda p: F.size(p).between(1, MOST_STEPS) & (F.size(p) == F.size(F.array_distinct(p)))),
        "known_steps": F.size(F.array_except(F.flatten("paths"), F.col("candidates"))) == 0,
        "baseline_path": F.exists("paths", lambda p: (F.size(p) == 1) & (F.element_at(p, 1) == F.col("baseline"))),
    }
