"""The choice of a baseline among several versions of a document, with a reason for every version.

1. Absolute floors: words, units, bytes, a heading or five units, balanced blocks, and one heading of each group.
2. A version that repeats itself is set aside where a clean one has 35 % of its bytes and units.
3. Of the rest, a version needs 60 % of the most bytes and units.
4. The greatest key wins: verified pages, coverage, agreement with the other versions (mean ratio), balance to the
   median size, headings, units, bytes, source rank.

The versions of a document meet in one row; a kernel sees many documents at a time. Nulls and empty texts are
rejected as empty, unsafe characters as forbidden; a document without a fit version has no selected one.
"""

from __future__ import annotations

import re
import statistics
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import BASELINE, REPETITION, SOURCE_RANK
from vellum.functions.kernels import _HEADING, folded_key, indel_ratio, scan_units
from vellum.operators.fronts import balance_reasons

#: Of each group some heading has to hold one (fixed values).
HEADING_GROUPS = (
    ("abstract", "introduction", "background"),
    ("method", "result", "discussion", "experimental", "conclusion"),
    ("references", "bibliography", "literature cited", "acknowledg", "conflict of interest", "author contribution", "supporting information", "conclusion"),
)
#: Control and format characters that must not be published.
UNSAFE = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF\uFDD0-\uFDEF]")


def floor_reasons(text: str, units: list[tuple[str, str]], groups=HEADING_GROUPS) -> list[str]:
    """What the absolute floors say about a text and its (type, raw) units, in order."""
    headings = [_HEADING.sub("", raw, count=1).strip().casefold() for kind, raw in units if kind == "heading"]
    checks = (
        (len(text.split()) < BASELINE.min_words, "too_few_words"),
        (len(units) < BASELINE.min_units, "too_few_structural_units"),
        (content_bytes(text) < BASELINE.min_bytes, "too_few_content_bytes"),
        (not headings and len(units) < 5, "insufficient_document_structure"),
    )
    missing = [f"missing_required_heading:{'|'.join(g)}" for g in groups if not any(name in h for name in g for h in headings)]
    return [name for fails, name in checks if fails] + balance_reasons(text) + missing


def content_bytes(text: str) -> int:
    return len("".join(text.split()).encode())


def repeats_itself(text: str) -> bool:
    """Many long blocks between blank lines of which a good share has come before."""
    keys = (folded_key(b) for b in re.split(r"(?:\r?\n){2,}", text))
    counts = Counter(k for k in keys if len(k) >= REPETITION.min_chars and len(re.findall(r"[^\W_]+", k)) >= REPETITION.min_tokens)
    total, excess = counts.total(), counts.total() - len(counts)
    return total >= REPETITION.min_blocks and excess >= REPETITION.min_excess and excess * 1_000_000 // total >= REPETITION.min_ppm


def judge_versions(versions: dict[str, tuple[str, bool]], groups=HEADING_GROUPS, rank: dict[str, int] = SOURCE_RANK) -> dict[str, tuple[str, str, float | None]]:
    """source -> (outcome, reason, agreement) of source -> (text, verified pages)."""
    out: dict[str, tuple[str, str, float | None]] = {}
    fit: dict[str, tuple[str, list[tuple[str, str]], int]] = {}
    for source, (text, _) in versions.items():
        data = (text or "").encode()
        units = [(kind, data[a:b].decode()) for kind, a, b in scan_units(text or "")]
        why = ["empty"] if not (text or "").strip() else ["forbidden_controls"] if UNSAFE.search(text) else ["no_structural_units"] if not units else floor_reasons(text, units, groups)
        if why:
            out[source] = ("rejected_absolute_floor", "+".join(why), None)
        else:
            fit[source] = (text, units, content_bytes(text))
    repeated = {s for s, (text, _, _) in fit.items() if repeats_itself(text)}
    aside = {s for s in repeated if any(100 * fit[c][2] >= BASELINE.quarantine_percent * fit[s][2] and 100 * len(fit[c][1]) >= BASELINE.quarantine_percent * len(fit[s][1]) for c in fit if c not in repeated)}
    pool = {s: v for s, v in fit.items() if s not in aside}
    out |= dict.fromkeys(aside, ("quarantined_repetition", "clean_peer_has_sufficient_coverage", None))
    if not pool:
        return out
    most_bytes, most_units = max(v[2] for v in pool.values()), max(len(v[1]) for v in pool.values())
    middle = statistics.median(v[2] for v in pool.values())
    keys = {s: "\n".join(folded_key(raw) for _, raw in v[1]) for s, v in pool.items()}
    scored = {}
    for s, (_, units, size) in pool.items():
        if 100 * size < BASELINE.relative_percent * most_bytes or 100 * len(units) < BASELINE.relative_percent * most_units:
            out[s] = ("rejected_relative_floor", "coverage_below_relative_floor", None)
            continue
        ratios = [indel_ratio(keys[s], keys[t]) for t in keys if t != s]
        agreement = sum(ratios) / len(ratios) if ratios else 100.0
        headings = sum(kind == "heading" for kind, _ in units)
        scored[s] = (versions[s][1], min(size / most_bytes, len(units) / most_units), agreement, min(size, middle) / max(size, middle), headings, len(units), size, rank.get(s, 0))
    best = max(scored, key=lambda s: scored[s], default=None)
    return out | {s: ("selected" if s == best else "eligible_not_selected", "", round(k[2], 6)) for s, k in scored.items()}


def baseline_choice(versions: DataFrame, groups=HEADING_GROUPS) -> DataFrame:
    """doc_id, source, outcome, reason, agreement of versions (doc_id, source, text[, verified])."""
    verified = F.coalesce(F.col("verified"), F.lit(False)) if "verified" in versions.columns else F.lit(False)
    packed = versions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("text", F.lit("")).alias("text"), verified.alias("verified")))).alias("v"))

    def kernel(batches):
        for batch in batches:
            rows = [(doc, s, *found) for doc, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, found in sorted(judge_versions({x["source"]: (x["text"], x["verified"]) for x in v}, groups).items())]
            made = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], ["doc_id", "source", "outcome", "reason", "agreement"])

    return packed.select(F.col("doc_id").cast("long").alias("doc_id"), "v").mapInArrow(kernel, "doc_id long, source string, outcome string, reason string, agreement double")
