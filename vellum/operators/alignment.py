"""Operators on documents that are inherently sequential: scanning, alignment, packing."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import ALIGNMENT, BATCH_BYTES, BATCH_CANDIDATES, BATCH_REGIONS, FLOORS
from vellum.functions.kernels import anchor_tokens, best_monotone, folded_key, indel_ratio, pack, scan_units, table_cells


def structural_units(documents: DataFrame) -> DataFrame:
    """doc_id, ord, unit_type, byte_start, byte_end of the units of each text; one pass, no shuffle."""

    def kernel(batches):
        for batch in batches:
            rows = [(d, k, *u) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, u in enumerate(scan_units(t or ""))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["doc_id", "ord", "unit_type", "byte_start", "byte_end"])

    schema = "doc_id long, ord int, unit_type string, byte_start long, byte_end long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def cells(rows: DataFrame) -> DataFrame:
    """doc_id, row_no, cell_no, cell of table rows (doc_id, row_no, line)."""

    def kernel(frames):
        for frame in frames:
            out = [(d, n, k, line[a:b].strip()) for d, n, line in frame.itertuples(index=False) for k, (a, b) in enumerate(table_cells(line or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "row_no", "cell_no", "cell"])

    return rows.select("doc_id", "row_no", "line").mapInPandas(kernel, "doc_id long, row_no long, cell_no int, cell string")


def _middle(i: int, n: int, m: int) -> int:
    """Where unit i of n would stand among m."""
    return round(i * (m - 1) / (n - 1)) if n > 1 else 0


def candidate_pairs(base: list[tuple[str, str]], other: list[tuple[str, str]]) -> set[tuple[int, int]]:
    """Pairs of (type, key) units worth scoring.

    Near the diagonal; equal units of which the other side has few; and the units that share most rare anchor tokens,
    tokens of four characters or with a digit that few units of either side have.
    """
    equal: dict[tuple[str, str], list[int]] = defaultdict(list)
    theirs: dict[str, list[int]] = defaultdict(list)
    for j, unit in enumerate(other):
        equal[unit].append(j)
        for t in anchor_tokens(unit[1]):
            theirs[t].append(j)
    mine = [anchor_tokens(key) for _, key in base]
    own = Counter(t for ts in mine for t in ts)
    rare = {t for t, n in own.items() if n <= ALIGNMENT.rare_frequency and 0 < len(theirs.get(t, ())) <= ALIGNMENT.rare_frequency}
    pairs: set[tuple[int, int]] = set()
    for i, unit in enumerate(base):
        middle = _middle(i, len(base), len(other))
        near = range(max(0, middle - ALIGNMENT.window), min(len(other), middle + ALIGNMENT.window + 1))
        same = equal.get(unit, [])
        votes = Counter(j for t in mine[i] & rare for j in theirs[t])
        best = sorted(votes, key=lambda j: (-votes[j], abs(j - middle), j))[: ALIGNMENT.rare_votes]
        pairs.update((i, j) for js in (near, same if len(same) <= ALIGNMENT.max_exact else (), best) for j in js)
    return pairs


def align_units(base: list[tuple], other: list[tuple]) -> list[tuple[int, int, float, bool, list[int]]]:
    """(base, other, similarity, ambiguous, competing) of the best order-preserving alignment of (type, raw[, slot]) units.

    Units of different types, or of different slots where both have one, are not aligned. competing: other units that
    are nearly as similar to the base unit, the most similar first.
    """
    left, right = [(u[0], folded_key(u[1])) for u in base], [(u[0], folded_key(u[1])) for u in other]
    slots = [[u[2] if len(u) > 2 else None for u in side] for side in (base, other)]
    edges, scores = [], {}
    for i, j in sorted(candidate_pairs(left, right)):
        kind, a, b = left[i][0], left[i][1], right[j][1]
        if kind != right[j][0] or max(len(a), len(b)) > ALIGNMENT.max_chars:
            continue
        if slots[0][i] is not None and slots[1][j] is not None and slots[0][i] != slots[1][j]:
            continue
        if 200 * min(len(a), len(b)) < FLOORS.get(kind, 42) * (len(a) + len(b)):  # lengths alone rule the pair out
            continue
        s = 100.0 if a == b else indel_ratio(a, b)
        if s >= FLOORS.get(kind, 42):
            scores[i, j] = s
            edges.append((i, j, 2 * round(1000 * s) + ALIGNMENT.bonus, abs(j - _middle(i, len(left), len(right)))))
    by_left, by_right = defaultdict(list), defaultdict(list)
    for (i, j), s in scores.items():
        by_left[i].append((-s, j))
        by_right[j].append((-s, i))
    out = []
    for k in best_monotone(edges):
        i, j = edges[k][:2]
        s = scores[i, j]
        close = [y for x, y in sorted(by_left[i]) if -x >= s - ALIGNMENT.ambiguity and y != j]
        also = any(-x >= s - ALIGNMENT.ambiguity and y != i for x, y in by_right[j])
        out.append((i, j, round(s, 6), bool(close) or also, close))
    return out


def _packed(units: DataFrame, name: str) -> DataFrame:
    """doc_id and its units in order as one array."""
    slot = F.col("slot") if "slot" in units.columns else F.lit(None)
    unit = F.struct(F.col("no").cast("long").alias("no"), F.col("unit_type").alias("unit_type"), F.coalesce("raw", F.lit("")).alias("raw"), slot.cast("string").alias("slot"))
    return units.groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias(name))


def aligned_units(base: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, base_no, other_no, similarity, ambiguous, competing for units (doc_id, no, unit_type, raw[, slot]) of two versions.

    The units of a document are one array on either side and meet in one row; a kernel sees many documents at a time.
    """
    columns = ["doc_id", "base_no", "other_no", "similarity", "ambiguous", "competing"]

    def kernel(batches):
        for batch in batches:
            rows = []
            for doc, mine, theirs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sides = [[(u["unit_type"], u["raw"], u["slot"]) for u in side] for side in (mine, theirs)]
                rows += [(doc, mine[i]["no"], theirs[j]["no"], s, c, [theirs[k]["no"] for k in more]) for i, j, s, c, more in align_units(*sides)]
            made = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], columns)

    met = _packed(base, "mine").join(_packed(other, "theirs"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "mine", "theirs")
    return met.mapInArrow(kernel, "doc_id long, base_no long, other_no long, similarity double, ambiguous boolean, competing array<long>")


def batches(regions: DataFrame) -> DataFrame:
    """doc_id, region, batch: regions (doc_id, region, candidates, bytes) packed in order under the limits."""

    def kernel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("region")
        numbers = pack(list(zip(frame["candidates"], frame["bytes"], strict=True)), BATCH_REGIONS, BATCH_CANDIDATES, BATCH_BYTES)
        return pd.DataFrame({"doc_id": frame["doc_id"], "region": frame["region"], "batch": numbers})

    return regions.groupBy("doc_id").applyInPandas(kernel, "doc_id long, region long, batch int")
