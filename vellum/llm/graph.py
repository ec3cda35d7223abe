"""Connected components of an edge table, on the executors only: by alternating large and small stars, or at once where the edges are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import settle

#: Edges that one task joins in memory (16 bytes each), whatever the input; more go through rounds of stars.
MOST_AT_ONCE = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges between a and b."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(label[x] != label[y])):
        x, y = x[open_], y[open_]
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, np.concatenate((label[x], label[y])), np.concatenate((low, low)))
        while (label != (further := label[label])).any():
            label = further
    return nodes, nodes[label]


def _at_once(batches):
    held = [(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)) for batch in batches]
    if held:
        found = least_reached(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])


def _large_star(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder, f"{name}-least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Every neighbour below a node, and the node itself, is tied to the least neighbour."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = settle(down.groupBy("u").agg(F.min("v").alias("m")), folder, f"{name}-least")
    tied = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("u", "m")).where("a <> b").distinct()


def components(edges: DataFrame, folder: str, name: str = "components", at_once: int = MOST_AT_ONCE) -> DataFrame:
    """node, component (least node of its component) of every node that has an edge (a, b).

    Nulls and self-loops are left out. Up to `at_once` edges are joined in one task, without a shuffle. More go
    through stars until neither step changes the edges; each step is written to the shared folder, and rounds
    grow with the logarithm of the longest chain.
    """
    edges = settle(edges.select(*(F.col(c).cast("long") for c in "ab")).dropna().where("a <> b"), folder, f"{name}-0")
    if edges.count() <= at_once:
        return edges.coalesce(1).mapInArrow(_at_once, "node long, component long")
    edges = edges.distinct()
    seen, k = None, 0
    while True:
        k += 1
        edges = settle(_large_star(edges, folder, f"{name}-{k}l"), folder, f"{name}-{k}l-edges")
        edges = settle(_small_star(edges, folder, f"{name}-{k}s"), folder, f"{name}-{k}s-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # two numbers
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
