"""Span algebra over byte ranges: splicing, partition proofs, unions and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def splice(pieces: DataFrame) -> DataFrame:
    """doc_id, text, n_pieces from pieces (doc_id, ord, piece), joined in order."""
    ordered = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    return ordered.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), F.size("p").cast("long").alias("n_pieces"))


def output_offsets(pieces: DataFrame) -> DataFrame:
    """Adds out_start and out_end: running byte offsets of the pieces of each text."""
    size = F.octet_length("piece").cast("long")
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("out_end", F.sum(size).over(before)).withColumn("out_start", F.col("out_end") - size)


def partition_faults(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, n_ranges, faults: gaps, overlaps and open ends of ranges that should partition [0, size)."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    steps = ranges.withColumn("expected", F.lag("end", 1, 0).over(order))
    per = steps.groupBy("doc_id").agg(F.count("*").alias("n_ranges"), F.count_if(F.col("start") != F.col("expected")).alias("breaks"), F.max("end").alias("last"))
    return sizes.join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n_ranges", F.lit(0).cast("long")).alias("n_ranges"), (F.coalesce("breaks", F.lit(0)) + (F.coalesce("last", F.lit(0)) != F.col("size")).cast("long")).cast("long").alias("faults")
    )


def union_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """key, start, end, n: overlapping or touching ranges joined."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = ranges.withColumn("reach", reach).withColumn("fresh", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
    steps = steps.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def interval_join(left: DataFrame, right: DataFrame, key: str, bin_size: int) -> DataFrame:
    """Pairs (l_no, r_no) of one key whose half-open ranges overlap; equi-joined on bins, each pair once.

    left and right have key, no, start, end. A pair is kept in the bin where its overlap begins, so no
    distinct is needed and the join stays a hash or merge join however many ranges there are.
    """

    def binned(rows: DataFrame, side: str) -> DataFrame:
        last = F.greatest(F.col("start"), F.col("end") - 1)
        bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor(last / bin_size))
        return rows.where("end > start").select(key, F.explode(bins).alias("bin"), F.col("no").alias(f"{side}_no"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))

    both = binned(left, "l").join(binned(right, "r"), [key, "bin"])
    begins = F.greatest("l_start", "r_start")
    return both.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(begins / bin_size) == F.col("bin"))).select(key, "l_no", "r_no")
