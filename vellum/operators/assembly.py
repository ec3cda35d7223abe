"""Assembly of texts from exact source spans, with complete lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bytes(text: str, start: str, end: str):
    return F.expr(f"substring(encode({text}, 'UTF-8'), cast({start} AS int) + 1, cast({end} - {start} AS int))")


def graph_faults(regions: DataFrame) -> DataFrame:
    """doc_id, faults: regions (doc_id, start, end) that are empty, reversed or overlap the ones before."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    steps = regions.withColumn("reach", F.max("end").over(before))
    return steps.groupBy("doc_id").agg(F.count_if((F.col("end") <= F.col("start")) | (F.col("start") < F.col("reach"))).alias("faults"))


def provenance(baselines: DataFrame, picks: DataFrame) -> DataFrame:
    """doc_id, ord, piece (binary), source, src_start, src_end, out_start, out_end, method: an ordered partition.

    baselines has doc_id, source, text; picks has doc_id, start, end (of the baseline), source, src_text,
    src_start, src_end, method, with disjoint ranges. Baseline bytes between picks stay as they are.
    """
    sized = baselines.select("doc_id", F.col("source").alias("base"), "text", F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("doc_id").orderBy("start")
    chosen = picks.select("doc_id", "start", "end", _bytes("src_text", "src_start", "src_end").alias("piece"), "source", "src_start", "src_end", "method")
    gaps = picks.select("doc_id", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("from"), F.col("start").alias("to")).union(picks.groupBy("doc_id").agg(F.max("end").alias("from")).join(sized, "doc_id").select("doc_id", "from", "size"))
    whole = sized.join(picks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))
    kept = gaps.union(whole).where("to > from").join(sized, "doc_id")
    kept = kept.select("doc_id", F.col("from").alias("start"), F.col("to").alias("end"), _bytes("text", "from", "to").alias("piece"), F.col("base").alias("source"), F.col("from").alias("src_start"), F.col("to").alias("src_end"), F.lit("untouched_baseline").alias("method"))
    rows = chosen.unionByName(kept).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")))
    size = F.octet_length("piece").cast("long")
    rows = rows.withColumn("out_end", F.sum(size).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("doc_id", "ord", "piece", "source", "src_start", "src_end", (F.col("out_end") - size).alias("out_start"), "out_end", "method")


def assembled(lineage: DataFrame) -> DataFrame:
    """doc_id, text of a lineage, its pieces in order."""
    per = lineage.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    # a byte-wise join in linear time: pieces may end inside a character
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), ""))
    return per.select("doc_id", joined.cast("string").alias("text"))


def lineage_faults(lineage: DataFrame, output: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, gaps, foreign, reused: what keeps a lineage from being an exact partition of the output.

    output has doc_id, text; sources has doc_id, source, text.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    named = sources.select("doc_id", "source", F.col("text").alias("src"))
    rows = lineage.drop("piece").join(output, "doc_id").join(named, ["doc_id", "source"], "left").withColumn("before", F.lag("out_end", 1, 0).over(order))
    rows = rows.withColumn("foreign", ~F.coalesce(_bytes("text", "out_start", "out_end") == _bytes("src", "src_start", "src_end"), F.lit(False)))
    seen = Window.partitionBy("doc_id", "source").orderBy("src_start", "src_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reused", F.coalesce(F.col("src_start") < F.max("src_end").over(seen), F.lit(False)))
    per = rows.groupBy("doc_id").agg(F.count_if(F.col("before") != F.col("out_start")).alias("gaps"), F.count_if("foreign").alias("foreign"), F.count_if("reused").alias("reused"), F.max("out_end").alias("last"), F.max(F.octet_length("text")).alias("size"))
    return per.select("doc_id", (F.col("gaps") + (F.col("last") != F.col("size")).cast("long")).alias("gaps"), "foreign", "reused")


def clip_ranges(lineage: DataFrame, cuts: DataFrame) -> DataFrame:
    """Lineage rows cut to the ranges (doc_id, cut, start, end) of the output; generated pieces stay whole or go."""
    both = lineage.join(cuts, "doc_id").where("out_start < end and start < out_end")
    generated = F.col("method") == "generated"
    left = F.greatest("out_start", "start")
    right = F.least("out_end", "end")
    rows = both.where(~generated | ((F.col("out_start") >= F.col("start")) & (F.col("out_end") <= F.col("end"))))
    return rows.select("doc_id", "cut", "source", (F.col("src_start") + left - F.col("out_start")).alias("src_start"), (F.col("src_end") - (F.col("out_end") - right)).alias("src_end"), (left - F.col("start")).alias("out_start"), (right - F.col("start")).alias("out_end"), "method")


def one_line_end(texts: DataFrame) -> DataFrame:
    """doc_id, text with exactly one line feed at the end, cut (bytes taken off) and added (0 or 1)."""
    bare = F.regexp_replace("text", r"[\r\n]+\z", "")
    rows = texts.select("doc_id", "text", bare.alias("bare"))
    return rows.select("doc_id", F.concat("bare", F.lit("\n")).alias("text"), F.greatest(F.octet_length("text") - F.octet_length("bare") - 1, F.lit(0)).cast("long").alias("cut"), (F.octet_length("text") == F.octet_length("bare")).cast("long").alias("added"))


def permute(pieces: DataFrame, rank: str) -> DataFrame:
    """Pieces (doc_id, ord, piece, rank) in a stable new order, with their new offsets; each comes exactly once."""
    order = Window.partitionBy("doc_id").orderBy(rank, "ord")
    size = F.octet_length("piece").cast("long")
    rows = pieces.withColumn("new_ord", F.row_number().over(order)).withColumn("out_end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("out_start", F.col("out_end") - size)


def reconcile(events: DataFrame, audit: DataFrame) -> DataFrame:
    """doc_id, event_id, state: each transformation event against the k-th audit entry of its id."""
    order = Window.partitionBy("doc_id", "event_id")
    a = events.withColumn("k", F.row_number().over(order.orderBy("seq")))
    b = audit.withColumn("k", F.row_number().over(order.orderBy("out_start"))).select("doc_id", "event_id", "k", F.col("out_start").alias("at"))
    both = a.join(b, ["doc_id", "event_id", "k"], "full")
    return both.select("doc_id", "event_id", "k", F.when(F.col("seq").isNull(), "unannounced").when(F.col("at").isNull(), "lost").otherwise("kept").alias("state"))
