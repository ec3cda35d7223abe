"""Repetition and overlap metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import REPETITION
from vellum.functions.text import comparison_key, ppm, word_count
from vellum.operators.lexing import BLANK_LINES, shingles


def eligible_blocks(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every paragraph that is long enough to tell repetition from chance."""
    own = documents.select("doc_id", F.explode(F.split("text", BLANK_LINES)).alias("block")).select("doc_id", comparison_key(F.col("block")).alias("key"))
    own = own.where((F.length("key") >= REPETITION.min_chars) & (word_count(F.col("key")) >= REPETITION.min_tokens))
    return own.select("doc_id", F.sha2("key", 256).alias("fingerprint"))


def repetition_profile(documents: DataFrame) -> DataFrame:
    """doc_id, blocks, unique_blocks, excess, excess_ppm, repeated of each text with an eligible block."""
    counts = eligible_blocks(documents).groupBy("doc_id", "fingerprint").agg(F.count("*").alias("n"))
    per = counts.groupBy("doc_id").agg(F.sum("n").alias("blocks"), F.count("*").alias("unique_blocks"), F.sum(F.col("n") - 1).alias("excess"))
    share = ppm(F.col("excess"), F.col("blocks"), 0)
    flag = (F.col("blocks") >= REPETITION.min_blocks) & (F.col("excess") >= REPETITION.min_excess) & (share >= REPETITION.min_ppm)
    return per.select("*", share.alias("excess_ppm"), flag.alias("repeated"))


def excess_repetition(output: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, fingerprint, output_count, source_count where an output repeats more than any source does.

    sources has doc_id, source and text.
    """
    made = eligible_blocks(output).groupBy("doc_id", "fingerprint").agg(F.count("*").alias("output_count")).where("output_count > 1")
    keyed = sources.select(F.struct("doc_id", "source").alias("doc_id"), "text")
    known = eligible_blocks(keyed).groupBy("doc_id", "fingerprint").agg(F.count("*").alias("n"))
    most = known.groupBy(F.col("doc_id.doc_id").alias("doc_id"), "fingerprint").agg(F.max("n").alias("source_count"))
    both = made.join(most, ["doc_id", "fingerprint"], "left").withColumn("source_count", F.coalesce("source_count", F.lit(0).cast("long")))
    return both.where("output_count > source_count")


def reference_overlap(documents: DataFrame, references: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, item_id, shared: distinct shingles that a text shares with a reference text.

    Up to a counted number of reference shingles they go to the texts, and only hits are shuffled.
    """
    theirs = shingles(references, "item_id")
    if theirs.count() <= broadcast_rows:
        hits = shingles(documents, "doc_id").join(F.broadcast(theirs), "shingle")
    else:
        hits = shingles(documents, "doc_id").join(theirs, "shingle")
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def token_recall(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, reference_tokens, found, recall_ppm: multiset overlap of the tokens of two views of one text.

    Both views are counted in one aggregation by (key, token).
    """
    side = lambda df, n, m: df.select(key, F.explode("tokens").alias("t"), F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"))
    counts = side(left, 1, 0).union(side(right, 0, 1)).groupBy(key, "t").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0")
    both = counts.groupBy(key).agg(F.sum("n").alias("reference_tokens"), F.sum(F.least("n", "m")).alias("found"))
    return both.withColumn("recall_ppm", ppm(F.col("found"), F.col("reference_tokens")))
