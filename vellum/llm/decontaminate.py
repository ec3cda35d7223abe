"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units after numbers and names (capitalised words inside a sentence, unless all in capitals) become typed placeholders.
Windows of template tokens of every whole text are hashed and joined to the windows of the benchmark
items. Matches on one diagonal (document position less item position) are one alignment; where its
template has slots, every slot value of the item must stand for one value of the document throughout
(slot consistency), which catches re-parameterised questions and leaves chance alignments alone.

An alignment counts with `least` matched windows, or all of an item that has fewer. Items with fewer tokens
than a window match as a whole. Windows of which less than half are words are not used as templates, where
they would meet anything: the windows of an item that has any of them are searched by their values as well, and
such an alignment counts when it holds all of them, so that a verbatim copy is always found. Only items without
any word (bare rows of numbers) are not searched. Items of fewer than `SHORTEST` tokens would meet common
speech: they count where they are the whole of a document, values and all.

Slot consistency goes one way: equal values of the item must stand for equal values of the document, but a
question with new values may well have one value where the item has two.

Nulls and empty texts match nothing. Rows with one id are judged together, null ids too. Items without
tokens are not searched; repeated items count once each. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import free_name, settle, shared_folder, table

NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
#: Words that are units where a number stands before them.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "miles", "meters", "metres", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "l", "liters", "litres",
    "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "percent", "dollars", "usd", "eur", "euros", "cents", "mph", "kmh", "w", "kw", "v", "hz",
)
#: A capital and a small letter inside a sentence; words all in capitals are words.
NAME = r"(?<=[\p{L}\p{N},;:\x03]\x20)\p{Lu}\p{Ll}[\p{L}\p{M}]*"
TOKEN = "\x02[^\x03]*\x03|[\\p{L}\\p{M}]+"
WINDOW, LEAST, SHORTEST = 8, 3, 4


def marked(text: Column, values: bool) -> Column:
    """The text with typed placeholders \\x02kind[value]\\x03, lower-cased."""
    own = "$0" if values else ""
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x02"), F.lit(" ")), F.lit("\x03"), F.lit(" "))
    unit = "|".join(UNITS)
    # the unit first, while its number still stands before it
    text = F.regexp_replace(text, rf"(?<=[0-9]\x20?)(?:(?:{unit})(?![\p{{L}}\p{{M}}\p{{N}}])|[%°])", f"\x02u{own}\x03")
    text = F.regexp_replace(text, rf"(?<!\x02u){NUMBER}", f"\x02n{own}\x03")
    text = F.regexp_replace(text, NAME, f"\x02p{own}\x03")
    return F.lower(text)


def tokens(text: Column, values: bool = False) -> Column:
    return F.regexp_extract_all(marked(text, values), F.lit(TOKEN), F.lit(0))


def plain_values(raw: Column) -> Column:
    """The values of tokens without their kinds: a word after a colon is the same word as at the start of a text."""
    return F.transform(raw, lambda t: F.regexp_replace(t, "^\x02.|\x03$", ""))


def hashes(name: str, length: int) -> Column:
    """The hashes of all windows of a token column, in order."""
    n = F.size(name)
    places = F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(F.col(name), i, length)))


def _placed(length: int) -> Column:
    return F.transform(hashes("tokens", length), lambda h, i: F.struct(i.alias("dpos"), F.lit(length).alias("length"), h.alias("hash")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, ipos, length, hash, slots, of, exact: the searchable windows of every item, `of` in number.

    exact windows are hashed with their values and have no slots left to compare.
    """
    cut = items.where(F.size("tokens") > 0).select("item", "tokens", plain_values(F.col("raw")).alias("raw"), F.least(F.size("tokens"), F.lit(window)).alias("length"))
    cut = cut.withColumn("places", F.expr("transform(sequence(1, size(tokens) - length + 1), i -> struct(slice(tokens, i, length) AS part, slice(raw, i, length) AS whole))"))
    heavy = lambda w: F.size(F.filter(w["part"], lambda t: t.startswith("\x02"))) * 2 > F.col("length")
    cut = cut.withColumn("kept", F.size(F.filter("places", lambda w: ~heavy(w)))).withColumn("n", F.size("places"))
    rows = cut.select("*", F.posexplode("places").alias("ipos", "w"))
    good = rows.where(~heavy(F.col("w"))).select("item", "ipos", "length", F.xxhash64("w.part").alias("hash"), F.size(F.filter("w.part", lambda t: t.startswith("\x02"))).alias("slots"), F.col("kept").alias("of"), F.lit(False).alias("exact"))
    worded = F.exists("tokens", lambda t: ~t.startswith("\x02"))
    whole = rows.where((F.col("kept") < F.col("n")) & worded).select("item", "ipos", "length", F.xxhash64("w.whole").alias("hash"), F.lit(0).alias("slots"), F.col("n").alias("of"), F.lit(True).alias("exact"))
    return good.unionByName(whole)


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, broadcast_rows: int = 500_000, folder: str | None = None) -> DataFrame:
    """doc_id, item_id, n_windows of every alignment of a document with an item."""
    folder = folder or shared_folder(documents.sparkSession)
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text"), True).alias("raw"))
    # values are cut off again for the template: \x02k...\x03 to \x02k\x03
    items = settle(items.select("*", F.transform("raw", lambda t: F.regexp_replace(t, "^(\x02.)[^\x03]*", "$1")).alias("tokens")), folder, "items")
    known = settle(item_windows(items.where(F.size("tokens") >= SHORTEST), window), folder, "item-windows")
    brief = items.where(F.size("tokens").between(1, SHORTEST - 1)).select("item_id", F.xxhash64("raw").alias("hash"))
    n_brief = brief.count()
    whole = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long")
    if n_brief:
        spoken = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text"), True).alias("raw")).where(F.size("raw").between(1, SHORTEST - 1))
        spoken = spoken.select("doc_id", F.xxhash64("raw").alias("hash")).distinct()
        whole = spoken.join(F.broadcast(brief) if n_brief <= broadcast_rows else brief, "hash").select("doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"))
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most `window` numbers
    by_value = sorted(r[0] for r in known.where("exact").select("length").distinct().collect())
    side = known.select("item", "ipos", "length", "hash", "slots", "of", "exact")
    if known.count() <= broadcast_rows:  # a proven bound; beyond it the windows are shuffled
        side = F.broadcast(side)

    if not lengths:
        return whole
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("tokens"))
    # one explode for all lengths: every length's hashes end to end, with their length beside them
    if len(lengths) == 1:
        rows = own.select("doc_id", F.posexplode(hashes("tokens", lengths[0])).alias("dpos", "hash")).withColumn("length", F.lit(lengths[0]))
    else:
        rows = own.select("doc_id", F.explode(F.concat(*(_placed(k) for k in lengths))).alias("w")).select("doc_id", "w.dpos", "w.length", "w.hash")
    rows = rows.withColumn("exact", F.lit(False))
    if by_value:
        valued = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_values(tokens(F.col("text"), True)).alias("tokens"))
        valued = valued.select("doc_id", F.explode(F.concat(*(_placed(k) for k in by_value))).alias("w")).select("doc_id", "w.dpos", "w.length", "w.hash")
        rows = rows.unionByName(valued.withColumn("exact", F.lit(True)))
    hits = rows.join(side, ["hash", "length", "exact"]).select("doc_id", "dpos", "item", "ipos", "slots", "of", "length", "exact")
    hits = settle(hits, folder, "hits")
    lines = hits.groupBy("doc_id", "item", (F.col("dpos") - F.col("ipos")).alias("shift"), "of", "length", "exact").agg(
        F.count_distinct("ipos").alias("n_windows"), F.min("ipos").alias("low"), F.max("ipos").alias("high"), F.max("slots").alias("slots")
    )
    lines = settle(lines.where(F.col("n_windows") >= F.when(F.col("exact"), F.col("of")).otherwise(F.least(F.lit(least), F.col("of")))), folder, "alignments")
    names = items.select("item", "item_id")
    plain = lines.where("slots = 0").join(names, "item").select("doc_id", "item_id", "n_windows")

    # only texts of alignments with slots are read again, for the values
    slotted = lines.where("slots > 0")
    whose = slotted.select("doc_id").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    valued = texts.join(whose, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("id", tokens(F.col("text"), True).alias("values"))
    pairs = slotted.join(items, "item").join(valued, F.col("doc_id").eqNullSafe(F.col("id")))
    spots = F.filter(F.sequence(F.col("low"), F.col("high") + F.col("length") - 1), lambda p: F.get(F.col("tokens"), p).startswith("\x02"))
    both = F.transform(spots, lambda p: F.struct(F.get(F.col("raw"), p).alias("theirs"), F.get(F.col("values"), p + F.col("shift")).alias("ours")))
    # places inside the span that no matched window holds may not even be slots of the document
    both = F.array_distinct(F.filter(both, lambda s: F.substring(s["theirs"], 1, 2) == F.substring(s["ours"], 1, 2)))
    consistent = F.size(both) == F.size(F.array_distinct(F.transform(both, lambda s: s["theirs"])))
    found = plain.unionByName(pairs.where(consistent).select("doc_id", "item_id", "n_windows"))
    return found.unionByName(whole) if n_brief else found


def judge(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """doc_id, contaminated, item_id (least), n_items, n_windows (of the longest alignment) of every row."""
    folder = shared_folder(documents.sparkSession)
    leaks = find_leaks(documents, benchmark, window, least, folder=folder)
    per = leaks.groupBy(F.col("doc_id").alias("id")).agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"), F.max("n_windows").alias("n_windows"))
    per = settle(per, folder, "leaks")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(per, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.col("n_windows").isNotNull().alias("contaminated"), "item_id", F.coalesce("n_items", zero).alias("n_items"), F.coalesce("n_windows", zero).alias("n_windows"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """The documents without a benchmark item, whole rows."""
    folder = shared_folder(documents.sparkSession)
    name = free_name(documents.columns, "leaked")
    bad = settle(find_leaks(documents, benchmark, folder=folder).select(F.col("doc_id").alias(name)).distinct(), folder, "leaked")
    return documents.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti").select(*(F.col(f"`{c}`") for c in columns))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document against every benchmark item."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
