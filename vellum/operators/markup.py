"""Structure of HTML pages and of native layout records, by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_text(html: Column) -> Column:
    """Tags dropped, the five basic entities resolved, white space squeezed."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def elements(pages: DataFrame, tag: str) -> DataFrame:
    """page_id, no, text of every element of a kind, in reading order."""
    found = F.regexp_extract_all("html", F.lit(f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("no", "raw")).select("page_id", "no", inner_text(F.col("raw")).alias("text"))


def title_proof(pages: DataFrame) -> DataFrame:
    """page_id, title, heading, proven: the title is proven where it equals the first top heading."""
    title = inner_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    heading = inner_text(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select("page_id", title.alias("title"), heading.alias("heading")).withColumn("proven", (F.col("title") != "") & (F.col("title") == F.col("heading")))


def covered_pages(native: DataFrame) -> DataFrame:
    """source, pages, n_pages, complete: distinct pages of native records, complete if they are 1..expected."""
    per = native.groupBy("source").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.max("expected").alias("expected"))
    return per.select("source", F.array_join("pages", ",").alias("pages"), F.size("pages").cast("long").alias("n_pages"), (F.col("pages") == F.sequence(F.lit(1).cast("long"), F.col("expected"))).alias("complete"))


def style_lines(cells: DataFrame, partition: list[str]) -> DataFrame:
    """Adds line_no: neighbouring cells share a line if their centres lie within 0.55 of the larger height."""
    from pyspark.sql import Window

    order = Window.partitionBy(*partition).orderBy("cell")
    centre, height = (F.col("top") + F.col("bottom")) / 2, F.col("bottom") - F.col("top")
    steps = cells.withColumn("c", centre).withColumn("h", height)
    steps = steps.withColumn("pc", F.lag("c").over(order)).withColumn("ph", F.lag("h").over(order))
    fresh = F.when(F.col("pc").isNull() | (F.abs(F.col("c") - F.col("pc")) > 0.55 * F.greatest("h", "ph")), 1).otherwise(0)
    return steps.withColumn("line_no", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("c", "h", "pc", "ph")


def is_italic_font(font: Column) -> Column:
    """A font name says italic in one of its words, a subset prefix aside."""
    bare = F.regexp_replace(font, "^[A-Z]{6}\\+", "")
    words = F.regexp_extract_all(F.lower(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]+"), F.lit(0))
    return F.exists(words, lambda w: w.isin("it", "ita", "kursiv") | w.startswith("italic") | w.startswith("oblique"))
