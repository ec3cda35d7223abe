"""Section hierarchy: levels, regions, slot paths and the order of roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import semantic_identity

#: Order of containers by role.
ROLE_RANK = {"front": 0, "abstract": 1, "body": 2, "back": 3, "references": 4}
_BACK = r"(?i)^\W*(?:references|bibliography|literature cited|acknowledge?ments?|appendix|funding|author contributions)\b"


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, identity of Markdown heading lines."""
    rows = lines.select("doc_id", "line_no", F.regexp_extract("line", r"^ {0,3}(#{1,6})(?:\s|$)", 1).alias("marks"), F.trim(F.regexp_replace("line", r"^ {0,3}#{1,6}\s*|\s*#*\s*$", "")).alias("title"))
    return rows.where("marks <> ''").select("doc_id", "line_no", F.length("marks").alias("level"), "title", semantic_identity(F.col("title")).alias("identity"))


def regions(found: DataFrame) -> DataFrame:
    """Adds region: front up to the first level-2 heading, back from the first back-matter heading on, else body."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    back = F.max(F.col("title").rlike(_BACK)).over(order)
    body = F.max(F.col("level") >= 2).over(order)
    return found.withColumn("region", F.when(back, "back").when(body, "body").otherwise("front"))


def slot_paths(found: DataFrame) -> DataFrame:
    """Adds path: the identities of the open headings of levels 1 to 6, outermost first.

    The heading of a level is open until one of that level or above comes; each level is one window, no loop.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows, parts = found, []
    for level in range(1, 7):
        rows = rows.withColumn(f"__at{level}", F.max(F.when(F.col("level") == level, F.col("line_no"))).over(order))
        rows = rows.withColumn(f"__id{level}", F.last(F.when(F.col("level") == level, F.col("identity")), ignorenulls=True).over(order))
    for level in range(1, 7):
        above = [F.col(f"__at{k}") for k in range(1, level)]
        shut = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        parts.append(F.when(F.col(f"__at{level}") > shut, F.col(f"__id{level}")))
    rows = rows.withColumn("path", F.array_join(F.array_compact(F.array(*parts)), "/"))
    return rows.drop(*(f"__{n}{k}" for n in ("at", "id") for k in range(1, 7)))


def occurrence_ids(found: DataFrame) -> DataFrame:
    """Adds ordinal (of the path) and slot, unique in a document."""
    order = Window.partitionBy("doc_id", "region", "path").orderBy("line_no")
    rows = found.withColumn("ordinal", F.row_number().over(order))
    return rows.withColumn("slot", F.concat_ws(":", "region", "path", F.col("ordinal").cast("string")))


def container_order(containers: DataFrame) -> DataFrame:
    """doc_id, container, old_no, new_no: containers by the rank of their role, stable within a role."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLE_RANK.items() for x in kv))[F.col("role")], F.lit(ROLE_RANK["body"]))
    return containers.withColumn("new_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "old_no")) - 1).select("doc_id", "container", "old_no", "new_no")


def depth_fixes(found: DataFrame) -> DataFrame:
    """doc_id, line_no, level, new_level where a heading lies more than one level below the one before it."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = found.withColumn("before", F.lag("level", 1, 0).over(order))
    return rows.where("level > before + 1").select("doc_id", "line_no", "level", (F.col("before") + 1).alias("new_level"))


def missing_separators(lines: DataFrame) -> DataFrame:
    """doc_id, after_line, cells: pipe blocks whose second row is no delimiter row."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    piped = F.col("line").rlike(r"^\s*\|")
    rows = lines.select("doc_id", "line_no", "line", piped.alias("piped"), F.lag(piped, 1, False).over(order).alias("before"), F.lead("line").over(order).alias("next"))
    opens = rows.where("piped and not before")
    lacks = ~F.coalesce(F.col("next"), F.lit("")).rlike(r"^\s*\|(?:\s*:?-{3,}:?\s*\|)+\s*$")
    return opens.where(lacks).select("doc_id", F.col("line_no").alias("after_line"), (F.regexp_count("line", F.lit(r"(?<!\\)\|")) - 1).cast("long").alias("cells"))
