"""Front matter, edits and delivery checks of Markdown documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.kernels import _FENCE
from vellum.functions.text import digest, numbers, semantic_identity, unsafe_count

#: Headings that may hold the title, headings of one choice, characters of evidence (fixed values).
FRONT_HEADINGS, TITLE_RUN, FRONT_CHARS, STYLE_CHARS = 12, 3, 3000, 600
#: What a generated span of each kind may look like, and whether it is a boundary that belongs to what stands left (fixed values).
MARKUP = {
    "trailing_newline_normalization": (r"\n", True), "selected_document_skeleton": (r"#{1,6}", False), "alliance_table_separator": (r"\n?\|(?:---\|)+\n", False), "alliance_table_separator_boundary": (r"\n", True),
    "alliance_heading_role_marker": (r"#{1,6}", False), "alliance_reference_marker": (r"[1-9]\d*\. ", False), "alliance_bibliography_heading_insert": (r"\n{0,2}## References\n\n", False),
    "alliance_bibliography_heading_boundary": (r"\n{1,2}", True), "alliance_figure_legend_heading_insert": (r"\n{0,2}## Figure Legends\n\n", False), "alliance_figure_legend_heading_boundary": (r"\n{1,2}", True),
    "alliance_heading_depth": (r"#{1,6}", False), "alliance_figure_label_heading": ("### ", False), "alliance_table_label_emphasis_marker": (r"\*\*", False), "alliance_figure_label_caption_boundary": (r"\n\n", True),
    "alliance_abstract_heading_separator": (r"\n\n", True), "alliance_table_heading_boundary": (r"\n\n", True), "alliance_reference_blank_separator": (r"\n", True), "alliance_front_list_block_separator": (r"\n", True),
    "alliance_orcid_url_prefix": (r"https://orcid\.org/", False), "alliance_abstract_heading_marker": ("## ", False), "alliance_affiliation_ordinal_marker": (r"\.", False), "alliance_article_category_marker": (r"\*\*Categories:\*\* ", False),
    "alliance_title_composite_join": (" ", False), "native_emphasis_projection": (r"\*", False),
}


def markup_fits(operation: Column, span: Column) -> Column:
    """Whether a generated span has the shape of its kind; false for a kind that is not known."""
    fits = F.lit(False)
    for name, (shape, _) in MARKUP.items():
        fits = F.when(operation == name, span.rlike(rf"\A(?:{shape})\z")).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def owned_left(operation: Column, span: Column) -> Column:
    """Whether a span is a boundary of white space that belongs to what stands left of it."""
    return operation.isin(*(n for n, (_, left) in MARKUP.items() if left)) & markup_fits(operation, span)


def title_runs(headings: DataFrame) -> DataFrame:
    """doc_id, first, last, label of every choice for the title: one to three of the first twelve headings.

    headings: doc_id, ordinal (from 1), label, alone (nothing but blanks between it and the heading before). A
    choice has only such headings after its first one, and a letter or digit. Joined by number, at most 3 x 12 rows
    a document.
    """
    front = headings.where(F.col("ordinal") <= FRONT_HEADINGS)
    starts = front.select("doc_id", F.col("ordinal").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(TITLE_RUN - 1))).alias("more")).withColumn("last", F.expr("cast(first + more AS int)"))
    parts = starts.join(front.withColumnRenamed("doc_id", "d"), F.expr("doc_id = d AND ordinal BETWEEN first AND last"))
    runs = parts.groupBy("doc_id", "first", "last").agg(F.count("*").alias("n"), F.bool_and(F.expr("alone OR ordinal = first")).alias("together"), F.array_sort(F.collect_list(F.struct("ordinal", "label"))).alias("l"))
    runs = runs.where((F.col("n") == F.col("last") - F.col("first") + 1) & F.col("together")).withColumn("label", F.array_join(F.transform("l", lambda x: x["label"]), " "))
    return runs.where(semantic_identity(F.col("label")) != "").select("doc_id", "first", "last", "label")


def front_evidence(text: Column) -> Column:
    return F.substring(text, 1, FRONT_CHARS)


def style_evidence(text: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) with as many as 600 on either side."""
    low = F.greatest(start - STYLE_CHARS, F.lit(0))
    return F.substring(text, low + 1, end - low + STYLE_CHARS)


def edited(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text, n_edits after edits (doc_id, start, end, new) of characters that do not overlap; text null where they do.

    The pieces between edits and the edits' own are laid end to end by place: one aggregation by document.
    """
    per = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("e"))
    both = documents.select("doc_id", "text").join(per, "doc_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<start:int,end:int,new:string>>")))
    sound = F.expr("aggregate(e, 0, (a, x) -> CASE WHEN a >= 0 AND a <= x.start AND x.start <= x.end AND x.end <= length(text) THEN x.end ELSE -1 END) >= 0")
    pieces = F.expr("concat(flatten(transform(e, (x, i) -> array(substring(text, coalesce(get(e, i - 1).end, 0) + 1, x.start - coalesce(get(e, i - 1).end, 0)), x.new))), array(substring(text, coalesce(element_at(e, -1).end, 0) + 1, length(text))))")
    whole = F.when(F.size("e") == 0, F.col("text")).when(sound, F.array_join(pieces, ""))
    return both.select("doc_id", whole.alias("text"), F.size("e").cast("long").alias("n_edits"))


def source_seed(versions: DataFrame) -> DataFrame:
    """doc_id, source, digest, out_start, out_end, start, end, method: a whole source as one entry of provenance."""
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    return versions.select("doc_id", "source", F.sha2("text", 256).alias("digest"), zero.alias("out_start"), size.alias("out_end"), zero.alias("start"), size.alias("end"), F.lit("untouched_baseline").alias("method"))


def balance_reasons(text: str) -> list[str]:
    """What is left open at the end of a text, and closing brackets of equations that nothing opened, in order."""
    out: list[str] = []
    fence, equation = None, None
    for line in text.splitlines():
        body = line.strip()
        if fence:
            run = len(body) - len(body.lstrip(fence[0]))
            if len(line) - len(line.lstrip(" ")) <= 3 and run >= fence[1] and not body[run:].strip():
                fence = None
        elif equation:
            equation = None if body.endswith(equation) else equation
        elif mark := _FENCE.match(line):
            fence = (mark[1][0], len(mark[1]))
        elif body == "\\]":
            out.append("orphan_bracket_equation_close")
        elif body.startswith("$$"):
            equation = None if len(body) > 4 and body.endswith("$$") else "$$"
        elif body.startswith("\\["):
            equation = None if body.endswith("\\]") else "\\]"
    if fence:
        out.append("unbalanced_backtick_fence" if fence[0] == "`" else "unbalanced_tilde_fence")
    if equation:
        out.append("unbalanced_display_equation" if equation == "$$" else "unbalanced_bracket_equation")
    return out


def safety_reasons(documents: DataFrame) -> DataFrame:
    """doc_id, reasons: what makes a text unfit for delivery (open blocks, characters that must not be published), each once."""

    def kernel(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "open": [",".join(dict.fromkeys(balance_reasons(t or ""))) for t in frame["text"]], "unsafe": frame["unsafe"]})

    found = documents.select("doc_id", "text", unsafe_count(F.coalesce("text", F.lit(""))).alias("unsafe")).mapInPandas(kernel, "doc_id long, open string, unsafe long")
    return found.select("doc_id", F.concat_ws(",", F.when(F.col("open") != "", F.col("open")), F.when(F.col("unsafe") > 0, F.lit("publishable_text"))).alias("reasons"))


def risk_reasons(candidates: DataFrame) -> DataFrame:
    """doc_id, region, reason of candidates (doc_id, region, candidate_type, raw, visible, emphasis): what needs the stronger model.

    One visible text with several emphasis profiles, else a protected kind or a number in any of them, else null.
    """
    guarded = F.col("candidate_type").isin("equation", "table_row", "table_cell", "citation") | (F.size(numbers(F.col("raw"))) > 0)
    per = candidates.groupBy("doc_id", "region").agg(F.count_distinct("visible").alias("texts"), F.count_distinct(digest(F.col("emphasis"))).alias("profiles"), F.max(guarded).alias("guarded"))
    reason = F.when((F.col("texts") == 1) & (F.col("profiles") > 1), "protected_format_conflict").when(F.col("guarded"), "protected_payload_conflict")
    return per.select("doc_id", "region", reason.alias("reason"))


def delivery_assurance(verified: Column) -> Column:
    return F.when(F.coalesce(verified, F.lit(False)), "page_coverage_verified").otherwise("unverified_failsafe")


def structure_assurance(strict: Column, relaxed: Column) -> Column:
    """By whether a text passes all floors, all but the last group of headings, or neither."""
    return F.when(strict, "strict_structure_validated").when(relaxed, "terminal_heading_relaxed").otherwise("single_structural_unit_failsafe")
