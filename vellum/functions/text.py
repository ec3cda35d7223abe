"""Scalar text functions as Catalyst expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{L}\p{N}]+"


def squeezed(text: Column) -> Column:
    """White space runs become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def comparison_key(text: Column) -> Column:
    """Lower-cased squeezed text; equals the case-folded NFKC form where a text is NFKC and has no ß."""
    return F.lower(squeezed(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ALNUM), F.lit(0))


def semantic_identity(text: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def anchor_tokens(text: Column) -> Column:
    """Distinct tokens of four characters or with a digit, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 4) | t.rlike("[0-9]"))))


def non_space_bytes(text: Column) -> Column:
    return F.octet_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def ppm(part: Column, whole: Column, empty: int = 1_000_000) -> Column:
    """Integer parts per million, rounded down; `empty` for a zero whole."""
    return F.when(whole == 0, F.lit(empty).cast("long")).otherwise(F.floor(part * 1_000_000 / whole).cast("long"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a zero byte."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def unsafe_count(text: Column) -> Column:
    """Control characters other than tab, line feed and carriage return, and format characters."""
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u0080-\u009F\p{Cf}]")).cast("long")


def numbers(text: Column) -> Column:
    """ASCII numbers with sign, separators, exponent and percent sign."""
    return F.regexp_extract_all(text, F.lit(r"[+-]?(?:[0-9]+(?:[.,:/][0-9]+)*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[%‰]?"), F.lit(0))


def line_type(line: Column) -> Column:
    """Type of one Markdown line, first rule wins."""
    listed = line.rlike(r"^\s*(?:[-+*]|\d+[.)]|\[\d{1,4}\])\s+")
    return (
        F.when(line.rlike(r"^ {0,3}#{1,6}(?:[ \t]+|$)"), "heading")
        .when(line.rlike(r"^\s*(?:\$\$|\\\[)"), "equation")
        .when(line.rlike(r"^\s*\|") | ((F.regexp_count(line, F.lit(r"\|")) >= 2) & ~listed), "table")
        .when(line.rlike(r"(?i)^\s*(?:\*{1,2})?(?:(?:supplementary|extended\s+data)\s+)?(?:figure|fig\.)\s*[A-Za-z0-9]+"), "figure_caption")
        .when(listed | line.rlike(r"^\s*\[\^\d+\]:\s+"), "list")
        .otherwise("paragraph")
    )


def summarised_error(text: Column, limit: int = 4000) -> Column:
    """Text cut at the limit with the number of characters left out."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("... ["), (F.length(text) - limit).cast("string"), F.lit(" characters omitted]")))


def error_class(text: Column) -> Column:
    """transient or permanent, by words of the message."""
    return F.when(F.lower(text).rlike("timeout|timed out|connection|temporar|unavailable|throttl|rate limit|reset"), "transient").otherwise("permanent")


def clean_markdown(text: Column) -> Column:
    """Spans unwrapped, images dropped, web links reduced to their text, blank lines bounded, ends trimmed."""
    text = F.regexp_replace(text, r"</?span[^>]*>", "")
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\(https?://[^)]*\)", "$1")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def page_of_name(name: Column) -> Column:
    """Page, kind and index of an image name like a_page_3_Figure_2.jpeg."""
    pattern = r"_page_([0-9]+)_([A-Za-z]+)_([0-9]+)\.(?:jpeg|jpg|png)$"
    return F.struct(*(F.regexp_extract(name, pattern, k).alias(n) for k, n in ((1, "page"), (2, "kind"), (3, "index"))))
