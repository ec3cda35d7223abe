"""Scalar rules of texts, settings and service replies, as Catalyst expressions; NFC and NFKC go through Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from vellum.functions.kernels import folded_key
from vellum.functions.text import squeezed

#: Marks that open a container's content, by unit type (fixed values).
CONTENT_MARKS = {"heading": r"^ {0,3}#{1,6}[ \t]+", "list": r"^\s*(?:[-+*]|\d+[.)])[ \t]+", "reference": r"^\s*(?:\[\d{1,4}\]|\d{1,4}[.)])[ \t]+"}
#: Dashes that count as a minus sign (fixed values).
DASHES = "−–—﹣"
#: Labels of an image review (fixed values).
IMAGE_CLASSES = ("scientific_figure", "table_or_equation", "publisher_logo", "badge_or_ui", "cover_art", "decorative", "unknown")
#: Spellings of a purge scope (fixed values).
SCOPES = {
    "": "", "false": "none", "0": "none", "off": "none", "none": "none", "true": "all", "1": "all", "on": "all", "all": "all", "full": "all",
    "merge": "merge", "extraction": "extraction", "extract": "extraction", "extraction_and_merge": "extraction",
}


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """The comparison key with NFKC and full case folding."""
    return text.map(lambda t: None if t is None else folded_key(t))


@pandas_udf(StringType())
def ascii_numerals(text: pd.Series) -> pd.Series:
    """NFKC with dashes as minus signs and decimal digits of all scripts as ASCII digits."""
    dashes = str.maketrans(dict.fromkeys(DASHES, "-"))

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(c if c < "\x80" or unicodedata.category(c) != "Nd" else str(unicodedata.decimal(c)) for c in unicodedata.normalize("NFKC", t).translate(dashes))

    return text.map(one)


def visible_text(text: Column) -> Column:
    """NFC, white-space runs as one blank, ends trimmed."""
    return squeezed(nfc(text))


def emphasis_id(text: Column, start: Column, end: Column) -> Column:
    """Identity of the emphasised characters [start, end) by what stands before, in and after them; null for nothing."""
    before, inside, after = F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text))
    return F.when(squeezed(inside) != "", F.sha2(F.concat_ws("\x00", *(visible_text(x) for x in (before, inside, after))), 256))


def content_start(raw: Column, unit_type: Column) -> Column:
    """Bytes of the mark before a container's content; 0 for other types and where there is no mark."""
    size = F.lit(0)
    for kind, pattern in CONTENT_MARKS.items():
        size = F.when(unit_type == kind, F.octet_length(F.regexp_extract(raw, f"({pattern})", 1))).otherwise(size)
    return size.cast("long")


def content_tokens(raw: Column, unit_type: Column) -> Column:
    """Words and single signs of a unit; a list item's number with its sign, or its bullet, is left out."""
    own = F.regexp_extract_all(raw, F.lit(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"), F.lit(0))
    first, second = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    drop = F.when(first.rlike("^[0-9]+$"), F.when(second.isin(".", ")"), 2).otherwise(1)).when(first.isin("-", "+", "*"), 1).otherwise(0)
    return F.when((unit_type == "list") & (F.size(own) > 0), F.slice(own, drop + 1, F.size(own))).otherwise(own)


def is_delimiter_cell(cell: Column) -> Column:
    return F.trim(cell).rlike("^:?-{3,}:?$")


def truth(value: Column, default: bool = False) -> Column:
    """A setting's text as a boolean; null is the default."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(F.trim(value)).isin("true", "1", "yes", "on"))


def csv_values(value: Column) -> Column:
    """Parts between commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), F.trim), lambda x: x != "")


def positive_int(value: Column) -> Column:
    """The whole number that a JSON scalar is, if positive, else 0; true and 1.0 are no whole numbers."""
    return F.when(value.rlike("^[0-9]+$"), F.coalesce(value.try_cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def metric_value(value: Column) -> Column:
    """A finite number from 0 on, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (number >= 0) & (number != float("inf")), number)


def failure_reason(kind: Column, tier: int = 1) -> Column:
    """refusal, timeout or no valid selection of a model tier, by the name of the error."""
    name = F.lower(kind)
    short = F.when(name.contains("refusal"), F.lit("refusal")).when(name.contains("timeout"), F.lit("timeout"))
    prefix = "terra" if tier == 1 else "sol"
    return F.coalesce(F.concat(F.lit(f"{prefix}_"), short), F.lit(f"no_valid_{prefix}_selection"))


def rounded_box(box: Column) -> Column:
    return F.transform(box, lambda x: F.round(x, 2))


def rendered(template: Column, values: Column) -> Column:
    """{name} replaced by the value of that name in one pass; a name without a value stays as it is."""
    pieces = F.regexp_extract_all(template, F.lit(r"\{[A-Za-z_]\w*\}|[^{]+|\{"), F.lit(0))
    name = lambda p: F.regexp_extract(p, r"^\{(\w+)\}$", 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(F.map_contains_key(values, name(p)), F.try_element_at(values, name(p))).otherwise(p)), "")


def purge_scope(scope: Column, everything: Column) -> Column:
    """none, merge, extraction or all; null where the scope is none of the known spellings."""
    name = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    name = F.coalesce(F.create_map(*(F.lit(x) for kv in SCOPES.items() for x in kv))[name], name)
    known = name.isin("none", "merge", "extraction", "all")
    return F.when(name == "", F.when(everything, "all").otherwise("none")).when(everything & (name == "none"), "all").when(known, name)


def is_pdf_name(name: Column) -> Column:
    return F.coalesce(name.contains(".") & (F.lower(F.substring_index(name, ".", -1)) == "pdf"), F.lit(False))


def is_uuid(value: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(F.trim(value), r"^urn:uuid:|[{}-]", "")).rlike("^[0-9a-f]{32}$"), F.lit(False))


def scopes_allow(token: Column, accepted: Column, client: Column, clients: Column) -> Column:
    """A token with an accepted scope, of an accepted client; an empty list of clients accepts all."""
    return F.coalesce(F.arrays_overlap(F.split(token, " "), accepted), F.lit(False)) & ((F.size(clients) == 0) | F.coalesce(F.array_contains(clients, client), F.lit(False)))
