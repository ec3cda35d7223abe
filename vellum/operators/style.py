"""Styled lines onto Markdown: which unit a line belongs to, where its words stand, and the title that was chosen."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import FLOORS
from vellum.functions.kernels import _HEADING, folded_key, indel_ratio, scan_units, strip_emphasis
from vellum.functions.scalars import CONTENT_MARKS
from vellum.functions.sequences import projection_tokens
from vellum.operators.alignment import align_units
from vellum.operators.composites import visible

#: Types of units that a styled line may be mapped to (fixed values).
MAPPED = ("paragraph", "list", "reference", "figure_caption", "heading")


def _keys(text: str) -> list[str]:
    return [folded_key(t[0]) for t in projection_tokens(text)]


def _times(needle: list[str], hay: list[str]) -> int:
    return sum(hay[k : k + len(needle)] == needle for k in range(len(hay) - len(needle) + 1))


def mapped_lines(units: list[tuple], lines: list[tuple]) -> list[tuple[int, int]]:
    """(line, unit) of lines (text, page) whose tokens stand exactly once in exactly one unit (type, raw, page).

    Units before the last one met are left, and units of another page where both pages are known; a line that fits
    several units, or none, is not mapped.
    """
    known = [(k, _keys(v), page) for k, (kind, raw, page) in enumerate(units) if kind in MAPPED and (v := visible(raw))]
    out, cursor = [], 0
    for n, (text, page) in enumerate(lines):
        own = _keys(text or "")
        fits = [k for k, keys, at in known if own and k >= cursor and (page is None or at is None or page == at) and _times(own, keys) == 1]
        if len(fits) == 1:
            cursor = fits[0]
            out.append((n, cursor))
    return out


def line_units(units: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, line_no, unit_no of lines (doc_id, line_no, text, page) and units (doc_id, no, unit_type, raw, page)."""
    u = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("no").cast("long").alias("no"), "unit_type", "raw", "page"))).alias("u"))
    s = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("long").alias("no"), "text", "page"))).alias("l"))

    def kernel(batches):
        for batch in batches:
            rows = []
            for doc, own, styled in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = mapped_lines([(x["unit_type"], x["raw"] or "", x["page"]) for x in own], [(x["text"], x["page"]) for x in styled])
                rows += [(doc, styled[n]["no"], own[k]["no"]) for n, k in found]
            made = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["doc_id", "line_no", "unit_no"])

    return u.join(s, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "u", "l").mapInArrow(kernel, "doc_id long, line_no long, unit_no long")


def serialisation_map(raw: str) -> tuple[str, list[int]]:
    """(visible text, place in the raw text of every visible character) of one line of Markdown with emphasis marks."""
    text, places, at = strip_emphasis(raw)[0], [], 0
    for c in text:
        at = raw.index(c, at)
        # marks between this character and the next visible one are passed over by the next search
        places.append(at)
        at += 1
    return text, places


def claim_intervals(target: str, claim: str) -> list[tuple[int, int]]:
    """Character ranges of the visible target that may bear a claim.

    All exact finds at borders of words; without any, the one range whose tokens are the claim's; for a caption, the
    text behind its label as well.
    """

    def finds(text: str, shift: int) -> list[tuple[int, int]]:
        found = [m.span() for m in re.finditer(rf"(?<!\w){re.escape(claim)}(?!\w)", text)] if claim.strip() else []
        if not found and claim.strip():
            tokens, own = projection_tokens(text), _keys(claim)
            keys = [folded_key(t[0]) for t in tokens]
            at = [k for k in range(len(keys) - len(own) + 1) if own and keys[k : k + len(own)] == own]
            found = [(tokens[at[0]][1], tokens[at[0] + len(own) - 1][2])] if len(at) == 1 else []
        return [(a + shift, b + shift) for a, b in found]

    label = re.match(r"\s*(?:figure|fig\.|table)\s*\w+[.:]?\s*", target, re.I)
    out = finds(target, 0)
    return out if out or not label else finds(target[label.end() :], label.end())


def with_title(text: str, first: int, last: int) -> str | None:
    """The text with headings first to last (from 0) joined as its only title, at its start; null where they are not neighbours.

    Other headings of level 1 go to level 2; nothing else is changed, and every other line keeps its place.
    """
    lines = text.split("\n")
    at = [k for k, line in enumerate(lines) if _HEADING.match(line)]
    if not 0 <= first <= last < len(at):
        return None
    run = at[first : last + 1]
    if any(lines[k].strip() for a, b in zip(run, run[1:], strict=False) for k in range(a + 1, b)):
        return None
    label = lambda k: _HEADING.sub("", lines[k], count=1).strip()
    title = "# " + " ".join(filter(None, map(label, run)))
    if title == "# ":
        return None
    rest = [re.sub(r"^( {0,3})#(?=[ \t]|$)", r"\1##", line) if k in at else line for k, line in enumerate(lines) if not run[0] <= k <= run[-1]]
    while rest and not rest[0].strip():
        rest.pop(0)
    return "\n".join([title, "", *rest]) if rest else title


def targets(documents: DataFrame) -> DataFrame:
    """doc_id, no, unit_type, raw, visible, emphasis (character ranges of the visible text) of the units that may bear style."""

    def kernel(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                for no, (kind, a, b) in enumerate(scan_units(text or "")):
                    raw = data[a:b].decode()
                    body = raw[len(re.match(CONTENT_MARKS.get(kind, ""), raw)[0]) :] if re.match(CONTENT_MARKS.get(kind, ""), raw) else raw
                    if kind in MAPPED and visible(body) is not None:
                        shown, spans = strip_emphasis(" ".join(body.split()))
                        rows.append((doc, no, kind, raw, shown, [{"start": x, "end": y} for x, y in spans]))
            made = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], ["doc_id", "no", "unit_type", "raw", "visible", "emphasis"])

    schema = "doc_id long, no long, unit_type string, raw string, visible string, emphasis array<struct<start:int,end:int>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def claims(hints: DataFrame, styled: DataFrame, other_styled: DataFrame, markdown: DataFrame) -> DataFrame:
    """claim_id, doc_id, source, evidence, protected, unit_no, start, end, text: what asks for emphasis, from four feeds.

    Each feed has doc_id, source, unit_no, start, end, text. Native documents and native style are protected, styles
    and Markdown of other sources are auxiliary; a claim of two feeds is that of the stronger one.
    """
    feeds = (("native_document", True, hints), ("native_style", True, styled), ("style", False, other_styled), ("markdown", False, markdown))
    columns = ["doc_id", "source", "unit_no", "start", "end", "text"]
    every = [df.select(*columns, F.lit(k).alias("rank"), F.lit(name).alias("evidence"), F.lit(kept).alias("protected")) for k, (name, kept, df) in enumerate(feeds)]
    rows = functools.reduce(DataFrame.union, every).groupBy(*columns).agg(F.min(F.struct("rank", "evidence", "protected")).alias("best"))
    name = F.sha2(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    return rows.select(name.alias("claim_id"), *columns, "best.evidence", "best.protected")


def paired_units(donors: list[tuple], finals: list[tuple]) -> list[tuple[int, int, str]]:
    """(donor, final, how) of donors (type, raw, protected) and final units (type, raw), each at most once.

    Keys that come once on either side first, then the order-preserving alignment where it is not ambiguous, then a
    last pair of one type, then for protected donors the one most similar unit that is left.
    """
    mine, theirs = [(d[0], folded_key(d[1])) for d in donors], [(f[0], folded_key(f[1])) for f in finals]
    once = lambda keys: {k: n for n, k in enumerate(keys) if keys.count(k) == 1}
    left, right = once(mine), once(theirs)
    out = [(n, right[k], "exact") for k, n in left.items() if k in right]

    def rest() -> tuple[list[int], list[int]]:
        return [n for n in range(len(donors)) if n not in {x[0] for x in out}], [n for n in range(len(finals)) if n not in {x[1] for x in out}]

    a, b = rest()
    out += [(a[i], b[j], "aligned") for i, j, _, doubt, _ in align_units([donors[n][:2] for n in a], [finals[n] for n in b]) if not doubt]
    a, b = rest()
    if len(a) == len(b) == 1 and donors[a[0]][0] == finals[b[0]][0]:
        out.append((a[0], b[0], "single"))
        a, b = rest()
    for n in (n for n in a if donors[n][2]):
        scores = sorted(((indel_ratio(mine[n][1], theirs[m][1]), -m) for m in rest()[1] if finals[m][0] == donors[n][0]), reverse=True)
        if scores and scores[0][0] >= FLOORS.get(donors[n][0], 42) and (len(scores) == 1 or scores[1][0] < scores[0][0]):
            out.append((n, -scores[0][1], "fuzzy"))
    return sorted(out)


def fallback_hints(hints: list[tuple], units: list[tuple]) -> list[tuple[int, int]]:
    """(hint, unit) for emphasised hints (region, type, text, unit or None, emphasised) that met no unit (region, type, raw), region by region."""
    taken = {h[3] for h in hints if h[3] is not None}
    out = []
    for region in dict.fromkeys(h[0] for h in hints):
        a = [n for n, h in enumerate(hints) if h[0] == region and h[3] is None and h[4]]
        b = [n for n, u in enumerate(units) if u[0] == region and n not in taken]
        out += [(a[i], b[j]) for i, j, _, doubt, _ in align_units([hints[n][1:3] for n in a], [units[n][1:3] for n in b]) if not doubt]
    return sorted(out)


def reference_marks(units: DataFrame) -> DataFrame:
    """doc_id, start, end, new: edits that number the references of each document from 1 on, for `fronts.edited`.

    units: doc_id, no, unit_type, raw, char_start. A mark of any kind (bullet, number, bracket, footnote) is replaced;
    an entry that is numbered right already needs no edit.
    """
    own = units.where("unit_type = 'reference'")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))
    mark = F.regexp_extract("raw", r"^(\s*(?:[-+*]|\[\^?\d{1,4}\]:?|\d{1,4}[.)])[ \t]+)", 1)
    new = F.concat(k.cast("string"), F.lit(". "))
    rows = own.select("doc_id", F.col("char_start").cast("int").alias("start"), (F.col("char_start") + F.length(mark)).cast("int").alias("end"), new.alias("new"), mark.alias("mark"))
    return rows.where("mark <> new").drop("mark")


def unmatched_receipts(receipts: DataFrame, traces: DataFrame) -> DataFrame:
    """doc_id, region, traces of selections (doc_id, region, request, choice, candidates) that do not have exactly one equal trace."""
    keys = ["doc_id", "region", "request", "choice", "candidates"]
    counted = traces.groupBy(*keys).agg(F.count("*").alias("traces"))
    both = receipts.select(*keys).join(counted, keys, "left").withColumn("traces", F.coalesce("traces", F.lit(0).cast("long")))
    return both.where("traces <> 1").select("doc_id", "region", "traces")
