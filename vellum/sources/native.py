"""Native extractor structures as rows: TEI, layout JSON, block trees, ALTO and HTML.

Each reader is a plain function of one document's bytes; `hints` and `style_cells` run them over a table in
Arrow batches. A document that does not parse gives no rows and is named by `unreadable`.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HINT = "doc_id long, source string, ord int, role string, level int, region string, page int, text string, italics array<struct<start:int,end:int>>"
CELL = "doc_id long, page int, line int, cell int, text string, font string, italic boolean, left double, top double, right double, bottom double"


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _tei_text(node: ET.Element) -> tuple[str, list[tuple[int, int]]]:
    """Squeezed text of a node and the ranges of it that are italic."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []

    def add(text: str | None):
        for part in re.findall(r"\s+|\S+", text or ""):
            if part.isspace():
                if out and not out[-1].endswith(" "):
                    out.append(" ")
            else:
                out.append(part)

    def walk(n: ET.Element):
        begin = sum(map(len, out))
        add(n.text)
        for child in n:
            walk(child)
            add(child.tail)
        said = " ".join((n.get("rend") or "", n.get("style") or "", n.get("type") or "")).lower()
        end = sum(map(len, out))
        if _local(n.tag) == "hi" and "ital" in said and end > begin:
            spans.append((begin, end))

    walk(node)
    text = "".join(out)
    return text.rstrip(), [(a, min(b, len(text.rstrip()))) for a, b in spans]


def tei_hints(raw: bytes) -> Iterator[tuple]:
    """(role, level, region, page, text, italics) of a TEI document: its title, then body and back in order."""
    root = ET.fromstring(raw)
    for statement in root.iter():
        if _local(statement.tag) == "titleStmt":
            for child in statement:
                if _local(child.tag) == "title":
                    text, spans = _tei_text(child)
                    if text:
                        yield "heading", 1, "front", None, text, spans
                    break
            break
    roles = {"head": "heading", "p": "paragraph", "figDesc": "figure_caption", "formula": "equation", "note": "footnote", "biblStruct": "reference"}

    def walk(node: ET.Element, region: str, depth: int) -> Iterator[tuple]:
        for child in node:
            name = _local(child.tag)
            inner = depth + (name == "div")
            if name in roles:
                text, spans = _tei_text(child)
                page = (child.get("coords") or "").split(",")[0]
                if text:
                    yield roles[name], min(6, max(2, depth + 1)) if name == "head" else None, region, int(page) if page.isdigit() else None, text, spans
            else:
                yield from walk(child, region, inner)

    for part in root.iter():
        if _local(part.tag) in ("body", "back"):
            yield from walk(part, _local(part.tag), 0)


_LABELS = {"title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list", "caption": "figure_caption", "footnote": "footnote", "formula": "equation", "reference": "reference", "table": "table"}
_BACK = re.compile(r"^\W*(?:references|bibliography|literature cited|acknowledge?ments?|appendix)\b", re.I)


def layout_hints(raw: bytes) -> Iterator[tuple]:
    """The items of a layout document in reading order: children of the body, references resolved, each once."""
    doc = json.loads(raw)
    items = {i["self_ref"]: i for key in ("texts", "tables", "pictures", "groups", "key_value_items", "form_items") for i in doc.get(key) or [] if isinstance(i, dict) and "self_ref" in i}
    order, seen = [], set()

    def visit(refs) -> None:
        stack = list(reversed(refs or []))
        while stack:
            ref = stack.pop()
            name = ref.get("$ref") or ref.get("cref") if isinstance(ref, dict) else ref
            if name in seen or name not in items:
                continue
            seen.add(name)
            order.append(items[name])
            stack += reversed(items[name].get("children") or [])

    visit((doc.get("body") or {}).get("children"))
    region = "body"
    for item in order or doc.get("texts") or []:
        role, text = _LABELS.get(item.get("label")), (item.get("text") or "").strip()
        if not role or not text:
            continue
        title = item.get("label") == "title"
        if role == "heading" and _BACK.match(text):
            region = "back"
        prov = item.get("prov") or [{}]
        level = (1 if title else min(6, max(2, int(item.get("level") or 1) + 1))) if role == "heading" else None
        yield role, level, "front" if title else region, prov[0].get("page_no"), text, []


class InlineParser(HTMLParser):
    """Visible text of inline HTML with its first heading level and emphasised ranges."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.level: int | None = None
        self.spans: list[tuple[int, int]] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        if self.level is None and re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
        if tag in ("em", "i"):
            self.open.append(sum(map(len, self.parts)))

    def handle_endtag(self, tag):
        if tag in ("em", "i") and self.open:
            begin, end = self.open.pop(), sum(map(len, self.parts))
            if end > begin:
                self.spans.append((begin, end))

    def handle_data(self, data):
        self.parts.append(data)


def inline_html(html: str) -> tuple[str, int | None, list[tuple[int, int]]]:
    parser = InlineParser()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts), parser.level, sorted(parser.spans)


_BLOCKS = {"Title": "heading", "SectionHeader": "heading", "Text": "paragraph", "ListItem": "list", "Caption": "figure_caption", "Footnote": "footnote", "Reference": "reference", "Equation": "equation"}


def block_hints(raw: bytes) -> Iterator[tuple]:
    """The text blocks of a block tree, depth first; the page is page_id + 1 or part of the block's id."""
    region = "body"

    def walk(node: dict, page: int | None) -> Iterator[tuple]:
        nonlocal region
        if isinstance(node.get("page_id"), int) and not isinstance(node.get("page_id"), bool):
            page = node["page_id"] + 1
        elif (m := re.search(r"/page/(\d+)/", str(node.get("id") or ""))) :
            page = int(m[1]) + 1
        role = _BLOCKS.get(node.get("block_type"))
        if role:
            text, level, spans = inline_html(node.get("html") or "")
            if text.strip():
                if role == "heading" and _BACK.match(text):
                    region = "back"
                title = node["block_type"] == "Title"
                yield role, (1 if title else level or 2) if role == "heading" else None, "front" if title else region, page, text, spans
            return
        for child in node.get("children") or []:
            yield from walk(child, page)

    yield from walk(json.loads(raw), None)


def html_hints(raw: bytes) -> Iterator[tuple]:
    """Headings, paragraphs and list items of a web page."""
    for m in re.finditer(r"(?s)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</\1>", raw.decode("utf-8", "replace")):
        text, _, spans = inline_html(m[2])
        if text.strip():
            yield {"p": "paragraph", "li": "list"}.get(m[1], "heading"), int(m[1][1]) if m[1][0] == "h" else None, "body", None, text, spans


def alto_cells(raw: bytes) -> Iterator[tuple]:
    """(page, line, cell, text, font, italic, left, top, right, bottom) of an ALTO document."""
    styles: dict[str, tuple[str, bool]] = {}
    root = ET.fromstring(raw)
    for node in root.iter():
        if _local(node.tag) == "TextStyle":
            said = ((node.get("FONTSTYLE") or "") + " " + (node.get("FONTFAMILY") or "")).lower()
            styles[node.get("ID") or ""] = (node.get("FONTFAMILY") or "", "ital" in said or "oblique" in said)
    page = line = 0
    for node in root.iter():
        name = _local(node.tag)
        if name == "Page":
            page, line = page + 1, 0
        elif name == "TextLine":
            line += 1
            k = 0
            for child in node:
                kind = _local(child.tag)
                if kind not in ("String", "SP"):
                    continue
                k += 1
                font, italic = styles.get((child.get("STYLEREFS") or "").split(" ")[0], ("", False))
                x, y, w, h = (float(child.get(n) or 0) for n in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
                yield page, line, k, child.get("CONTENT") or " " if kind == "String" else " ", font, italic, x, y, x + w, y + h


READERS = {"grobid": tei_hints, "docling": layout_hints, "marker": block_hints, "html": html_hints}


def _safe(reader, raw) -> list[tuple]:
    try:
        return list(reader(bytes(raw or b"")))
    except (ValueError, ET.ParseError, AttributeError, TypeError, KeyError):
        return []


def hints(artifacts: DataFrame) -> DataFrame:
    """Structure hints of native artifacts (doc_id, source, raw), in reading order."""

    def kernel(frames):
        for frame in frames:
            rows = [(d, s, k, *h[:5], [{"start": a, "end": b} for a, b in h[5]]) for d, s, raw in frame.itertuples(index=False) if s in READERS for k, h in enumerate(_safe(READERS[s], raw))]
            out = pd.DataFrame(rows, columns=["doc_id", "source", "ord", "role", "level", "region", "page", "text", "italics"])
            yield out.astype({"level": "Int32", "page": "Int32"})

    return artifacts.select("doc_id", "source", "raw").mapInPandas(kernel, HINT)


def style_cells(artifacts: DataFrame) -> DataFrame:
    """Word cells of ALTO artifacts (doc_id, raw)."""

    def kernel(frames):
        for frame in frames:
            yield pd.DataFrame([(d, *c) for d, raw in frame.itertuples(index=False) for c in _safe(alto_cells, raw)], columns=[c.split()[0] for c in CELL.split(", ")])

    return artifacts.select("doc_id", "raw").mapInPandas(kernel, CELL)


def furniture(found: DataFrame, tops: DataFrame, share: float = 0.08) -> DataFrame:
    """doc_id, key of running heads: italic texts in the top share of two pages or more.

    tops has doc_id, page, text, top and height of italic lines.
    """
    from vellum.functions.text import comparison_key

    high = tops.where(F.col("top") <= F.col("height") * share).select("doc_id", "page", comparison_key(F.col("text")).alias("key"))
    heads = high.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n")).where("n >= 2").select("doc_id", "key")
    return found.join(heads, (found.doc_id == heads.doc_id) & (comparison_key(found.text) == heads.key), "left_anti")


def unreadable(artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """Artifacts that gave no hint."""
    return artifacts.join(found.select("doc_id", "source").distinct(), ["doc_id", "source"], "left_anti")
