import json

from pyspark.sql import functions as F

from vellum.operators.markup import style_lines
from vellum.sources import native

TEI = b"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>The <hi rend="italic">Title</hi></title></titleStmt></teiHeader><text>
<body><div><head coords="2,1,1">Intro</head><p coords="3,0">Some <hi style="italics">gene</hi>  text.</p><div><head>Deep</head></div></div></body>
<back><div><head>Notes</head></div><listBibl><biblStruct>Smith 2001</biblStruct></listBibl></back></text></TEI>"""
LAYOUT = json.dumps({"body": {"children": [{"$ref": "#/groups/0"}, {"cref": "#/texts/1"}, {"$ref": "#/texts/1"}]}, "groups": [{"self_ref": "#/groups/0", "children": [{"$ref": "#/texts/0"}]}], "texts": [
    {"self_ref": "#/texts/0", "label": "title", "text": "T", "prov": [{"page_no": 1}]}, {"self_ref": "#/texts/1", "label": "section_header", "level": 1, "text": "References", "prov": [{"page_no": 4}]}]}).encode()
BLOCKS = json.dumps({"block_type": "Document", "children": [{"block_type": "Page", "page_id": 2, "children": [{"block_type": "SectionHeader", "html": "<h3>Sec <i>x</i></h3>"}, {"block_type": "Text", "html": "<p>a &amp; b</p>"}]}]}).encode()
ALTO = b"""<alto><Styles><TextStyle ID="f1" FONTFAMILY="Times-Italic"/></Styles><Layout><Page><TextLine><String CONTENT="ab" STYLEREFS="f1" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"/><SP/><String CONTENT="c"/></TextLine></Page></Layout></alto>"""


def test_readers(spark):
    rows = [(1, "grobid", TEI), (1, "docling", LAYOUT), (1, "marker", BLOCKS), (2, "grobid", b"<broken"), (3, "html", b"<h2>A <em>b</em></h2><p>c</p>"), (4, "docling", None)]
    artifacts = spark.createDataFrame(rows, "doc_id long, source string, raw binary")
    found = native.hints(artifacts)
    got = {}
    for r in found.collect():
        got.setdefault((r.doc_id, r.source), []).append((r.role, r.level, r.region, r.page, r.text, [tuple(x) for x in r.italics]))
    assert got[1, "grobid"] == [
        ("heading", 1, "front", None, "The Title", [(4, 9)]), ("heading", 2, "body", 2, "Intro", []), ("paragraph", None, "body", 3, "Some gene text.", [(5, 9)]), ("heading", 3, "body", None, "Deep", []),
        ("heading", 2, "back", None, "Notes", []), ("reference", None, "back", None, "Smith 2001", []),
    ]
    assert got[1, "docling"] == [("heading", 1, "front", 1, "T", []), ("heading", 2, "back", 4, "References", [])]
    assert got[1, "marker"] == [("heading", 3, "body", 3, "Sec x", [(4, 5)]), ("paragraph", None, "body", 3, "a & b", [])]
    assert got[3, "html"] == [("heading", 2, "body", None, "A b", [(2, 3)]), ("paragraph", None, "body", None, "c", [])]
    assert sorted((r.doc_id, r.source) for r in native.unreadable(artifacts, found).collect()) == [(2, "grobid"), (4, "docling")]


def test_cells_lines_and_running_heads(spark):
    cells = native.style_cells(spark.createDataFrame([(1, ALTO)], "doc_id long, raw binary")).collect()
    assert [(c.page, c.line, c.text, c.italic, c.right, c.bottom) for c in cells] == [(1, 1, "ab", True, 4.0, 6.0), (1, 1, " ", False, 0.0, 0.0), (1, 1, "c", False, 0.0, 0.0)]
    words = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 1.0, 11.0), (1, 3, 20.0, 30.0)], "page int, cell int, top double, bottom double")
    assert [r.line_no for r in style_lines(words, ["page"]).orderBy("cell").collect()] == [1, 1, 2]
    found = spark.createDataFrame([(1, "Running Head"), (1, "Body")], "doc_id long, text string")
    tops = spark.createDataFrame([(1, 1, "running  head", 5.0, 100.0), (1, 2, "Running head", 5.0, 100.0), (1, 3, "Body", 50.0, 100.0)], "doc_id long, page int, text string, top double, height double")
    assert [r.text for r in native.furniture(found, tops).select(F.col("text")).collect()] == ["Body"]
