import hashlib
import random
import re
import tracemalloc
import unicodedata

from vellum.operators import contracts, lexing, rules, style
from vellum.sources import case_folders

P = "paragraph"


def test_paragraphs_and_shingles(spark):
    text = "é one\ntwo\n\n\r\nthree\n\n\n\nfour\n"
    got = [(r.block, r.byte_start, r.byte_end) for r in lexing.paragraphs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("block_no").collect()]
    assert got == [("é one\ntwo", 0, 10), ("three", 14, 19), ("four\n", 23, 28)]
    assert all(text.encode()[a:b].decode() == t for t, a, b in got)
    words = [f"Wört{k}" for k in range(13)]
    rows = lexing.shingle_spans(spark.createDataFrame([(1, "* " + ", ".join(words)), (2, "a " * 30)], "doc_id long, text string")).orderBy("byte_start").collect()
    data = ("* " + ", ".join(words)).encode()
    assert [(r.doc_id, data[r.byte_start : r.byte_end].decode()) for r in rows] == [(1, ", ".join(words[:12])), (1, ", ".join(words[1:]))]
    assert rows[0].digest == hashlib.sha256(" ".join(w.casefold() for w in words[:12]).encode()).hexdigest()


def test_shingles_of_a_long_text_are_passed_on():
    """The kernel holds some tokens of a text, not all of its shingles: the first come before the text is read."""
    text = "word " * 400_000
    tracemalloc.start()
    parts = lexing.shingle_parts(text, 12, 8)
    assert next(parts)[1][:2] == [0, 5]
    assert sum(len(p[0]) for p in parts) == 400_000 - 11 - (lexing.HELD_TOKENS - 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(text)


def test_shingles_over_parts():
    """Shingles that begin in one part of a text and end in the next, with and without other letters, are those of a plain evaluation."""
    for letters in ("abC1 _", "aß\u0130ﬁé² -"):
        rng = random.Random(5)
        text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12_000))
        found = [(m.start(), m.end(), unicodedata.normalize("NFKC", m[0]).casefold()) for m in re.finditer(r"[^\W_]+", text)]
        place = [0]
        for c in text:
            place.append(place[-1] + len(c.encode()))
        want = [
            (hashlib.sha256(" ".join(w for *_, w in own).encode()).hexdigest(), place[own[0][0]], place[own[-1][1]])
            for own in (found[k : k + 5] for k in range(len(found) - 4))
            if sum(len(w) for *_, w in own) >= 14
        ]
        assert len(found) > lexing.HELD_TOKENS and 0 < len(want) < len(found)
        assert [x for p in lexing.shingle_parts(text, 5, 14) for x in zip(*p, strict=True)] == want


def test_mapped_lines(spark):
    units = [(P, "The *quick* brown fox", 1), (P, "jumps over the lazy dog", 1), ("table", "| quick |", 1), (P, "the lazy dog sleeps", 2)]
    assert style.mapped_lines(units, [("quick brown", 1), ("lazy dog", 2), ("over the", None)]) == [(0, 0), (1, 3)]
    assert style.mapped_lines(units, [("lazy dog", None), ("the quick", 1), ("", 1), (None, 1), ("sleeps", None)]) == [(1, 0), (4, 3)]
    u = spark.createDataFrame([(1, 10 * k, *x) for k, x in enumerate(units)], "doc_id long, no long, unit_type string, raw string, page int")
    s = spark.createDataFrame([(1, 7, "quick brown", 1), (1, 8, "lazy dog", 2), (2, 1, "x", 1)], "doc_id long, line_no long, text string, page int")
    assert sorted(map(tuple, style.line_units(u, s).collect())) == [(1, 7, 0), (1, 8, 30)]


def test_serialisation_and_claims():
    for raw in ("plain", "a *bc* d **ef**", "`x*y` *z*", "_a_ b"):
        text, places = style.serialisation_map(raw)
        assert len(text) == len(places) and all(raw[p] == c for c, p in zip(text, places, strict=True)) and places == sorted(places)
    assert style.claim_intervals("mice and mice, micelle", "mice") == [(0, 4), (9, 13)]
    assert style.claim_intervals("In  Vivo tests", "in vivo") == [(0, 8)] and style.claim_intervals("in vivo, In  Vivo and IN VIVO", "In vivo") == []
    assert style.claim_intervals("Figure 2. Shown", "shown") == [(10, 15)] and style.claim_intervals("abc", "") == [] == style.claim_intervals("abc", "zz")


def test_title():
    text = "# Journal\n\nnote\n\n# Big\n\n## Title\n\nbody\n# Abstract\nmore"
    assert style.with_title(text, 1, 2) == "# Big Title\n\n## Journal\n\nnote\n\n\nbody\n## Abstract\nmore"
    assert style.with_title(text, 0, 1) is None and style.with_title(text, 3, 4) is None and style.with_title("none", 0, 0) is None
    assert style.with_title("## Only", 0, 0) == "# Only"


def test_contracts(spark):
    ok = [("r", "keep_baseline", []), ("r", "select_candidates", ["a", "b"])]
    bad = {"region_id": ("", "keep_baseline", []), "action": ("r", "other", []), "kept_without_candidates": ("r", "keep_baseline", ["a"]), "selected_with_candidates": ("r", "select_candidates", []), "candidates_once": ("r", "select_candidates", ["a", "a"]), "candidates_named": ("r", "select_candidates", ["a", ""])}
    df = spark.createDataFrame([(k, *r) for k, r in enumerate([*ok, *bad.values()])], "id int, region_id string, action string, candidate_ids array<string>")
    assert sorted((r.id, r.rule) for r in rules.violations(df, "id", contracts.decision_rules()).collect()) == [(k, n) for k, n in enumerate(bad, 2)]
    regions = {
        "": ("r", "a", ["a", "b"], [["a"], ["b"]]), "candidates": ("r", "a", ["a", "a"], [["a"]]), "paths": ("r", "a", ["a"], [["a"], ["a"]]), "steps": ("r", "a", ["a", "b"], [["a"], ["b", "b"]]),
        "known_steps": ("r", "a", ["a"], [["a"], ["z"]]), "baseline_path": ("r", "a", ["a", "b"], [["b"]]), "region_id": ("", "a", ["a"], [["a"]]),
    }
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(regions.values())], "id int, region_id string, baseline string, candidates array<string>, paths array<array<string>>")
    assert sorted((r.id, r.rule) for r in rules.violations(df, "id", contracts.region_rules()).collect()) == [(k, n) for k, n in enumerate(regions) if n]
    h = "a" * 64
    base = ("c", "marker", h, "prose", 0, 5, h, h, [h], "shown")
    names = ["candidate_id", "source", "artifact_digest", "candidate_type", "byte_start", "byte_end", "visible_digest", "ast_digest", "emphasis_ids", "display"]
    change = {"": {}, "source": {1: "x"}, "artifact_digest": {2: "q"}, "candidate_type": {3: "x"}, "byte_range": {5: 0}, "paired_digests": {7: None}, "emphasis_ids": {8: ["z"]}, "display": {9: "x" * 5000}, "emphasis_has_digests": {6: None, 7: None}, "candidate_id": {0: ""}, "digests": {7: "zz"}}
    rows = [(k, *(c.get(i, v) for i, v in enumerate(base))) for k, c in enumerate(change.values())]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} {'int' if n.startswith('byte') else 'array<string>' if n == 'emphasis_ids' else 'string'}" for n in names))
    assert sorted((r.id, r.rule) for r in rules.violations(df, "id", contracts.evidence_rules()).collect()) == [(k, n) for k, n in enumerate(change) if n]


def test_case_folders(spark, tmp_path):
    for folder, names in {"b": ["run.json", "x.md"], "a": ["status.json", "run.json"], "c": ["other.json"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("{}")
    assert [(r.folder, r.marks) for r in case_folders(spark, str(tmp_path)).collect()] == [("a", ["run.json", "status.json"]), ("b", ["run.json"])]


def test_targets(spark):
    text = "# A *big* title\n\nSome _plain_ text\nin two lines\n\n| a |\n\n- item *x*\n\nwith `code`"
    got = [(r.no, r.unit_type, r.visible, [tuple(e) for e in r.emphasis]) for r in style.targets(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()]
    assert got == [(0, "heading", "A big title", [(2, 5)]), (1, P, "Some plain text in two lines", [(5, 10)]), (3, "list", "item x", [(5, 6)])]


def test_claims(spark):
    feed = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "doc_id long, source string, unit_no int, start int, end int, text string")
    a, b = ("grobid", 0, 1, 2, "x"), ("marker", 0, 4, 5, "y")
    got = style.claims(feed(a), feed(a, b), feed(b), feed(("marker", 1, 0, 3, "z"))).collect()
    assert sorted((r.text, r.evidence, r.protected) for r in got) == [("x", "native_document", True), ("y", "native_style", True), ("z", "markdown", False)]
    assert len({r.claim_id for r in got}) == 3


def test_pairing():
    donors = [(P, "alpha beta gamma delta", True), (P, "the second text of them", False), (P, "same", True), (P, "same", True), ("list", "- only item here", False), (P, "zebra yak xylophone", True)]
    finals = [(P, "alpha beta gamma delta"), (P, "the second text of these"), ("list", "- only one item"), (P, "zebra yak and xylophones")]
    got = {(a, b): how for a, b, how in style.paired_units(donors, finals)}
    assert got[0, 0] == "exact" and got[1, 1] == "aligned" and got[5, 3] == "aligned" and all(a not in (2, 3) for a, _ in got)
    # the order keeps the second from being aligned; a protected donor still finds its unit
    swapped = style.paired_units([(P, "first of all the texts", True), (P, "zebra yak xylophone", True)], [(P, "zebra yak xylophones"), (P, "first of all these texts")])
    assert sorted((a, b) for a, b, _ in swapped) == [(0, 1), (1, 0)] and {how for *_, how in swapped} == {"aligned", "single"}


def test_fallback_hints():
    hints = [("body", P, "one two three four", None, True), ("body", P, "not emphasised at all", None, False), ("back", P, "five six seven eight", None, True), ("body", P, "taken", 1, True)]
    units = [("body", P, "one two three four five"), ("body", P, "taken"), ("body", P, "five six seven eight"), ("back", P, "five six seven eight nine")]
    assert style.fallback_hints(hints, units) == [(0, 0), (2, 3)]


def test_reference_marks(spark):
    from vellum.operators import fronts

    text = "[4] Smith\n- Doe\n3. Roe\nBare"
    units = [(1, k, "reference", raw, text.index(raw)) for k, raw in enumerate(text.split("\n"))]
    edits = style.reference_marks(spark.createDataFrame(units, "doc_id long, no int, unit_type string, raw string, char_start int"))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert edits.count() == 3 and fronts.edited(docs, edits).first().text == "1. Smith\n2. Doe\n3. Roe\n4. Bare"


def test_receipts(spark):
    schema = "doc_id long, region string, request string, choice int, candidates array<string>"
    receipts = spark.createDataFrame([(1, "r0", "q", 1, ["a"]), (1, "r1", "q", 2, ["b"]), (1, "r2", "q", 0, [])], schema)
    traces = spark.createDataFrame([(1, "r0", "q", 1, ["a"]), (1, "r1", "q", 2, ["b"]), (1, "r1", "q", 2, ["b"]), (1, "r2", "p", 0, [])], schema)
    assert sorted(map(tuple, style.unmatched_receipts(receipts, traces).collect())) == [(1, "r1", 2), (1, "r2", 0)]
