from pyspark.sql import functions as F

from vellum.operators import composites as m
from vellum.operators import fronts

P = "paragraph"


def test_bundles():
    long = "the quick brown fox jumps over the lazy dog and runs away into the green wood beyond the hill"
    assert m.bundle_compatible([(P, long), (P, long.replace("lazy", "sleepy"))])
    assert not m.bundle_compatible([(P, long)]) and not m.bundle_compatible([(P, long), ("list", long)])
    assert not m.bundle_compatible([(P, long), (P, "xyz")])
    assert not m.bundle_compatible([(P, "a b c d e f " * 9), (P, "a b c d f e " * 9)])  # no token that says anything
    assert m.bundle_compatible([("heading", "Results and data"), ("heading", "RESULTS AND  DATA")])


def test_coverage():
    assert m.keeps_coverage("one two", "one two three") and m.keeps_coverage("one, two!", "one two")
    assert not m.keeps_coverage("one two three", "one two")
    # as many letters, but some of them are gone
    assert not m.keeps_coverage("alpha beta", "beta gamma delta") and m.keeps_coverage("Alpha", "alpha")


HEAD, TAIL = ("heading", "# Methods"), ("heading", "# Results")
A, B = "We grew the cells in rich medium for two days.", "Then we froze all of them at minus eighty degrees."


def test_split_and_joined_runs():
    one, two = [HEAD, (P, f"{A} {B}"), TAIL], [HEAD, (P, A), (P, B), TAIL]
    assert m.composite_matches(one, two) == [(1, 1, 1, 2)] and m.composite_matches(two, one) == [(1, 2, 1, 1)]
    assert m.composite_matches([HEAD, (P, A), (P, B), TAIL], [HEAD, (P, A[:20]), (P, A[20:] + " " + B), TAIL]) == [(1, 2, 1, 2)]
    assert m.composite_matches(two, two) == [] and m.composite_matches(one, [HEAD, (P, f"{A} {B} more"), TAIL]) == []
    # the other side loses words; a table row is no part of a run; code is not joined
    assert m.composite_matches(one, [HEAD, (P, A), (P, B[:20]), TAIL]) == []
    assert m.composite_matches(one, [HEAD, (P, A), ("table", B), TAIL]) == [] and m.composite_matches(one, [HEAD, (P, A + " `x`"), (P, B), TAIL]) == []
    assert m.composite_matches(one, [HEAD, *((P, w) for w in f"{A} {B}".split()), TAIL]) == []


def test_composites_frame(spark):
    def frame(*docs):
        return spark.createDataFrame([(d, 10 * k, kind, raw) for d, units in docs for k, (kind, raw) in enumerate(units)], "doc_id long, no long, unit_type string, raw string")

    one, two = [HEAD, (P, f"{A} {B}"), TAIL], [HEAD, (P, A), (P, B), TAIL]
    got = m.composites(frame((1, one), (2, two), (3, one)), frame((1, two), (2, one), (4, one))).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 10, 10, 20), (2, 10, 20, 10, 10)]
    assert m.composites(frame((1, one)).limit(0), frame((1, two))).count() == 0


def test_clipping(spark):
    before, after = (P, "and so the experiment ended"), (P, "afterwards nothing happened here")
    raw = "the experiment ended when all was done, afterwards nothing"
    start, end, fault = m.clip(raw, P, before, after)
    assert (raw.encode()[start:end].decode(), fault) == (" when all was done,", "")
    assert m.clip(raw, P, None, None) == (0, len(raw), "") and m.clip("so it", P, (P, "and so it"), None) == (0, 5, "")
    assert m.clip("the experiment ended", P, before, None)[2] == "empty"
    assert m.clip("1. the experiment ended here", "list", before, None) == (23, 28, "")
    base = spark.createDataFrame([(1, 0, *before), (1, 1, P, "x"), (1, 2, *after), (2, 0, P, "alone")], "doc_id long, no long, unit_type string, raw string")
    asked = spark.createDataFrame([(1, 1, P, raw), (2, 0, P, raw), (1, 9, P, raw)], "doc_id long, no long, unit_type string, raw string")
    assert sorted(map(tuple, m.clipped_units(asked, base).collect())) == [(1, 1, start, end, ""), (2, 0, 0, len(raw), "")]


def test_spill():
    units = [(P, f"unit number {k} speaks about subject{k} and matter{k} at some length") for k in range(80)]
    assert not m.spilled(units, 10, (P, units[10][1] + " with a few new words"))
    assert m.spilled(units, 10, (P, units[10][1] + " subject30 and matter30 at some length"))
    assert m.spilled(units, 10, (P, units[10][1] + " subject12"))  # a whole new segment
    assert not m.spilled(units, 10, (P, units[10][1] + " subject11")) and not m.spilled(units, 0, (P, units[0][1] + " subject79"))


def test_title_runs(spark):
    rows = [(1, 1, "Big", False), (1, 2, "Title", True), (1, 3, "Part", True), (1, 4, "Abstract", False), (2, 1, "--", False)]
    got = fronts.title_runs(spark.createDataFrame(rows, "doc_id long, ordinal int, label string, alone boolean")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, "Big"), (1, 1, 2, "Big Title"), (1, 1, 3, "Big Title Part"), (1, 2, 2, "Title"), (1, 2, 3, "Title Part"), (1, 3, 3, "Part"), (1, 4, 4, "Abstract")]


def test_edits(spark):
    docs = spark.createDataFrame([(1, "héllo world"), (2, "abc"), (3, "abc"), (4, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 6, 11, "there"), (1, 0, 1, "J"), (1, 5, 5, ","), (2, 0, 2, "x"), (2, 1, 3, "y")], "doc_id long, start int, end int, new string")
    assert {r.doc_id: (r.text, r.n_edits) for r in fronts.edited(docs, edits).collect()} == {1: ("Jéllo, there", 3), 2: (None, 2), 3: ("abc", 0), 4: (None, 0)}


def test_balance_and_safety(spark):
    want = {
        "ok\n```\n$$\n```\n$$a$$": "", "```\nx": "unbalanced_backtick_fence", "~~~\n```": "unbalanced_tilde_fence", "$$\na": "unbalanced_display_equation", "\\[ a\n\\]\n\\]": "orphan_bracket_equation_close", "\\[\nx": "unbalanced_bracket_equation",
        "a\u200bb\n\\]\n\\]": "orphan_bracket_equation_close,publishable_text",
    }
    df = spark.createDataFrame(list(enumerate([*want, None])), "doc_id long, text string")
    assert [r.reasons for r in fronts.safety_reasons(df).orderBy("doc_id").collect()] == [*want.values(), ""]


def test_markup_shapes(spark):
    rows = [("selected_document_skeleton", "###", True, False), ("selected_document_skeleton", "#######", False, False), ("alliance_reference_marker", "12. ", True, False), ("alliance_reference_marker", "0. ", False, False), ("trailing_newline_normalization", "\n", True, True),
            ("alliance_bibliography_heading_boundary", "\n\n", True, True), ("alliance_bibliography_heading_boundary", "\n\n\n", False, False), ("alliance_table_separator", "|---|---|\n", True, False), ("other", "x", False, False), ("native_emphasis_projection", "*\n", False, False)]
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "k int, op string, span string")
    got = df.select("k", fronts.markup_fits(F.col("op"), F.col("span")).alias("a"), fronts.owned_left(F.col("op"), F.col("span")).alias("b")).orderBy("k").collect()
    assert [(r.a, r.b) for r in got] == [r[2:] for r in rows]


def test_risk(spark):
    rows = [(1, 0, "prose", "some *x*", "some x", "e1"), (1, 0, "prose", "some x", "some x", ""), (1, 1, "prose", "a 5", "a 5", ""), (1, 1, "prose", "a b", "a b", ""), (1, 2, "citation", "q", "q", ""), (1, 3, "prose", "q", "q", ""), (1, 3, "prose", "r", "r", "")]
    got = fronts.risk_reasons(spark.createDataFrame(rows, "doc_id long, region int, candidate_type string, raw string, visible string, emphasis string")).collect()
    assert {r.region: r.reason for r in got} == {0: "protected_format_conflict", 1: "protected_payload_conflict", 2: "protected_payload_conflict", 3: None}


def test_alignment_by_anchor_tokens_and_slots():
    from vellum.operators.alignment import align_units, candidate_pairs

    # far off the diagonal: found by rare anchor tokens, not by short words
    base = [(P, f"alpha{k} is of it") for k in range(200)]
    other = [*base[150:], *base[:150]]
    assert (160, 10) in candidate_pairs(base, other) and (160, 110) not in candidate_pairs(base, other)
    short = [(P, f"is of it {chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(200)]
    assert all(j == (i + 50) % 200 or abs(i - j) <= 48 for i, j in candidate_pairs(short, [*short[150:], *short[:150]]))
    # slots that differ are not aligned, a missing slot fits any
    one = [("heading", "Results", "a"), ("heading", "Results", "b")]
    assert [(i, j) for i, j, *_ in align_units(one, [("heading", "Results", "b")])] == [(1, 0)]
    assert [(i, j) for i, j, *_ in align_units(one, [("heading", "Results", "c"), ("heading", "Results", None)])] == [(1, 1)]
    line = "some words here and there in the field"
    found = align_units([(P, line)], [(P, line + "!"), (P, line), (P, "nothing alike")])
    assert found == [(0, 1, 100.0, True, [0])]
