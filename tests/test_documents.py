from pyspark.sql import functions as F

from vellum.operators import assembly, lexing, metrics, selection, skeleton


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=str)


def test_choices_answers_and_labels(spark):
    regions = spark.createDataFrame([(1, "r1", "b", ["b", "x", "y"]), (1, "r2", "c", ["z"]), (1, "r3", "d", [])], "doc_id long, region string, baseline string, paths array<string>")
    choices = selection.numbered_choices(regions)
    assert rows(choices.where("region = 'r1'"), "choice", "candidate") == [(0, "b"), (1, "x"), (2, "y")]
    digests = selection.request_digest(choices)
    digest = digests.first().digest
    answers = spark.createDataFrame([(1, "r1", 2, digest), (1, "r2", 9, digest), (1, "r3", 0, "stale")], "doc_id long, region string, choice int, digest string")
    decided = selection.decode_response(choices, answers, digests)
    assert rows(decided, "region", "candidate", "method") == [("r1", "y", "model_selected"), ("r2", "c", "baseline_fallback"), ("r3", "d", "baseline_fallback")]
    assert selection.outcome_label(decided).first().quality == "baseline_fallback"
    assert selection.valid_decisions(decided, regions).count() == 3


def test_risk_routes_and_preferences(spark):
    c = spark.createDataFrame([(1, "a", "paragraph", "same", ""), (1, "a", "paragraph", "same", "i"), (1, "b", "paragraph", "has 5", ""), (1, "c", "paragraph", "words", ""), (1, "c", "paragraph", "other", "")], "doc_id long, region string, unit_type string, visible string, emphasis string")
    risks = selection.risk(c)
    assert rows(risks, "region", "risk") == [("a", "format_conflict"), ("b", "protected_payload"), ("c", "ordinary")]
    one = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "doc_id long, region string, choice int")
    two = spark.createDataFrame([(1, "a", 3)], one.schema)
    assert rows(selection.route(risks, one, two), "region", "tier", "choice") == [("a", "second", 3), ("b", "baseline", 0), ("c", "first", 2)]
    v = c.where("region = 'a'").withColumn("source", F.when(F.col("emphasis") == "", "grobid").otherwise("marker"))
    assert rows(selection.italic_preference(v, {"grobid": 3, "marker": 1})) == [(1, "a", "marker")]
    t = spark.createDataFrame([(1, "m", 10, "words", "", False), (1, "d", 9, "words", "", False), (2, "m", 1, "x", "y", False), (3, "m", 1, "x", "y", True)], "doc_id long, source string, bytes int, strict_reasons string, relaxed_reasons string, unsafe boolean")
    assert rows(selection.relaxed_baseline(t)) == [(1, "m", 1), (2, "m", 2)]


def test_assembly_is_an_exact_partition(spark):
    base = spark.createDataFrame([(1, "docling", "aé one two\nend"), (2, "docling", "whole")], "doc_id long, source string, text string")
    other = spark.createDataFrame([(1, "grobid", "xx ONE yy")], base.schema)
    picks = spark.createDataFrame([(1, 4, 7, "grobid", "xx ONE yy", 3, 6, "deterministic")], "doc_id long, start long, end long, source string, src_text string, src_start long, src_end long, method string")
    lineage = assembly.provenance(base, picks)
    made = assembly.assembled(lineage)
    assert rows(made) == [(1, "aé ONE two\nend"), (2, "whole")]
    assert rows(assembly.lineage_faults(lineage, made, base.union(other))) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    broken = lineage.withColumn("src_start", F.when(F.col("method") == "deterministic", F.col("src_start") - 1).otherwise(F.col("src_start")))
    assert rows(assembly.lineage_faults(broken, made, base.union(other)), "doc_id", "foreign") == [(1, 1), (2, 0)]
    assert rows(assembly.lineage_faults(lineage.where("ord <> 2"), made, base.union(other)), "doc_id", "gaps") == [(1, 1), (2, 0)]
    cuts = spark.createDataFrame([(1, "c", 5, 9)], "doc_id long, cut string, start long, end long")
    assert rows(assembly.clip_ranges(lineage, cuts), "source", "src_start", "src_end", "out_start", "out_end") == [("docling", 7, 9, 2, 4), ("grobid", 4, 6, 0, 2)]
    bad = spark.createDataFrame([(1, 0, 5), (1, 4, 6), (2, 0, 1), (2, 1, 2)], "doc_id long, start long, end long")
    assert rows(assembly.graph_faults(bad)) == [(1, 1), (2, 0)]


def test_line_ends_permutation_and_events(spark):
    t = spark.createDataFrame([(1, "a\n\n\n"), (2, "b"), (3, "c\n")], "doc_id long, text string")
    assert rows(assembly.one_line_end(t)) == [(1, "a\n", 2, 0), (2, "b\n", 0, 1), (3, "c\n", 0, 0)]
    p = spark.createDataFrame([(1, 0, "refs", 4), (1, 1, "é", 0), (1, 2, "body", 2)], "doc_id long, ord int, piece string, rank int")
    assert rows(assembly.permute(p, "rank"), "ord", "new_ord", "out_start", "out_end") == [(0, 3, 6, 10), (1, 1, 0, 2), (2, 2, 2, 6)]
    e = spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "doc_id long, event_id string, seq int")
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 9)], "doc_id long, event_id string, out_start int")
    assert rows(assembly.reconcile(e, a), "event_id", "k", "state") == [("x", 1, "kept"), ("x", 2, "lost"), ("y", 1, "unannounced")]


def test_preservation_metrics(spark):
    s = "doc_id long, unit_type string, key string, ord int"
    before, after = spark.createDataFrame([(1, "p", "a", 0), (1, "p", "a", 1), (1, "p", "b", 2)], s), spark.createDataFrame([(1, "p", "a", 7), (1, "h", "c", 8)], s)
    assert rows(metrics.emphasis_preservation(before, after)) == [(1, 3, 1, 2, 1)]
    s = "doc_id long, ord int, role string, digest string"
    want = spark.createDataFrame([(1, 0, "body", "a"), (1, 1, "body", "b"), (1, 2, "back", "c"), (1, 3, "back", "d")], s)
    seen = spark.createDataFrame([(1, 0, "body", "b"), (1, 1, "front", "a"), (1, 2, "back", "c"), (1, 3, "x", "e")], s)
    assert rows(metrics.reader_report(want, seen)) == [(1, 4, 1, 1, 1, 1, 750000)]
    c = spark.createDataFrame([(1, "g", [2, 1, 2], 2, 2), (2, "g", [1, 3], 3, 3), (3, "g", [1], 1, 2)], "doc_id long, source string, pages array<int>, expected int, counted int")
    assert rows(metrics.page_proof(c), "doc_id", "verified", "reason") == [(1, True, ""), (2, False, "pages_missing"), (3, False, "count_mismatch")]
    claims = spark.createDataFrame([(1, k, "g", "native") for k in range(4)], "doc_id long, claim int, source string, evidence string")
    events = spark.createDataFrame([(1, 0, "projected"), (1, 1, "declined"), (1, 1, "declined")], "doc_id long, claim int, outcome string")
    assert rows(metrics.claim_receipt(claims, events)) == [("g", "native", 4, 1, 0, 1, 2, 1)]
    o = spark.createDataFrame([(1, "t", 0, 4), (1, "t", 4, 6), (1, "t", 8, 9)], "doc_id long, target string, start int, end int")
    assert rows(metrics.overlay(o)) == [(1, "t", 0, 6, 2), (1, "t", 8, 9, 1)]


def test_skeleton(spark):
    text = "# Title\nwords\n## Methods\n### A\n### B\n## Results\n#### Deep\n## References\n| a | b |\n| c | d |"
    own = lexing.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    found = skeleton.occurrence_ids(skeleton.slot_paths(skeleton.regions(skeleton.headings(own))))
    assert [(r.line_no, r.level, r.region, r.path) for r in found.orderBy("line_no").collect()] == [
        (0, 1, "front", "title"), (2, 2, "body", "title/methods"), (3, 3, "body", "title/methods/a"), (4, 3, "body", "title/methods/b"), (5, 2, "body", "title/results"), (6, 4, "body", "title/results/deep"), (7, 2, "back", "title/references"),
    ]
    assert found.select("slot").distinct().count() == 7
    assert rows(skeleton.depth_fixes(skeleton.headings(own))) == [(1, 6, 4, 3)]
    assert rows(skeleton.missing_separators(own)) == [(1, 8, 2)]
    c = spark.createDataFrame([(1, "refs", "references", 0), (1, "intro", "body", 1), (1, "abs", "abstract", 2), (1, "more", "body", 3)], "doc_id long, container string, role string, old_no int")
    assert rows(skeleton.container_order(c), "new_no", "container") == [(0, "abs"), (1, "intro"), (2, "more"), (3, "refs")]
