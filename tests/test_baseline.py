from vellum.operators import baseline as m

BODY = "\n\n".join(f"Paragraph {k} tells of cells{k} that were grown in medium{k} for several days and then counted by eye in the usual way." for k in range(8))
FULL = f"# Title\n\n## Abstract\n\n{BODY}\n\n## Methods\n\nWe did things.\n\n## References\n\n1. Smith J 2001."


def outcome(found):
    return {s: v[0] for s, v in found.items()}


def test_floors():
    want = {
        "": "empty", "x​y " * 60: "forbidden_controls", "word": "too_few_words+too_few_structural_units+too_few_content_bytes+insufficient_document_structure+missing_required_heading:abstract|introduction|background+missing_required_heading:method|result|discussion|experimental|conclusion+missing_required_heading:"
        + "|".join(m.HEADING_GROUPS[2]),
        FULL.replace("## Methods", "## Other"): "missing_required_heading:method|result|discussion|experimental|conclusion", FULL + "\n\n```\nx": "unbalanced_backtick_fence",
    }
    for text, why in want.items():
        assert m.judge_versions({"grobid": (text, False)}) == {"grobid": ("rejected_absolute_floor", why, None)}
    assert outcome(m.judge_versions({"marker": (FULL, False)})) == {"marker": "selected"}


def test_rank_agreement_and_verification():
    same = {"grobid": (FULL, False), "docling": (FULL, False), "marker": (FULL, False)}
    assert outcome(m.judge_versions(same)) == {"grobid": "selected", "docling": "eligible_not_selected", "marker": "eligible_not_selected"}
    assert outcome(m.judge_versions({**same, "marker": (FULL, True)}))["marker"] == "selected"
    odd = FULL.replace("were grown", "wxyz qrstv")
    assert outcome(m.judge_versions({**same, "grobid": (odd, False)}))["docling"] == "selected"
    short = FULL.replace("\n\n".join(BODY.split("\n\n")[:6]) + "\n\n", "")
    assert outcome(m.judge_versions({**same, "grobid": (short, False)})) == {"grobid": "rejected_relative_floor", "docling": "selected", "marker": "eligible_not_selected"}


def test_repetition_is_set_aside():
    again = FULL.replace(BODY, "\n\n".join([BODY] * 4))
    assert m.repeats_itself(again) and not m.repeats_itself(FULL)
    got = m.judge_versions({"grobid": (again, False), "marker": (FULL.replace(BODY, BODY + "\n\n" + BODY.replace("Paragraph", "Section")), False)})
    assert outcome(got) == {"grobid": "quarantined_repetition", "marker": "selected"}
    # where all repeat, one of them is delivered all the same
    assert outcome(m.judge_versions({"grobid": (again, False), "marker": (again, False)})) == {"grobid": "selected", "marker": "eligible_not_selected"}


def test_frame(spark):
    df = spark.createDataFrame([(1, "grobid", FULL), (1, "marker", None), (2, "docling", "")], "doc_id long, source string, text string")
    got = {(r.doc_id, r.source): (r.outcome, r.agreement) for r in m.baseline_choice(df).collect()}
    assert got == {(1, "grobid"): ("selected", 100.0), (1, "marker"): ("rejected_absolute_floor", None), (2, "docling"): ("rejected_absolute_floor", None)}
    assert m.baseline_choice(df.limit(0)).count() == 0
