import json
import unicodedata

from pyspark.sql import functions as F

from vellum.functions import scalars as sc
from vellum.operators import rules, service

SPAN = "array<struct<native_id:string,text:string,spans:array<struct<start:int,end:int>>>>"


def test_unicode_scalars(spark):
    rows = [("Straße  ﬁne",), ("é x",), ("１２–３.４ ٣ x−5",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(sc.folded(F.col("t")).alias("k"), sc.visible_text(F.col("t")).alias("v"), sc.ascii_numerals(F.col("t")).alias("n")).collect()
    assert [r.k for r in got] == ["strasse fine", "é x", "12–3.4 ٣ x−5", None, ""]
    assert got[1].v == unicodedata.normalize("NFC", "é x") and got[0].v == "Straße ﬁne"
    assert got[2].n == "12-3.4 3 x-5"


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": null, "c": [{"y": null, "x": 2}, null]}'), (2, "no json"), (3, None), (4, "3.5")], "id long, payload string")
    got = {r.id: r.payload for r in service.canonical_json(df).collect()}
    assert got == {1: '{"b":1,"c":[{"x":2},null]}', 2: None, 3: None, 4: "3.5"}


def test_style_faults(spark):
    line = lambda name, text, *spans: (name, text, [*spans])
    rows = [
        (1, 0, 1, [line("a", "hello", (0, 2), (2, 5))]), (1, 1, 3, [line("b", "x")]),
        (2, 0, 2, [line("", "x")]), (2, 1, 2, [line("c", "abc", (1, 4))]),
        (3, 0, 0, []), (4, 0, 1, [line("a", "abcdef", (0, 3), (2, 4))]), (5, 0, 1, [line("a", "abc", (2, 2))]), (6, 0, None, []),
    ]
    got = {(r.doc_id, r.rule) for r in service.style_faults(spark.createDataFrame(rows, f"doc_id long, ord int, page_no int, lines {SPAN}")).collect()}
    assert got == {(2, "line_identity"), (2, "page_order"), (2, "span"), (3, "page_order"), (4, "span"), (5, "span"), (6, "page_order")}


GOOD = {
    "id": 0, "body": 10, "mapped_body": 9, "retained": 7, "excluded": 3, "style": 5, "mapped_style": 4, "unmapped_style": 1, "auxiliary": 2, "intervals": 6, "existing_intervals": 4, "new_intervals": 2,
    "direct_retained": 3, "deterministic": 5, "model_selected": 1, "ties": 3, "numbered_ties": 2, "model_calls": 1, "exclusion_reasons": {"no_match": 2, "twice": 1}, "auxiliary_outcomes": {"kept": 2},
    "protected_outcomes": {"retained": 7, "unresolved": 3}, "selection_outcomes": {"selected": 1, "none": 2}, "selection_sizes": {"2": 2, "11": 1}, "evidence_ready": True, "evidence_failures": [], "all_retained": False, "claims_digest": "0" * 64,
}
TAMPERED = {
    "counters": {"model_selected": -1}, "exclusion_reasons": {"exclusion_reasons": {"no_match": 2}}, "auxiliary_outcomes": {"auxiliary_outcomes": {}}, "mapped_within_body": {"mapped_body": 11}, "style_parts": {"unmapped_style": 2},
    "evidence_ready": {"evidence_failures": ["marker"]}, "all_retained": {"all_retained": True}, "protected_outcomes": {"protected_outcomes": {"retained": 8, "unresolved": 3}}, "unresolved_is_excluded": {"protected_outcomes": {"retained": 8, "unresolved": 2}},
    "interval_parts": {"new_intervals": 3}, "interval_targets": {"deterministic": 6}, "calls_within_ties": {"model_calls": 4}, "numbered_within_ties": {"numbered_ties": 4}, "selection_outcomes": {"selection_outcomes": {"won": 3}},
    "selection_sizes": {"selection_sizes": {"0": 3}}, "direct_within_retained": {"direct_retained": 8}, "claims_digest": {"claims_digest": "ab"}, "retained_and_excluded": {"retained": 8},
}


def test_receipt_rules(spark):
    """Each tampering breaks its own rule; the sound receipt breaks none."""
    names = list(TAMPERED)
    kinds = {"exclusion_reasons": "map<string,bigint>", "auxiliary_outcomes": "map<string,bigint>", "protected_outcomes": "map<string,bigint>", "selection_outcomes": "map<string,bigint>", "selection_sizes": "map<string,bigint>", "evidence_ready": "boolean", "evidence_failures": "array<string>", "all_retained": "boolean", "claims_digest": "string"}
    rows = [GOOD, *({**GOOD, "id": k + 1, **TAMPERED[n]} for k, n in enumerate(names))]
    df = spark.createDataFrame([tuple(r[c] for c in GOOD) for r in rows], ", ".join(f"{c} {kinds.get(c, 'long')}" for c in GOOD))
    found = {}
    for r in rules.violations(df, "id", service.receipt_rules()).collect():
        found.setdefault(r.id, set()).add(r.rule)
    assert 0 not in found
    assert all(n in found[k + 1] for k, n in enumerate(names))
    # what a tampering breaks beside its own rule are only rules over the same counter
    assert {n for k, n in enumerate(names) if found[k + 1] != {n}} <= {"counters", "retained_and_excluded", "all_retained", "protected_outcomes"}
    assert set(service.receipt_rules()) == set(names)


def test_flattened_keys_of_broken_json(spark):
    df = spark.createDataFrame([(1, '{"a": "x/y", "b": [1, "p/q"]}'), (2, "{"), (3, None), (4, json.dumps("a/b"))], "id long, payload string")
    assert sorted((r.id, r.path, r.value) for r in service.flattened_keys(df).collect()) == [(1, "$.a", "x/y"), (1, "$.b[1]", "p/q"), (4, "$", "a/b")]
