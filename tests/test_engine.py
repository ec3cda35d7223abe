import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum import sources, streaming
from vellum.functions import kernels, text
from vellum.operators import alignment, baseline, composites, markup, rules, runs, usage
from vellum.plans import documents, service  # noqa: F401  they register their queries
from vellum.plans.catalogue import ORACLES, QUERIES, versions

SF = "/root/testdata/sf0.001"


def lines_of(spark):
    return {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_aligned_units_query(spark):
    """Every document against the kernel on its own lines."""
    got = {}
    for r in QUERIES["aligned_units"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.base_no, r.other_no, r.similarity, r.ambiguous, r.competing))
    for doc, lines in lines_of(spark).items():
        base = [(k, x) for k, x in enumerate(lines) if x]
        other = [(k, x.replace("th", "h")) for k, x in base if k % 7 != 6]
        want = alignment.align_units([("paragraph", x) for _, x in base], [("paragraph", x) for _, x in other])
        assert sorted(got.get(doc, [])) == sorted((base[i][0], other[j][0], s, c, [other[k][0] for k in more]) for i, j, s, c, more in want)


def test_composite_and_clipped_queries(spark):
    base, other = documents._units(spark.read.parquet(f"{SF}/documents.parquet"))
    sides = []
    for df in (base, other):
        held = {}
        for r in df.orderBy("doc_id", "no").collect():
            held.setdefault(r.doc_id, []).append((r.no, (r.unit_type, r.raw)))
        sides.append(held)
    want = {(d, u[a][0], u[b][0], sides[1][d][c][0], sides[1][d][e][0]) for d, u in sides[0].items() for a, b, c, e in composites.composite_matches([x for _, x in u], [x for _, x in sides[1][d]])}
    assert {tuple(r) for r in QUERIES["composite_runs"](spark, SF).collect()} == want and len(want) > 50
    # lines that begin with the three last words of the line before lose them, where these say enough
    got = {(r.doc_id, r.no): (r.start, r.fault) for r in QUERIES["clipped_units"](spark, SF).collect()}
    assert sum(start > 0 for start, _ in got.values()) > len(got) / 2 and {f for _, f in got.values()} <= {"", "unsafe", "empty"}


def test_baseline_and_shingle_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {}
    for r in versions(docs).collect():
        held.setdefault(r.doc_id, {})[r.source] = (r.text, False)
    want = {(d, s, *v) for d, own in held.items() for s, v in baseline.judge_versions(own, ()).items()}
    assert {tuple(r) for r in QUERIES["baseline_choices"](spark, SF).collect()} == want
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = QUERIES["shingle_spans"](spark, SF).collect()
    assert len(rows) > 1000
    for r in rows[::97]:
        words = re.findall(r"[^\W_]+", texts[r.doc_id][r.byte_start : r.byte_end].decode())
        assert hashlib.sha256(" ".join(unicodedata.normalize("NFKC", w).casefold() for w in words).encode()).hexdigest() == r.digest and len(words) == 12


def test_every_query_without_sql_is_held_by_a_test():
    assert set(QUERIES) - set(ORACLES) == {"aligned_units", "composite_runs", "clipped_units", "baseline_choices", "shingle_spans"}


def test_units_and_alignment(spark):
    docs = spark.createDataFrame([(1, "# A\n\nfirst part of it\n\nsecond part of it"), (2, None), (3, "")], "doc_id long, text string")
    units = {(r.doc_id, r.ord): r for r in alignment.structural_units(docs).collect()}
    assert [units[1, k].unit_type for k in range(3)] == ["heading", "paragraph", "paragraph"] and len(units) == 3
    rows = [(1, k, "paragraph", t) for k, t in enumerate(["alpha beta", "gamma delta", "epsilon zeta"])]
    base = spark.createDataFrame(rows, "doc_id long, no long, unit_type string, raw string")
    other = spark.createDataFrame([(1, 0, "paragraph", "Alpha  beta"), (1, 1, "heading", "gamma delta"), (1, 2, "paragraph", "epsilon zet")], base.schema)
    got = {(r.base_no, r.other_no): r.similarity for r in alignment.aligned_units(base, other).collect()}
    assert set(got) == {(0, 0), (2, 2)} and got[0, 0] == 100.0


def test_repeated_document_is_flagged(spark):
    line = "word " * 30
    docs = spark.createDataFrame([(1, "\n\n".join([line] * 25)), (2, "\n\n".join(f"{line}{i}" for i in range(25)))], "doc_id long, text string")
    from vellum.operators.repetition import repetition_profile

    got = {r.doc_id: (r.excess, r.repeated) for r in repetition_profile(docs).collect()}
    assert got == {1: (24, True), 2: (0, False)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a​b\x07\tc", "x_page_3_Figure_2.jpeg", "ABCDEF+Times-BoldItalic", "| a | b |")], "t string, n string, f string, l string")
    row = df.select(text.unsafe_count(F.col("t")).alias("u"), text.page_of_name(F.col("n")).alias("p"), markup.is_italic_font(F.col("f")).alias("i"), text.line_type(F.col("l")).alias("k")).first()
    assert (row.u, tuple(row.p), row.i, row.k) == (2, ("3", "Figure", "2"), True, "table")
    assert kernels.folded_key(" Straße  Ａ") == "strasse a"


def test_unknown_model_raises(spark):
    rows = spark.createDataFrame([("select", "unknown", 1, 1, 0)], "call_type string, model string, prompt long, completion long, cached long")
    with pytest.raises(Exception, match="no price for model"):
        usage.ledger(rows).collect()


def test_rules_health_and_runs(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id long, v int")
    got = sorted((r.id, r.rule) for r in rules.violations(rows, "id", {"small": F.col("v") < 10, "odd": F.col("v") % 2 == 1}).collect())
    assert got == [(2, "odd"), (2, "small"), (3, "odd"), (3, "small")]
    parts = spark.createDataFrame([("db", "ok", True), ("cache", "down", False)], "component string, state string, required boolean")
    assert rules.health(parts).first().status == "degraded"
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "running", 1.0), (1, 2, "2024-01-01 00:01:00", "failed", None), (1, 3, "2024-01-01 00:02:00", "succeeded", 2.0)], "process_id long, seq long, ts string, status string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert runs.terminal_state(events).first().status == "failed"
    assert runs.latest_values(events).first().latest_value == 2.0


def test_commit_and_verify(spark, tmp_path):
    frame = spark.range(5)
    sources.commit(frame, f"file://{tmp_path}", "t", "v1")
    assert sources.committed(spark, f"file://{tmp_path}", "t", "v1").count() == 5
    spark.range(6).write.mode("overwrite").parquet(f"file://{tmp_path}/t/v1")
    with pytest.raises(ValueError, match="manifest"):
        sources.committed(spark, f"file://{tmp_path}", "t", "v1")


def test_exact_texts(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é\r\n".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.valid) for r in sources.exact_texts(spark, f"file://{tmp_path}/*.md").collect()}
    assert got == {"a.md": ("é\r\n", True), "b.md": (None, False)}


def _drain(frame, mode, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def test_stream_matches_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 40")
    batch.repartition(3).write.parquet(f"file://{tmp_path}/e")
    stream = streaming.event_stream(spark, f"file://{tmp_path}/e", batch.schema, 100)
    want = {(r.process_id, r.status, r.n_events) for r in runs.terminal_state(runs.run_events(batch)).collect()}
    got = {(r.process_id, r.status, r.n_events) for r in _drain(streaming.run_states(stream), "update", "states").collect()}
    assert got == want
    whole = {(r.process_id, str(r.since), r.n) for r in runs.sessions(runs.run_events(batch), 7200).collect()}
    closed = {(r.process_id, str(r.since), r.n) for r in _drain(streaming.sessions(stream), "append", "closed").collect()}
    assert closed and closed <= whole
    assert _drain(streaming.deliveries_once(stream), "append", "once").count() == batch.count()
