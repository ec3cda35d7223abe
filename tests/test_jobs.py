from vellum.operators import corpus, images, queue


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=str)


def test_images(spark):
    t = spark.createDataFrame([(1, "a ![x](p/f_page_1_Figure_2.png) near one ![y](q.png)  ![z](r/q.png) tail")], "doc_id long, text string")
    assert rows(images.image_references(t)) == [(1, "f_page_1_Figure_2.png", "x", " near one "), (1, "q.png", "z", " tail")]
    m = spark.createDataFrame([(1, '{"filename": "a_page_4_Table_1.jpeg", "caption": "c"}'), (1, '"b.png"'), (1, "7")], "doc_id long, entry string")
    assert rows(images.manifest(m)) == [(1, "a_page_4_Table_1.jpeg", 4, "Table", 1, "c"), (1, "b.png", None, None, None, None)]
    d = spark.createDataFrame([(1, "a", 10, 10, 999), (1, "b", 100, 100, 9000)], "doc_id long, name string, width int, height int, bytes int")
    assert rows(images.diagnostics(d)) == [(1, "a", "tiny", False), (1, "b", "", True)]
    i = spark.createDataFrame([(1, "a", "old", "t"), (1, "b", "old", "t")], "doc_id long, name string, label string, text string")
    r = spark.createDataFrame([(1, "a", "new", None, None), (1, "b", "new", "n", "failed")], "doc_id long, name string, label string, text string, error string")
    assert rows(images.with_reviews(i, r)) == [(1, "a", "new", "t", None), (1, "b", "old", "t", "failed")]
    b = spark.createDataFrame([(1, "g", 0, "image", "i"), (1, "g", 2, "caption", "two"), (1, "g", 1, "caption", "one")], "doc_id long, group string, no int, kind string, text string")
    assert rows(images.grouped_captions(b)) == [(1, "g", "i", "one\ntwo")]
    f = spark.createDataFrame([(True, None), (None, True), (None, None)], "extract boolean, review boolean")
    assert rows(images.flags(f)) == [(False, False), (True, True), (True, True)]


def test_leases_and_their_stream(spark, tmp_path):
    ops = [("j", 1, 0, "a", "claim", 10, None), ("j", 2, 5, "b", "claim", 10, None), ("j", 3, 10, "b", "claim", 10, None), ("j", 4, 11, "a", "release", 0, 1), ("j", 5, 12, "b", "ack", 0, 2), ("k", 6, 0, "a", "ack", 0, None)]
    df = spark.createDataFrame(ops, "job_id string, seq long, at long, owner string, op string, ttl long, etag long")
    want = rows(queue.leases(df), "seq", "granted", "holder")
    assert want == [(1, True, "a"), (2, False, "a"), (3, True, "b"), (4, False, "b"), (5, True, None), (6, False, None)]
    df.coalesce(1).write.parquet(f"file://{tmp_path}/o")
    stream = queue.lease_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/o"))
    stream.writeStream.format("memory").queryName("leases").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("leases"), "seq", "granted", "holder") == want


def test_phases_and_guards(spark):
    rec = spark.createDataFrame([("a", "cancelled", 1, 1), ("a", "accepted", 2, 2), ("b", "accepted", 1, 3)], "job_id string, phase string, at int, seq int")
    q, c = (spark.createDataFrame([(x,) for x in v], "job_id string") for v in ("bcd", "c"))
    assert rows(queue.phases(rec, q, c)) == [("a", "cancelled"), ("b", "accepted"), ("c", "claimed"), ("d", "queued")]
    jobs = spark.createDataFrame([("x", 3), ("y", 1), ("z", 1)], "job_id string, queued_at int")
    assert rows(queue.oldest_first(jobs, 2)) == [("x", 3, False), ("y", 1, True), ("z", 2, True)]
    g = spark.createDataFrame([("h", True), ("h", None), ("i", True)], "host string, idle boolean")
    assert rows(queue.may_stop(g)) == [("h", False), ("i", True)]
    s = spark.createDataFrame([("p", "submitting", 0, 100, 1), ("q", "submitting", 0, 130, 1), ("r", "queued", None, 5, 1), ("t", "submitting", None, 5, 1)], "process_id string, status string, started_at int, now int, seq int")
    assert rows(queue.submissions(s), "process_id", "may_claim") == [("p", False), ("q", True), ("r", False), ("t", True)]
    e = spark.createDataFrame([("h", 1, 0, "wake"), ("h", 2, 1, "healthy"), ("h", 3, 2, "work"), ("h", 4, 3, "idle"), ("h", 5, 99, "work"), ("h", 6, 100, "wake")], "host string, seq long, at long, event string")
    assert [r[2:] for r in rows(queue.lifecycle(e, 50))] == [("starting", 1), ("ready", 1), ("busy", 1), ("ready", 1), ("stopped", 1), ("starting", 2)]
    d = spark.createDataFrame([("p", 1, 1, False), ("p", 2, 2, False), ("q", 1, 3, True)], "process_id string, at int, seq int, terminal boolean")
    assert rows(queue.deliveries_once(d)) == [("p", 2, 1), ("q", 1, 0)]


def test_corpus(spark):
    files = [("a", '{"status": "complete", "usage": {"calls": 2, "total_tokens": 30, "cost_usd": 0.5}, "metrics": {"regions": 3, "agreed": 2, "selected": 1, "fallback": 0}}'), ("b", '{"status": 5}'), ("c", None), ("d", "not json")]
    facts = corpus.cases(spark.createDataFrame(files, "case_id string, status_json string"))
    assert rows(facts, "case_id", "status", "regions", "calls") == [("a", "complete", 3, 2), ("b", "5", 0, 0), ("c", "missing", 0, 0), ("d", "missing", 0, 0)]
    assert rows(corpus.decision_events(facts.where("case_id = 'a'")), "sequence", "stage", "n") == [(1, "extract", 1), (2, "vote", 2), (3, "select", 1)]
    ledger = spark.createDataFrame([("a", 2, 30, 0.4999999)], "case_id string, calls long, tokens long, cost_usd double")
    assert rows(corpus.reconciliation(facts, ledger).where("case_id = 'a'")) == [("a", True, True, True, True)]
    assert corpus.status_counts(facts).first().counts == "5=1, complete=1, missing=2"
    lines = [r.line for r in corpus.report(corpus.summary(facts)).orderBy("line_no").collect()]
    assert lines[:3] == ["| figure | value |", "|---|---|", "| cases | 4 |"]
    names = spark.createDataFrame([(1, "A b"), (2, "a-b"), (3, "##")], "id int, name string")
    assert rows(corpus.safe_names(names)) == [(1, "a-b"), (2, "a-b-2"), (3, "case")]
    ev = spark.createDataFrame([("p", 2, "t2", "s", "ok", None), ("p", 1, "t1", "s", None, "d")], "process_id string, seq int, ts string, stage string, status string, detail string")
    assert corpus.timeline(ev).first().ndjson == '{"ts":"t1","stage":"s","detail":"d"}\n{"ts":"t2","stage":"s","status":"ok"}'
