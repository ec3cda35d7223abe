import re
from collections import Counter

import numpy as np
import pandas as pd

from vellum.llm import quality as q

ODD = ["", None, " \n ", "a b c d e f g h a b c d e f g h", "x\nx\n\n \n x", "é|é #", "a " * 40, "one\ntwo\none", "b\x00c\x1cd e\x85f"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()["text"].tolist()
    texts = ODD + docs
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:6] for r in q.with_counts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert q.with_counts(df.limit(0)).count() == 0


def test_learns_a_planted_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(q.FEATURES)))
    bad = ((x[:, 1] > 0.8) & (x[:, 3] <= 0.5)) | (x[:, 7] > 0.95)
    rules = q.learn(x, bad, np.arange(3000) % 3 == 0)
    verdict = np.zeros(3000, bool)
    for rule in rules:
        verdict |= q.covered(rule, x)
    assert (verdict == bad).mean() > 0.98 and len(rules) >= 2


def test_held_out_accuracy_and_expression(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = q.fit(docs.where("doc_id % 2 = 0"), labels)
    rows = q.judge(docs.where("doc_id % 2 = 1"), rules).join(labels, "doc_id").toPandas()
    rows = rows[~rows.base_failed]
    assert ((rows.kept == (rows.quality == 1)).mean()) > 0.95
    assert rows.kept[rows.quality == 1].mean() > 0.97
    x = q.feature_matrix(rows)
    first = np.full(len(rows), np.nan)
    for k in reversed(range(len(rules))):
        first[q.covered(rules[k], x)] = k
    assert np.array_equal(first, rows.rule_no.to_numpy(float), equal_nan=True)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = q.judge(docs, q.fit(docs, labels)).collect()
    assert len(rows) == 3 and not any(r.kept for r in rows)
    kept = q.keep_good(docs.selectExpr("doc_id", "text || repeat(' w', 3)  text"), labels, ["doc_id", "text"])
    assert kept.count() == 0 and kept.columns == ["doc_id", "text"]
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_repeated_labelled_ids_and_clashing_names(spark):
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, k, 1) for k in range(50)] + [(2, "x y", 0, 1)], "doc_id long, text string, __n_words int, row int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert q.labelled_sample(docs, labels, 10)["doc_id"].tolist() == [1, 2]
    kept = q.keep_good(docs, labels, docs.columns)
    assert kept.columns == docs.columns and sorted(r["__n_words"] for r in kept.collect()) == list(range(50))


def test_base_rule_and_verdict(spark):
    """base_failed and kept of the contract, from the plain counts and the learned list."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = q.fit(docs, labels)
    rows = q.op1_quality_rules(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    x = q.feature_matrix(rows)
    rejected = np.zeros(len(rows), bool)
    for rule in rules:
        rejected |= q.covered(rule, x)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for (doc, row), bad in zip(rows.iterrows(), rejected, strict=True):
        n, _, _, _, repeated = brute(texts[doc])
        assert row.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert row.kept == (not row.base_failed and not bad)
    assert 0 < rows.base_failed.sum() < len(rows) and 0 < (~rows.kept & ~rows.base_failed).sum()
