import hashlib
import random

import numpy as np

from vellum.llm import suffix as m


def brute(rows):
    where = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            s = data[i : i + 50]
            d_ = m.LAST if d is None else d
            where[s] = min(where.get(s, d_), d_)
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49):
            if where[data[i : i + 50]] < (m.LAST if d is None else d):
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate(([0], gone[: len(data)].astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((d, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, tie int, blob string")
    got = sorted((tuple(r) for r in m.remove_spans(df, **more).collect()), key=str)
    assert got == brute(rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(8)
    letters = "abcde é\n"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 49, 50, 51, 70, 200]))) for _ in range(12)]
    rows = []
    for i in range(80):
        t = "".join(rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 7)))
        rows.append((i * 2, t[rng.randrange(0, 9) :]))
    rows += [(500, None), (501, ""), (502, "a" * 300), (503, "a" * 49), (504, "a" * 50), (505, "ab" * 200), (506, "\x00" * 120), (507, "\x00" * 60 + "q"), (508, "a" * 120), (None, rows[7][1] + "z" * 60), (509, "z" * 60), (510, rows[9][1])]
    rng.shuffle(rows)
    got = check(spark, rows, shards=16)
    assert sum(r[2] for r in got) > 1000


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_repeated_ids_and_empty(spark):
    text = "".join(chr(97 + i % 23) for i in range(150))
    check(spark, [(1, text), (1, text), (1, text + "x"), (2, "pre " + text), (3, "short")])
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert m.remove_spans(df.limit(0)).count() == 0


def test_family_of_levels():
    """In whatever order strings come, all occurrences but those of the least document are covered, once each."""
    rng = np.random.default_rng(2)
    family, every, covered, total = m.SuffixFamily(), {}, [], 0
    seen = []
    for _ in range(40):
        strings = rng.integers(0, 300, rng.integers(0, 60)).astype("S50")
        docs = rng.integers(0, 40, len(strings))
        covered += family.insert(strings, docs, np.arange(total, total + len(strings))).tolist()
        total += len(strings)
        seen += zip(strings.tolist(), docs.tolist(), strict=True)
    for s, d in seen:
        every[s] = min(d, every.get(s, d))
    assert len(family.levels) <= 10
    assert sorted(covered) == [k for k, (s, d) in enumerate(seen) if d > every[s]]
    assert sorted(family.rows().tolist()) == [k for k, (s, d) in enumerate(seen) if d == every[s]]


def test_partitions_of_short_texts(spark):
    """A task may see no text of 50 bytes at all."""
    long = "".join(chr(97 + i % 19) for i in range(90))
    for rows in ([(1, "short"), (2, "tiny")], [(1, None)], [(1, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
        assert sorted(r.n_removed for r in m.remove_spans(df).collect()) == [0] * len(rows)
    df = spark.createDataFrame([(k, f"{long}{k}") for k in range(60)], "doc_id long, text string").union(spark.createDataFrame([(99, "short")], "doc_id long, text string").coalesce(1))
    got = sorted(tuple(r) for r in m.remove_spans(df).collect())
    assert sorted(got, key=str) == brute([*((k, f"{long}{k}") for k in range(60)), (99, "short")])


def test_largest_id(spark):
    text = "".join(chr(97 + i % 23) for i in range(150))
    df = spark.createDataFrame([(2**63 - 1, text), (5, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in m.remove_spans(df).collect()) == [(5, 0), (2**63 - 1, 150)]


def test_blobs_do_not_multiply():
    """What a task finds in many small parts goes out as one blob for each shard, not as one for each part and shard."""
    rng = np.random.default_rng(4)
    found = [(rng.integers(0, 5000, 200), np.zeros(200, np.int64), at := rng.integers(0, 4000, 200), at + 50) for _ in range(300)]
    batches = list(m._gathered(iter(found), 16))
    assert sum(b.num_rows for b in batches) == 16
    parts = [(rng.integers(0, 64, 100).astype(np.int32), rng.integers(0, 99, 100), np.zeros(100, np.int64), np.arange(100), np.ones(100, np.uint8), np.full(100, 60), np.zeros(6000, np.uint8)) for _ in range(50)]
    assert m._segment_blobs(parts).num_rows == 64


def test_shards_of_a_wide_one(spark):
    """A task that takes several shards one after the other loses none."""
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([49, 50, 60, 300]))) for _ in range(30)]
    rows = [(k, "".join(rng.choice(pieces) if rng.random() < 0.6 else str(rng.random()) for _ in range(6))) for k in range(60)]
    for shards in (1, 4, 128):
        assert sum(r[2] for r in check(spark, rows, shards=shards)) > 1000


def test_shards_are_even():
    """Anchors are least hashes; the shards that they go to take equal shares of them none the less."""
    raw = np.random.default_rng(6).integers(0, 256, 200_000).astype(np.uint8)
    grams, places = m.anchors(raw, np.array([0, len(raw)]))
    n = np.bincount((m.keys_of(grams, places) >> np.uint64(63 - 5)).astype(np.int64), minlength=32)
    assert len(places) > 10_000 and n.max() < 1.5 * n.mean()
