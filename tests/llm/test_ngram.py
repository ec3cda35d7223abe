import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from vellum.llm import ngram as m
from vellum.llm.common import shared_folder
from vellum.llm.eliasfano import EliasFano, build


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), None]


def brute(rows):
    """Base and full score of each row by plain counting, with the model's quantised values."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            own = tokens(t)
            one.update(own)
            two.update(zip([None, *own], own, strict=False))
            line = [None, *own]
            three.update(zip(line, line[1:], line[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def q(p):
        return 10 ** (-math.ceil(-math.log10(p) * m.STEPS - 1e-9) / m.STEPS)

    def level(counts, cut):
        whole = Counter()
        for k, c in counts.items():
            whole[cut(k)] += c
        found = {k: q((c - m.DISCOUNT) / whole[cut(k)]) for k, c in counts.items()}
        used = Counter()
        for k, x in found.items():
            used[cut(k)] += x
        return found, {k: q(1 - x) for k, x in used.items()}

    (q2, left2), (q3, left3) = level(two, lambda k: k[0]), level(three, lambda k: k[:2])
    out = []
    for (d, t), h in zip(rows, held, strict=True):
        own = [None, *tokens(t)]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own[1:])
        full = 0
        for i in range(1, len(own)):
            p = q2.get((own[i - 1], own[i]), 0) + left2.get(own[i - 1], 1) * q((one[own[i]] + 1) / (n + v + 1))
            if i > 1:
                p = q3.get(tuple(own[i - 2 : i + 1]), 0) + left3.get((own[i - 2], own[i - 1]), 1) * p
            full += math.log10(p)
        out.append((d, h, len(own) - 1, sum(one[w] > 0 for w in own[1:]), n, base, full))
    return out


def check(spark, rows, got):
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[5]))
    got = sorted(map(tuple, got), key=lambda r: (str(r[0]), r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6, abs_tol=1e-6)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 55]) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(200, None), (201, " \n"), (None, "W1 w2 É é"), (5, "w1 w1 w1"), (5, "w1 w1 w1")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, score int, shard string")
    check(spark, rows, m.score(df, df.where(f"NOT {m.HELD}"), shared_folder(spark)).collect())


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = m.op6_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    check(spark, rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(3, "a b")], "doc_id long, text string")
    row = m.score(df, df.limit(0), shared_folder(spark)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert m.score(df.limit(0), df.limit(0), shared_folder(spark)).count() == m.score(df.limit(0), df, shared_folder(spark)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((1, 10), (1000, 1 << 40), (5000, 6000), (3000, 1 << 63), (7, 7), (0, 10)):
        v = np.unique(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano(build(v, u))
        assert not len(v) or (e.get(np.arange(len(v))) == v).all()
        q = np.concatenate((v, rng.integers(0, u, 2000, dtype=np.uint64)))
        at = np.searchsorted(v, q)
        hit = at < len(v)
        hit[hit] = v[at[hit]] == q[hit]
        assert (e.find(q) == np.where(hit, at, -1)).all()
    v = np.sort(rng.integers(0, 50, 400, dtype=np.uint64))
    assert (EliasFano(build(v, 50)).get(np.arange(400)) == v).all()


def score_of(spark, train, text):
    df = spark.createDataFrame([(t,) for t in train], "text string")
    return m.score(spark.createDataFrame([(3, text)], "doc_id long, text string"), df, shared_folder(spark)).first()


def test_what_was_seen_once_counts(spark):
    """One occurrence is evidence: pairs and triples seen once lift a text above its back-off score."""
    train = ["a b c d e f g h", "b a d c f e h g", "c b x", "z b d"]
    assert score_of(spark, train, "a b c d").score > score_of(spark, train, "a c e g").score + 0.5
    # the same pairs, but only one of the two has its triples in the training texts
    assert score_of(spark, train, "a b c d").score > score_of(spark, train, "c b c d").score


def test_long_unlike_words(spark):
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    assert score_of(spark, [x], x.translate(str.maketrans("ab", "ba"))).n_known == 1  # the end alone


def test_probabilities_sum_to_at_most_one(spark):
    train = ["a b a c", "a b b", "c a b"]
    folder = shared_folder(spark)
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(train)], "doc_id long, text string")
    model = m.train(texts, folder)
    m.grow(m.word_ids(texts, model, folder), model, folder)
    words = np.arange(model.types)
    for g in range(model.types):
        for h in range(model.types):
            place, _, _, _ = model.pairs(np.array([g]), np.array([h]))
            _, rank, share, left = model.pairs(np.full(len(words), h), words)
            p = share + left * model.plain(words)
            assert 0.8 < p.sum() <= 1
            share, left = model.triples(np.full(len(words), g), np.full(len(words), place[0]), rank)
            assert 0.8 < (share + left * p).sum() <= 1


def test_search_within_ranges():
    rng = np.random.default_rng(5)
    v = np.unique(rng.integers(0, 4000, 900, dtype=np.uint64))
    e = EliasFano(build(v, 4000))
    q = rng.integers(0, 4000, 3000, dtype=np.uint64)
    low, high = rng.integers(0, len(v), 3000), rng.integers(0, len(v) + 1, 3000)
    at = e.find(q)
    assert (e.find_within(q, low, high) == np.where((at >= low) & (at < high), at, -1)).all()
