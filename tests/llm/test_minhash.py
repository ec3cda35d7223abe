import random
import re
from collections import defaultdict

from vellum.llm.common import shared_folder
from vellum.llm.graph import components
from vellum.llm.minhash import keep_first, near_duplicates


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute(rows, width, percent=80):
    """component of each row by comparing all pairs that share a shingle."""
    own = [sets(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(own):
        for x in s:
            by[x].append(i)
    pairs = {(i, j) for v in by.values() for i in v for j in v if i < j}
    for i, j in pairs:
        if None not in (rows[i][0], rows[j][0]) and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(own[i]), None if d is None else least[root(i)], d is None or d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, width):
    df = spark.createDataFrame([(d, t, "node", 3) for d, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    return sorted((tuple(r) for r in near_duplicates(df, width).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(9, ""), (8, None), (None, "a b c d e f"), (6, "a b c d e f"), (7, "A b  c d e F"), (6, "a b c d e f"), (5, "x"), (4, "X"), (3, " \n")]
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 8])):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(new)))
            if rng.random() < 0.6:
                base = new  # chains: first and last may be far apart
    rng.shuffle(rows)
    assert run(spark, rows, 4) == brute(rows, 4)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_empty_and_kept_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", "en"), (1, "a b c d e", "en"), (2, "a b c d e", None), (None, "q", "x"), (3, None, "y")], "doc_id long, text string, lang string")
    assert near_duplicates(df.limit(0)).count() == 0
    got = sorted((tuple(r) for r in keep_first(df, ["doc_id", "text", "lang"]).collect()), key=str)
    assert got == [(1, "a b c d e", "en"), (3, None, "y"), (None, "q", "x")]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges, shared_folder(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_long_unlike_words_and_texts_of_one_id(spark):
    """Thue-Morse words of 1,024 letters collide under a polynomial modulo 2 ** 64; they are not alike."""
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    assert {r[0]: r[2] for r in run(spark, [(1, x), (2, y)], 4)} == {1: 1, 2: 2}
    rows = [(1, "a b c d e f"), (1, "q w e r t y"), (1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (3, None), (3, ""), (None, "z")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, tie int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in keep_first(df, df.columns).collect())
    assert got == [(False, 1, "a b c d e f"), (False, 1, "q w e r t y"), (False, 3, ""), (False, 3, ""), (True, 0, "z")]


def test_few_edges_are_joined_at_once_and_many_by_stars(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(1000 - i, 999 - i) for i in range(200)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    for at_once in (len(pairs), 0):
        assert {r.node: r.component for r in components(edges, shared_folder(spark), at_once=at_once).collect()} == least
    assert components(edges.limit(0), shared_folder(spark)).count() == 0


def test_a_family_in_many_components(spark):
    """Near copies about the threshold: links between the first components come from classes outside of the largest."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        new = list(base)
        for _ in range(rng.randrange(0, 8)):
            new[rng.randrange(len(new))] = f"v{rng.randrange(50)}"
        rows.append((i * 7 % 160, " ".join(new)))
    assert run(spark, rows, 4) == brute(rows, 4)


def test_stages_for_a_small_table(spark):
    """What a query costs beside its rows: stages of a table of any size (119 before, when few edges went through stars)."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    context = spark.sparkContext
    context.setJobGroup("op10-stages", "op10")
    try:
        near_duplicates(df, 4).count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("op10-stages") for s in tracker.getJobInfo(job).stageIds}
    assert sum(i.numCompletedTasks > 0 for i in map(tracker.getStageInfo, stages) if i) < 90
