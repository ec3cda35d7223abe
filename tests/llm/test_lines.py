import random
import re

from vellum.llm import lines as m


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute(rows, percent=80):
    """removed line numbers of each row, by comparing every line with every earlier one."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = {}, {}
    for i in order:
        gone = []
        for k, line in enumerate((rows[i][1] or "").split("\n")):
            w = words(line)
            if w:
                if any(100 * len(w & s) >= percent * len(w | s) for s in seen):
                    gone.append(k)
                seen[w] = 1
        out[i] = gone
    return out


def sample():
    rng = random.Random(11)
    vocabulary = [f"w{'x' * (k % 9)}{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 20, 45]))] for _ in range(60)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                line.append(rng.choice(vocabulary))
            own.append("  ".join(line) + rng.choice(["", " ", "\r"]))
        rows.append((i * 3, "\n".join(own)))
    return [*rows, (1000, None), (1001, ""), (1002, "\n \n"), (None, rows[5][1] + "\nfresh words here now")]


def test_against_brute_force(spark):
    rows = sample()
    want = brute(rows)
    shuffled = list(enumerate(rows))
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame([(d, t, "x", 1) for _, (d, t) in shuffled], "doc_id long, text string, tok string, n int")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines) for r in m.judge(df).collect()}
    assert got == {rows[i][0]: (sum(bool(words(x)) for x in (rows[i][1] or "").split("\n")), len(v), v) for i, v in want.items()}
    kept = {r.doc_id: (r.text, r.n) for r in m.drop_lines(df, ["doc_id", "text", "n"], counted="n").collect()}
    for i, (d, t) in enumerate(rows):
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in want[i]]
        if not want[i]:
            assert kept[d] == (t, 1)
        elif any(words(x) for x in left):
            assert kept[d] == ("\n".join(left), len("\n".join(left)))
        else:
            assert d not in kept


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: r.removed_lines for r in m.judge(df).collect()} == {rows[i][0]: v for i, v in brute(rows).items()}


def test_repeated_ids_and_empty(spark):
    rows = [(1, "a b c d e\nf"), (1, "a b c d e\nf"), (1, "other words\nf"), (2, "f\nnew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in m.judge(df).collect())
    assert got[-1] == (2, 2, 1) and sum(g[2] for g in got) in (2, 3) and len(got) == 4
    assert m.judge(df.limit(0)).count() == 0


def test_all_links_of_near_copies(spark):
    """A group of near but different lines: every link counts, not only the first earlier match."""
    base = [f"word{k}" for k in range(20)]
    rows = [(i, " ".join([*base[: i % 20], f"own{i}", *base[i % 20 + 1 :]]) + f"\nalone{i} x{i} y{i} z{i}") for i in range(60)]
    rows += [(100, rows[3][1]), *sample()[:80]]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows.append(rows[5])  # an identical row is one document
    flat = [(i, k, words(x)) for i, t in dict(rows).items() for k, x in enumerate((t or "").split("\n")) if words(x)]
    want = {(i, k): sum(100 * len(w & v) >= 80 * len(w | v) for _, _, v in flat) - 1 for i, k, w in flat}
    got = m.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    lines = {(r.doc_id, x.line): x for r in got for x in r.lines}
    assert {k: x.links for k, x in lines.items()} == want and max(want.values()) > 40
    assert all(r.n_links == sum(x.links for x in r.lines) for r in got)
    classes = {}
    for i, k, w in flat:
        classes.setdefault(w, set()).add(lines[i, k]["class"])
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


def near_copies(n, seed=5):
    """n different lines, each one base line with a few words dropped, changed or added."""
    rng = random.Random(seed)
    vocabulary = [f"{'q' * (k % 7)}v{k}" for k in range(400)]
    base = [f"base{k}" for k in range(50)]
    out = []
    for i in range(n):
        line = list(base)
        for _ in range(min(12, int(rng.expovariate(0.35)) + 1)):
            at = rng.randrange(len(line))
            act = rng.randrange(3)
            line[at : at + (act != 1)] = [] if act == 2 else [rng.choice(vocabulary) if rng.random() < 0.7 else f"own{i}x{at}"]
        out.append(" ".join(line))
    return out


def test_group_of_near_copies_is_counted_without_its_pairs(spark, tmp_path):
    copies = near_copies(900)
    rows = [(i, t) for i, t in enumerate([*copies, *(t for _, t in sample()), copies[7], copies[7] + "\n" + copies[20] + " tail"])]
    flat = [(i, k, words(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if words(x)]
    want = {(i, k): [(j, m) for j, m, v in flat if 100 * len(w & v) >= 80 * len(w | v) and (j, m) != (i, k)] for i, k, w in flat}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/lines"
    got = {(r.doc, r.line): (r.links, r.gone) for r in m.linked_lines(df, 80, folder).collect()}
    assert got == {k: (len(v), any(x < k for x in v)) for k, v in want.items()}
    pairs = sum(len(v) for v in want.values()) // 2
    members = spark.read.parquet(f"{folder}/members")
    assert members.count() > 700 and pairs > 100_000
    profiles = spark.read.parquet(f"{folder}/profiles").count()
    assert profiles < 300
    # what is joined as pairs: the rest of the cluster, and classes outside of it
    left = m.links_within(members, 80, folder)[1].agg({"links": "sum"}).first()[0] // 2
    assert left < pairs / 8


def test_clashing_names_and_largest_id(spark):
    rows = [(2**63 - 1, "a b c d e f", "x", 1, 2), (3, "a b c d e f\nown words", "y", 3, 4), (None, "z z y", "q", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc string, tie int, row int")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in m.judge(df).collect()) == [(False, 3, 0), (False, 2**63 - 1, 1), (True, 0, 0)]
    kept = m.drop_lines(df, df.columns).collect()
    assert sorted((r["__doc"], r.tie, r.row, r.text) for r in kept) == [("q", 5, 6, "z z y"), ("y", 3, 4, "a b c d e f\nown words")]


def test_texts_that_are_not_wanted_are_not_moved(spark):
    """A filter of bounded size stands before the join that fetches lines; it loses no wanted text."""
    texts = spark.range(3000).selectExpr("id AS doc", "id % 3 AS tie", "concat('line ', id) AS text")
    wanted = texts.where("doc % 10 = 0").select("doc", "tie")
    passed = {r.doc for r in m.maybe_wanted(texts, wanted).collect()}
    assert passed >= set(range(0, 3000, 10)) and len(passed) < 310
    assert m.maybe_wanted(texts, wanted.limit(0)).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "FILTER_BITS", 6)
    texts = spark.range(3000).selectExpr("id AS doc", "0L AS tie", "'x' AS text")
    assert m.maybe_wanted(texts, texts.select("doc", "tie")).count() == 3000


def test_triples_without_lambda(spark):
    """The triples that vote for crowds are columns: a lambda would be interpreted for every token."""
    df = spark.createDataFrame([(i, [7 * i + k for k in range(i)]) for i in range(16)], "cid long, prefix array<long>")
    found = m.last_triples(df)
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    want = {r.cid: set(r.ts or []) for r in df.selectExpr("cid", m._triples("prefix", f"greatest(1, size(prefix) - {m.TRIPLES + 1})", "size(prefix) - 2")).collect()}
    assert {r.cid: {t for t in r[1:] if t is not None} for r in found.collect()} == want
    assert [len(want[i]) for i in (0, 2, 3, 9, 10, 15)] == [0, 0, 1, 7, 8, 8]


def test_members_are_taken_out_while_reading_or_before(spark, monkeypatch, tmp_path):
    classes, members = spark.range(50).selectExpr("id AS cid"), spark.range(0, 50, 7).selectExpr("id AS cid")
    want = [(k,) for k in range(50) if k % 7]
    assert sorted(map(tuple, m.outside(classes, members, f"file://{tmp_path}/few").collect())) == want
    assert not (tmp_path / "few/loose").exists()
    monkeypatch.setattr(m, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, m.outside(classes, members, f"file://{tmp_path}/many").collect())) == want
    assert (tmp_path / "many/loose").exists()


def test_each_white_space_character_separates(spark):
    """Texts are rewritten only where they have such a character, and then all of them."""
    texts = ["a b", "a\tb", "a\x0bb", "a\fb", "a\rb", "a\t\x0b\f\r b", "a\xa0b", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(f"{m.BLANKS.format('text')} AS t").collect()
    assert [r.t and words(r.t) for r in got] == [t and words(t) for t in texts] and all(not set("\t\x0b\f\r") & set(r.t or "") for r in got)


def test_words_are_counted_only_where_prefixes_meet_too_often(spark, monkeypatch, tmp_path):
    """Lines are ordered by the length of their words without a pass that counts them; a long word of many lines brings the counts."""
    counted = []
    levels = m.rarity_levels
    monkeypatch.setattr(m, "rarity_levels", lambda texts: counted.append(1) or levels(texts))
    rng = random.Random(3)
    long_ = "boilerplate" * 3
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(12))) for i in range(400)]
    rows += [(i + 400, " ".join([*(w := t.split(" "))[:11], "x"])) for i, t in rows[:50]]
    hot = [(i, f"{long_} {t}") for i, t in rows]
    want = {k: {(i, 0): [(j, 0) for j, v in f if j != i and 100 * len(w & v) >= 80 * len(w | v)] for i, w in f} for k, f in enumerate([(i, words(t)) for i, t in r] for r in (rows, hot))}

    def links(k, r, bound):
        monkeypatch.setattr(m, "MOST_MEETINGS", bound)
        folder = f"file://{tmp_path}/{k}-{bound}"
        got = {(x.doc, x.line): (x.links, x.gone) for x in m.linked_lines(spark.createDataFrame(r, "doc_id long, text string"), 80, folder).collect()}
        assert got == {x: (len(v), any(y < x for y in v)) for x, v in want[k].items()}
        return folder

    links(0, rows, 100)
    assert not counted
    folder = links(1, hot, 100)
    token = spark.createDataFrame([(long_,)], "w string").selectExpr("shiftrightunsigned(xxhash64(w), 8) AS t").first().t
    low = f"tok & {(1 << 56) - 1}L"
    sets = spark.read.parquet(f"{folder}/sets-counted").selectExpr("explode(prefix) AS tok").selectExpr(f"{low} AS t")
    assert counted == [1] and sets.count() > 0 and not sets.where(f"t = {token}").count()


def test_octaves_meet(spark):
    """The octave of every size that a larger similar set may have is among those of the smaller one."""
    for percent in (30, 80, 100):
        sizes = spark.range(1, 700).selectExpr("cast(id AS int) AS n").selectExpr("n", f"{m.octave('n')} AS o", f"{m.octaves_above('n', percent)} AS os").collect()
        own = {r.n: r.o for r in sizes}
        assert all(own[k] in r.os for r in sizes for k in range(r.n, min(699, r.n * 100 // percent) + 1))
        assert percent < 80 or max(len(r.os) for r in sizes) <= 2
