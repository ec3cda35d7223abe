from collections import defaultdict

import regex

from vellum.llm import decontaminate as d


def template(text):
    """(kind or word, value) of every token, in plain Python."""
    text = (text or "").replace("\x02", " ").replace("\x03", " ")
    pattern = regex.compile(
        rf"(?P<n>{d.NUMBER})|(?<=[0-9]\x20?)(?P<u>(?:{'|'.join(d.UNITS)})(?![\p{{L}}\p{{M}}\p{{N}}])|[%°])|(?P<w>[\p{{L}}\p{{M}}]+)", regex.V1
    )
    out = []
    for m in pattern.finditer(text):
        before = text[max(0, m.start() - 2) : m.start()]
        after_slot = out and out[-1][0] in "nu" and out[-1][2] == m.start() - 1
        if m["n"] or m["u"]:
            out.append(("n" if m["n"] else "u", m[0].lower(), m.end()))
        elif regex.match(r"\p{Lu}\p{Ll}", m[0]) and (after_slot and before[-1:] == " " or regex.fullmatch(r"[\p{L}\p{N},;:]\x20", before)):
            out.append(("p", m[0].lower(), m.end()))
        else:
            out.append(("", m[0].lower(), m.end()))
    return [(k, v) for k, v, _ in out]


def brute(rows, items):
    found = defaultdict(set)
    key = lambda part: tuple(k or v for k, v in part)
    own_tokens, places = [template(own) for _, own in rows], {}

    def at(n, k):
        """window -> its places in document n"""
        if (n, k) not in places:
            held = places[n, k] = defaultdict(list)
            for j in range(len(own_tokens[n]) - k + 1):
                held[key(own_tokens[n][j : j + k])].append(j)
        return places[n, k]

    for item, text in items:
        b = template(text)
        k = min(len(b), d.WINDOW)
        if not k:
            continue
        for n, (doc, _) in enumerate(rows):
            t = own_tokens[n]
            lines = defaultdict(list)
            for i in range(len(b) - k + 1):
                part = b[i : i + k]
                if sum(bool(x) for x, _ in part) * 2 > k:
                    continue
                for j in at(n, k).get(key(part), ()):
                    lines[j - i].append(i)
            for shift, met in lines.items():
                if len(met) < min(d.LEAST, len(b) - k + 1):
                    continue
                seen = defaultdict(set)
                for p in range(min(met), max(met) + k):
                    if b[p][0] and t[p + shift][0] == b[p][0]:
                        seen[b[p]].add(t[p + shift][1])
                if all(len(v) == 1 for v in seen.values()):
                    found[doc].add(item)
    return {k: sorted(v) for k, v in found.items()}


ITEMS = [
    (1, "If Anna has 12 apples and gives Peter 5 apples, how many of the 12 apples does Anna keep for the day?"),
    (2, "the quick brown fox jumps over"),
    (3, "A train drives 40 km in 2 hours, then 60 km in 3 hours; what is the mean speed of the train?"),
    (4, ""), (5, None), (6, "1 2 3 4 5 6 7 8 9"),
]
DOCS = [
    (0, None), (1, ""), (2, "nothing here"),
    (3, "We ask: If Anna has 12 apples and gives Peter 5 apples, how many of the 12 apples does Anna keep for the day? Yes."),
    (4, "Well if Tom has 30 apples and gives Mary 7 apples, how many of the 30 apples does Tom keep for the day"),
    (5, "Well if Tom has 30 apples and gives Mary 7 apples, how many of the 31 apples does Tom keep for the day"),
    (6, "see the quick brown fox jumps over it"), (7, "the quick brown fox jumps"),
    (8, "A train drives 90 km in 4 hours, then 10 km in 5 hours; what is the mean speed of the train?\n" * 3),
    (9, "1 2 3 4 5 6 7 8 9 10 11"), (None, "see the quick brown fox jumps over it"), (3, "an other text"), (11, "HE SAID THE QUICK BROWN FOX JUMPS OVER IT"), (10, "x \x02n\x03 12% and 5°"),
]


def test_templates_and_slots(spark):
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in DOCS], "doc_id long, text string, item_id int, hash string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = d.judge(docs, items).collect()
    assert len(rows) == len(DOCS)
    hits = {r.doc_id: r.item_id for r in rows if r.contaminated}
    assert hits == {3: 1, 4: 1, 6: 2, 8: 3, 11: 2, None: 2}
    assert {k: v[0] for k, v in brute(DOCS, ITEMS).items()} == hits
    kept = d.drop_leaks(docs, items, ["doc_id", "text"]).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 5, 7, 9, 10]
    assert d.judge(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in d.judge(docs, items.limit(0)).collect())


def test_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: r.item_id for r in d.judge(docs, items).collect() if r.contaminated}
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 3000 or r.doc_id in got]
    assert got == {k: v[0] for k, v in brute(rows, [(r.item_id, r.text) for r in items.collect()]).items()}


def test_without_broadcast(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    one, two = (sorted(map(tuple, d.find_leaks(docs, items, broadcast_rows=n).collect()), key=str) for n in (0, 10**6))
    assert one == two and one


def test_number_heavy_items(spark):
    """Items whose windows are mostly slots: verbatim copies are found, whatever stands around them."""
    long_ = "Sum up " + " ".join(str(k) for k in range(3, 40)) + " and give the total"
    items = [(1, "Compute 12 + 7 * 3 - 45 / 9 + 8"), (2, "Evaluate 3 + 5 * 2 - 8 / 4 then state the result clearly"), (3, long_)]
    docs = [
        (1, "We ask: Compute 12 + 7 * 3 - 45 / 9 + 8. Then on."), (2, "Compute 12 + 7 * 3 - 45 / 9 + 9"), (3, "Evaluate 3 + 5 * 2 - 8 / 4 then state the result clearly"),
        (4, "And so: evaluate 6 + 5 * 1 - 9 / 7 then state the result clearly"), (5, f"First {long_} please"), (6, " ".join(str(k) for k in range(60))), (7, "Evaluate 3 + 5 * 2 - 8 / 4 then go"),
    ]
    rows = d.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in rows if r.contaminated} == {1: 1, 3: 2, 4: 2, 5: 3}


def test_short_items(spark):
    """An item of a word or two is no leak in running text, but it is where it is all of a document."""
    items = spark.createDataFrame([(1, "hello"), (2, "Thank you 5"), (3, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "well hello there, hello"), (2, "Hello!"), (3, "thank you 5"), (4, "thank you 6"), (5, "and one two three four come"), (6, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()}
    assert got == {(2, 1), (3, 2), (5, 3)}
    named = docs.selectExpr("doc_id", "text", "1 AS leaked", "2 AS __id")
    assert sorted(r.doc_id for r in d.drop_leaks(named, items, named.columns).collect()) == [1, 4, 6]
