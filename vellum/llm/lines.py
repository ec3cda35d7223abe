"""Line dedup: an exact set-similarity join over the lines of all texts, in DataFrame functions only.

A line is the set of its words. A line goes if an earlier line (by doc_id, then line number) has a Jaccard
similarity of at least `percent` with it; this is judged on the input, so an earlier line counts whether it
goes itself or not. Every link between two lines counts, also those between later lines.

1. A line's tokens are ordered by the length of their words, longest first, then by hash. The order is global,
   which is all that exactness needs; long words are rare ones in most texts, and finding that takes no pass over
   them. Where it does not hold, that is where the prefixes of all classes would meet too often, words are counted
   over all texts in a sketch of 2 ** 16 counters (a word's count is at most its counter), and the lines are ordered
   anew, by three times the counter's logarithm less the word's length.
2. Lines with equal sets become one class, led by its earliest line, whatever their number.
3. Two sets that are similar enough share a token of their prefixes (n - ceil(percent * n) + 1 tokens).
   Classes meet in the prefix index under a length, a positional and a parity-bitmap filter (none loses a
   pair), and distinct candidates are verified on their whole sets of words.
4. Groups of many near copies are kept out of that join. Classes that share three neighbouring prefix tokens
   with many others vote for a centre, the words that most of them have. A member is the centre less `d` words
   and more `a` words, so |x and y| = |K| - d - d' + (words missing from both + words added to both). The
   numbers (d, a) alone settle most pairs of members: those that are similar even if the sum in brackets is 0
   are counted by number, without making a pair, and those that are not at its largest are left. The rest meet
   on a word that both miss or both add. Members of one cluster never meet in the prefix index; which classes
   are in a cluster decides the cost only.

Blank lines stay. Nulls and empty texts have no lines. Null ids come last in the order. Identical rows are
one document; rows that share an id but not the text are told apart by a hash of the text. Ties do not arise:
lines are ordered by id, hash of the text and number. Very long texts and lines are whole. Extra columns of
any name are carried by `drop_lines` and not read otherwise.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import release, settle, shared_folder, table

COUNTER_BITS = 16
COUNTERS = (1 << COUNTER_BITS) - 1
#: Longer words are ordered like ones of this many bytes, so that length never outweighs the count of a frequent one.
LONGEST = 16
LAST = 9223372036854775807
#: The prefix index and the verification are joined in so many turns, each of which lets go of its shuffle files.
TURNS = 3
VERIFY_TURNS = 1
#: Pairs of prefix tokens for each class from which on all words are counted. Counting them and ordering all lines
#: anew takes as long as some 2,500 pairs a line.
MOST_MEETINGS = 5000
#: Index entries of cluster members that are sent to every task; more are joined in turns like the others.
MOST_BROADCAST = 500_000
#: Bits of the bitmap that tells which texts may be wanted: 262,144 rows of 64 are broadcast at most.
FILTER_BITS = 24
#: Classes that share three neighbouring prefix tokens vote for a centre from this number on.
CROWD = 32
#: Neighbouring triples of a class, from the common end of its prefix.
TRIPLES = 8
#: Smaller sets are in no cluster: no pair of them is settled by numbers alone.
LEAST_WORDS = 18
#: White space other than the line feed as blanks: splitting at one character needs no pattern. Most texts have
#: none of it, and looking for a character costs a fraction of a replacement that finds nothing.
BLANKS = "CASE WHEN contains({0}, '\t') OR contains({0}, '\x0B') OR contains({0}, '\f') OR contains({0}, '\r') THEN replace(replace(replace(replace({0}, '\t', ' '), '\x0B', ' '), '\f', ' '), '\r', ' ') ELSE {0} END"
WORDS = "array_remove(split({}, ' '), '')"
ID = ["doc", "tie", "line"]
#: The parity bitmap of a set: 64 bits, each the parity of the tokens that fall on it. Sets of more than `NARROW`
#: words have the part of it that falls to tokens with one further bit beside, which makes 128.
BITS = ["b0", "b1"]
NARROW = 96
PLACES = (1 << 32) - 1


def _keyed(documents: DataFrame, *more, once: bool = False) -> DataFrame:
    """doc, tie, text and `more` columns; tie is 0 unless some id comes more than once. `once`: identical rows are one."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    repeated = documents.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count()
    rows = documents.select(*more, doc.alias("doc"), F.expr("xxhash64(text)" if repeated else "0L").alias("tie"), "text")
    return rows.dropDuplicates(["doc", "tie"]) if once and repeated else rows


def rarity_levels(texts: DataFrame):
    """The sketch as a column: for each counter three times the logarithm of its words' count."""
    words = texts.selectExpr(f"explode(split(replace({BLANKS.format('text')}, '\n', ' '), ' ')) AS w").where("w <> ''")
    counts = words.selectExpr(f"shiftrightunsigned(xxhash64(w), 8) & {COUNTERS}L AS id").groupBy("id").count()
    level = F.least(F.lit(126), F.round(3 * F.log2("count"))).cast("int")
    every = texts.sparkSession.range(0, 1 << COUNTER_BITS, 1, 4).join(counts, "id", "left").select("id", F.coalesce(level, F.lit(0)).alias("level"))
    # 2 ** COUNTER_BITS numbers, whatever the input
    held = every.agg(F.expr("array_join(transform(array_sort(collect_list(struct(id, level))), x -> x.level), ',')")).first()[0]
    return F.split(F.lit(held), ",").cast("array<long>")


def meet_too_often(classes: DataFrame) -> bool:
    """Whether the prefixes of the classes have more than MOST_MEETINGS pairs of equal tokens for each class.

    Estimated from 2 ** COUNTER_BITS counters of all prefix tokens: the sum of their squares, less that of an even spread.
    """
    ids = classes.select(F.explode("prefix").alias("tok")).selectExpr(f"tok & {COUNTERS}L AS id")
    squares, all_ = ids.groupBy("id").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    return (squares or 0) - (all_ or 0) ** 2 / (1 << COUNTER_BITS) > MOST_MEETINGS * classes.count()


def tokenised(lines: DataFrame, levels, *carried: str) -> DataFrame:
    """`carried` and toks, the ordered distinct tokens of the column own: 56 bits of the hash, above them the level of the counter (if given) less the word's length."""
    sized = f"array_remove(array_distinct(transform(split(own, ' '), w -> shiftrightunsigned(xxhash64(w), 8) - shiftleft(cast(least(octet_length(w), {LONGEST}) AS long), 56))), shiftrightunsigned(xxhash64(''), 8))"
    if levels is None:
        return lines.selectExpr(*carried, f"sort_array({sized}) AS toks")
    lines = lines.withColumn("levels", levels).selectExpr(*carried, "levels", f"{sized} AS hs")
    return lines.selectExpr(*carried, f"sort_array(transform(hs, h -> h + shiftleft(coalesce(get(levels, cast(h & {COUNTERS}L AS int)), 0L), 56))) AS toks")


def _prefix(n: str, percent: int) -> str:
    return f"({n} - ({n} * {percent} + 99) div 100 + 1)"


def line_sets(texts: DataFrame, levels, percent: int) -> DataFrame:
    """doc, tie, line, n, key and key2 (128 bits of the set), bitmap and prefix of every line with a word."""
    lines = texts.selectExpr("doc", "tie", f"posexplode(split({BLANKS.format('text')}, '\\n')) AS (line, own)").where("trim(own) <> ''")
    return tokenised(lines, levels, *ID).selectExpr(*ID, "size(toks) AS n", "xxhash64(toks) AS key", "xxhash64(1, toks) AS key2", *_index_entry(percent))


def _index_entry(percent: int) -> list[str]:
    """Bitmap and prefix of the column toks."""
    # a set smaller than this has no similar set but itself
    alone = 100 * percent // (100 - percent) if percent < 100 else 10**9
    bits = [
        "aggregate(toks, 0L, (a, t) -> a ^ shiftleft(1L, cast(t & 63L AS int))) AS b0",
        f"CASE WHEN size(toks) > {NARROW} THEN aggregate(toks, 0L, (a, t) -> a ^ shiftleft(shiftrightunsigned(t, 6) & 1L, cast(t & 63L AS int))) ELSE 0L END AS b1",
    ]
    return [*bits, f"CASE WHEN size(toks) * 100 < {alone} THEN slice(toks, 1, 0) ELSE slice(toks, 1, cast({_prefix('size(toks)', percent)} AS int)) END AS prefix"]


def _needed(x: str, y: str, percent: int) -> str:
    """Words that two sets of these sizes have to share."""
    return f"((({x}) + ({y})) * {percent} + {99 + percent}) div {100 + percent}"


def _earlier(y: str, x: str) -> str:
    return f"({y}.doc < {x}.doc OR ({y}.doc = {x}.doc AND ({y}.tie < {x}.tie OR ({y}.tie = {x}.tie AND {y}.line < {x}.line))))"


def maybe_wanted(texts: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """The texts that `wanted` names by these columns (doc and tie), and few others: those whose bit of a broadcast bitmap is set.

    The bitmap has 2 ** FILTER_BITS bits, whatever the input; in a full one all texts pass, and none is ever lost.
    """
    place = f"shiftrightunsigned(xxhash64({', '.join(by or ('doc', 'tie'))}), {64 - FILTER_BITS})"
    bits = wanted.selectExpr(f"{place} AS place").groupBy(F.expr("shiftrightunsigned(place, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63L AS int)))").alias("held"))
    on = F.expr(f"shiftrightunsigned({place}, 6) = word AND (shiftrightunsigned(held, cast({place} & 63L AS int)) & 1L) = 1L")
    return texts.join(F.broadcast(bits), on, "left_semi")


def _fetch(texts: DataFrame, wanted: DataFrame, folder: str, name: str, *carried: str) -> DataFrame:
    """`carried`, doc, tie, line and own (the line itself) of the wanted lines (which have doc, tie, line)."""
    wanted = settle(wanted.select(*ID, *carried), folder, name)
    # texts that may be wanted are split; of their lines only those that may be wanted are moved
    lines = maybe_wanted(texts, wanted).selectExpr("doc", "tie", "posexplode(split(text, '\\n')) AS (line, own)")
    # one strategy at all sizes
    found = maybe_wanted(lines, wanted, *ID).join(wanted.hint("shuffle_hash"), ID)
    return found.selectExpr(*carried, *ID, f"{BLANKS.format('own')} AS own")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """cid, links, behind of every class in a verified pair (x and y with cid, copies and id): both get the other's copies."""
    sides = f"array(struct(x.cid AS cid, y.copies AS links, {_earlier('y', 'x')} AS behind), struct(y.cid AS cid, x.copies AS links, {_earlier('x', 'y')} AS behind))"
    return _summed(pairs.select(F.explode(F.expr(sides)).alias("e")).select("e.*"))


def _summed(links: DataFrame) -> DataFrame:
    return links.groupBy("cid").agg(F.sum("links").alias("links"), F.max("behind").alias("behind"))


def last_triples(classes: DataFrame) -> DataFrame:
    """cid and t0, t1, ...: the last TRIPLES neighbouring triples of each prefix, null where it has fewer.

    Columns instead of an array: no lambda, which would be interpreted for every token.
    """
    toks = classes.selectExpr("cid", *(f"get(prefix, size(prefix) - {k + 1}) AS g{k}" for k in range(TRIPLES + 2)))
    return toks.selectExpr("cid", *(f"CASE WHEN g{k + 2} IS NOT NULL THEN xxhash64(g{k + 2}, g{k + 1}, g{k}) END AS t{k}" for k in range(TRIPLES)))


def _triples(toks: str, first: str, last: str) -> str:
    return f"CASE WHEN {last} >= {first} THEN transform(sequence({first}, {last}), i -> xxhash64(get({toks}, i - 1), get({toks}, i), get({toks}, i + 1))) END AS ts"


def clusters(classes: DataFrame, texts: DataFrame, levels, percent: int, folder: str) -> DataFrame:
    """cid, kid, k (size of the centre), d, a, feats (words missing and added), copies, id, bitmap and prefix of members of crowded groups."""
    triples, every = last_triples(classes.where(f"n >= {LEAST_WORDS}")), ", ".join(f"t{k}" for k in range(TRIPLES))
    # a class counts for its least and its greatest triple; near copies share one of them often enough
    ends = triples.selectExpr(f"explode(array(least({every}), greatest({every}))) AS t").where("t IS NOT NULL")
    crowds = settle(ends.groupBy("t").count().where(f"count >= {CROWD}"), folder, "crowds")
    crowded = settle(triples.selectExpr("cid", f"explode(array({every})) AS t").where("t IS NOT NULL").join(crowds, "t").select("cid", "t", "count"), folder, "crowded")
    home = crowded.groupBy("cid").agg(F.max(F.struct("count", "t")).alias("h")).select("cid", F.col("h.t").alias("t"))
    wanted = classes.select("cid", "copies", *ID).join(home, "cid")
    sets = settle(tokenised(_fetch(texts, wanted, folder, "crowd-lines", "cid", "copies", "t"), levels, "cid", "copies", "t", *ID), folder, "crowd-sets")
    # the centre of a crowd: words that most of its members have
    sizes = sets.groupBy("t").agg(F.count("*").alias("size"))
    votes = sets.select("t", F.explode("toks").alias("tok")).groupBy("t", "tok").agg(F.count("*").alias("c"))
    centres = votes.join(sizes, "t").where("2 * c > size").groupBy("t").agg(F.sort_array(F.collect_list("tok")).alias("centre"), F.first("size").alias("size"))
    centres = settle(centres.groupBy(F.xxhash64("centre").alias("kid")).agg(F.sum("size").alias("size"), F.min("centre").alias("centre")), folder, "centres")
    # a class goes to the largest centre that has one of its triples
    of = centres.selectExpr("kid", "size", _triples("centre", "1", f"least(size(centre) - 2, cast({_prefix('size(centre)', percent)} AS int) + {TRIPLES})")).selectExpr("kid", "size", "explode(ts) AS t")
    best = of.groupBy("t").agg(F.max(F.struct("size", "kid")).alias("best"))
    chosen = crowded.join(best, "t").groupBy("cid").agg(F.max("best").alias("best")).select("cid", F.col("best.kid").alias("kid"))
    near = sets.drop("t").join(chosen, "cid").join(centres.select("kid", "centre"), "kid")
    near = near.selectExpr("cid", "copies", *ID, "kid", "size(toks) AS n", "size(centre) AS k", *_index_entry(percent), "array_except(centre, toks) AS missing", "array_except(toks, centre) AS added")
    near = near.where("2 * (k - size(missing)) >= k + size(added)")  # at least half alike
    # no word of the centre is added, and only those are missing: a word that two members have in feats is missing from both, or added to both
    return settle(near.selectExpr("cid", "copies", *ID, "kid", "k", "n", *BITS, "prefix", "size(missing) AS d", "size(added) AS a", "concat(missing, added) AS feats"), folder, "members")


def links_within(members: DataFrame, percent: int, folder: str) -> list[DataFrame]:
    """cid, links, behind from pairs of members of one cluster; see step 4 above."""
    # more common words that the pair needs than its numbers assure
    lacking = f"{_needed('x.k - x.d + x.a', 'y.k - y.d + y.a', percent)} - (x.k - x.d - y.d)"
    profile = ["kid", "k", "d", "a"]
    profiles = settle(members.groupBy(*profile).agg(F.sum("copies").alias("copies"), F.min(F.struct(*ID)).alias("first")), folder, "profiles")
    sure = profiles.alias("x").join(profiles.alias("y"), F.expr(f"x.kid = y.kid AND {lacking} <= 0")).groupBy(*(F.col(f"x.{c}").alias(c) for c in profile)).agg(F.sum("y.copies").alias("links"), F.min("y.first").alias("first"))
    own = lacking.replace("x.", "").replace("y.", "")
    counted = members.join(settle(sure, folder, "sure"), profile).select("cid", F.expr(f"links - CASE WHEN {own} <= 0 THEN copies ELSE 0 END").alias("links"), (F.col("first") < F.struct(*ID)).alias("behind"))
    open_ = members.select("*", F.explode("feats").alias("f"))
    met = "x.kid = y.kid AND x.f = y.f AND x.cid < y.cid"
    room = f"{lacking} BETWEEN 1 AND least(x.d, y.d) + least(x.a, y.a)"
    common = "array_intersect(x.feats, y.feats)"
    pairs = open_.alias("x").join(open_.alias("y"), F.expr(f"{met} AND {room} AND size({common}) >= {lacking} AND array_min({common}) = x.f"))
    return [counted.where("links > 0"), _both_ways(pairs)]


def octave(n: str) -> str:
    """A number below 64 that is the same for all sizes from one power of two to the next."""
    return f"cast(floor(log2({n})) AS long)"


def octaves_above(n: str, percent: int) -> str:
    """The octaves of all sizes that a similar set may have which is not smaller."""
    return f"sequence({octave(n)}, {octave(f'({n}) * 100 div {percent}')})"


def candidates(loose: DataFrame, members: DataFrame, percent: int, folder: str) -> DataFrame:
    """a, b: distinct pairs of classes, not of one cluster, that pass the filters of the prefix index."""
    # the smaller set (of equal ones that of the lesser cid) is found by its index prefix, the other probes with its whole prefix
    reach = lambda s: f"({s}.n - ({2 * percent} * {s}.n + {99 + percent}) div {100 + percent} + 1)"
    need = _needed("x.n", "y.n", percent)
    smaller = "(y.n < x.n OR (y.n = x.n AND y.cid < x.cid))"
    wide = "bit_count(x.b1 ^ y.b1) + bit_count(x.b0 ^ x.b1 ^ y.b0 ^ y.b1)"
    fits = [
        f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}",
        f"CASE WHEN least(x.n, y.n) > {NARROW} THEN {wide} ELSE bit_count(x.b0 ^ y.b0) END <= x.n + y.n - 2 * ({need})",
        # a pair is found at its first common token, before which nothing is shared
        f"least(x.n - x.pos, y.n - y.pos) >= {need}",
    ]
    either = f"CASE WHEN {smaller} THEN y.pos < {reach('y')} ELSE x.pos < {reach('x')} END"
    # one long holds size and place, to move fewer bytes
    u, c = (df.select("cid", *BITS, *(c for c in df.columns if c == "kid"), F.shiftleft(F.col("n").cast("long"), 32).alias("at"), F.posexplode("prefix").alias("pos", "tok")).withColumn("at", F.col("at") + F.col("pos")).drop("pos") for df in (loose, members))

    def met(x: DataFrame, y: DataFrame, *more: str) -> DataFrame:
        on = " AND ".join(["x.tok = y.tok", *more, *fits])
        for s in "xy":
            on = on.replace(f"{s}.n", f"cast({s}.at >> 32 AS int)").replace(f"{s}.pos", f"cast({s}.at & {PLACES}L AS int)")
        return x.alias("x").join(y.alias("y"), F.expr(on)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))

    parts = []
    for k in range(TURNS):
        own = u.where(F.pmod("tok", F.lit(TURNS)) == k)
        found = F.expr(f"cast(at & {PLACES}L AS int) < {reach('own')}".replace("own.n", "cast(at >> 32 AS int)"))
        # sets meet where their token and the octave of their sizes are equal; the smaller is in all octaves that the larger may be in
        probing = own.withColumn("tok", F.expr(f"tok ^ {octave('cast(at >> 32 AS int)')}"))
        meeting = own.where(found).withColumn("octave", F.explode(F.expr(octaves_above("cast(at >> 32 AS int)", percent)))).withColumn("tok", F.expr("tok ^ octave")).drop("octave")
        parts.append(settle(met(probing, meeting, smaller).distinct(), folder, f"met-{k}"))
        release(loose.sparkSession)
    # members of clusters meet what is in none, and members of other clusters where a token is in several
    mixed = c.groupBy("tok").agg(F.min("kid").alias("low"), F.max("kid").alias("high")).where("low <> high").select("tok")
    several = c.join(mixed, "tok", "left_semi")
    if c.count() <= MOST_BROADCAST:
        parts.append(met(u, F.broadcast(c), either))
    else:
        for k in range(TURNS):
            turn = F.pmod("tok", F.lit(TURNS)) == k
            parts.append(settle(met(u.where(turn), c.where(turn), either).distinct(), folder, f"mixed-{k}"))
            release(loose.sparkSession)
    parts.append(met(several, several, "x.cid < y.cid", "x.kid <> y.kid", either))
    out = settle(functools.reduce(DataFrame.union, parts).distinct(), folder, "candidates")
    release(loose.sparkSession, folder, *(f"{name}-{k}" for name in ("met", "mixed") for k in range(TURNS)))
    return out


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, folder: str) -> DataFrame:
    """cid, links, behind from candidates, compared on the words of both lines."""
    spark = texts.sparkSession
    cids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = classes.select("cid", "copies", *ID).join(cids, "cid")
    # a set of words is moved as one text
    words = _fetch(texts, wanted, folder, "candidate-lines", "cid", "copies").selectExpr("cid", "copies", *ID, f"array_distinct({WORDS.format('own')}) AS ws").selectExpr("cid", "copies", *ID, "size(ws) AS n", "array_join(ws, ' ') AS words")
    words = settle(words, folder, "candidate-words")
    release(spark)
    left, right = (words.select(F.col("cid").alias(c), F.struct("cid", "copies", *ID).alias(s), F.col("n").alias(f"{s}n"), F.col("words").alias(f"{s}words")) for c, s in (("a", "x"), ("b", "y")))
    parts = []
    for k in range(VERIFY_TURNS):
        turn = F.pmod(F.xxhash64("a"), F.lit(VERIFY_TURNS)) == k
        # one strategy at all sizes; a class is one row of the side that is held, however many pairs it has
        both = pairs.where(turn).join(left.where(turn).hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b")
        # words of x less those that y lacks: fewer are put into a second set than by an intersection
        both = both.where(f"{100 + percent} * (xn - size(array_except(split(xwords, ' '), split(ywords, ' ')))) >= {percent} * (xn + yn)").select("x", "y")
        parts.append(settle(_both_ways(both), folder, f"verified-{k}"))
        release(spark)
    release(spark, folder, "candidate-words", "candidate-lines", "candidates")
    return functools.reduce(DataFrame.union, parts)


def outside(classes: DataFrame, members: DataFrame, folder: str) -> DataFrame:
    """The classes that are in no cluster. The few members are taken out while the classes are read; of many, the rest is written."""
    cids = members.select("cid")
    if cids.count() <= MOST_BROADCAST:
        return classes.join(F.broadcast(cids), "cid", "left_anti")
    return settle(classes.join(cids, "cid", "left_anti"), folder, "loose")


def line_classes(texts: DataFrame, percent: int, folder: str):
    """The sets of all lines, their classes, and the levels of the words' counters if those had to be counted (else None)."""
    spark, levels = texts.sparkSession, None
    while True:
        name = "" if levels is None else "-counted"
        every = settle(line_sets(texts, levels, percent), folder, f"sets{name}")
        first = every.groupBy("key", "key2").agg(F.min(F.struct(*ID, "n", *BITS, "prefix")).alias("first"), F.count("*").alias("copies"))
        classes = settle(first.select(F.monotonically_increasing_id().alias("cid"), "key", "key2", "copies", "first.*"), folder, f"classes{name}")
        if levels is not None or not meet_too_often(classes):
            release(spark)
            return every, classes, levels
        release(spark, folder, "sets", "classes")
        levels = rarity_levels(texts)


def linked_lines(documents: DataFrame, percent: int = 80, folder: str | None = None) -> DataFrame:
    """doc, tie, line, key and key2 (128 bits of the set), links (to other lines, equal ones too) and gone of every line with a word."""
    spark = documents.sparkSession
    folder = folder or shared_folder(spark)
    texts = _keyed(documents, once=True)
    every, classes, levels = line_classes(texts, percent, folder)
    lines = every.select(*ID, "key", "key2")

    members = clusters(classes, texts, levels, percent, folder)
    links = [settle(df, folder, f"within-{k}") for k, df in enumerate(links_within(members, percent, folder))]
    wide = classes.where("size(prefix) > 0").select("cid", "n", *BITS, "prefix")
    loose = outside(wide, members, folder)
    clustered = members.select("cid", "n", *BITS, "prefix", "kid")
    classes = classes.drop("prefix", "n", *BITS)
    release(spark, folder, "crowded", "crowd-lines", "crowd-sets")
    pairs = candidates(loose, clustered, percent, folder)
    release(spark, folder, "loose")
    links.append(verified(pairs, classes, texts, percent, folder))
    linked = settle(_summed(functools.reduce(DataFrame.unionByName, links)), folder, "linked")

    known = classes.select("cid", "key", "key2", "copies", F.struct(*ID).alias("first")).join(linked, "cid", "left").where("copies > 1 OR links > 0").drop("cid")
    known = settle(known, folder, "known")
    release(spark, folder, "classes", "classes-counted")
    # a class is one row of the side that is held, however many lines it has
    out = lines.join(known.hint("shuffle_hash"), ["key", "key2"], "left")
    return out.select(*ID, "key", "key2", F.expr("coalesce(copies - 1, 0L) + coalesce(links, 0L)").alias("links"), F.expr("coalesce(behind, false) OR coalesce(first <> struct(doc, tie, line), false)").alias("gone"))


def judge(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed_lines (numbers from 0), n_links and lines of every row.

    lines has line, class and links of each line with a word, by line. Lines of one class are equal sets; links
    counts the other lines, of any class, that are similar enough, earlier and later ones. n_links is their sum.
    """
    folder = shared_folder(documents.sparkSession)
    # rows of one text come from everywhere: summed up before they meet, they would hardly be fewer; where they meet, their document joins them
    lines = linked_lines(documents, percent, folder).repartition("doc", "tie")
    per = lines.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("line", "key", "key2", "links", "gone"))).alias("all"))
    rows = _keyed(documents, "doc_id").select("doc_id", "doc", "tie").join(per, ["doc", "tie"], "left")
    hexed = "concat(lpad(lower(hex(x.key)), 16, '0'), lpad(lower(hex(x.key2)), 16, '0'))"
    return rows.selectExpr(
        "cast(doc_id AS long) AS doc_id", "coalesce(cast(size(all) AS long), 0L) AS n_lines",
        "coalesce(cast(size(filter(all, x -> x.gone)) AS long), 0L) AS n_removed",
        "coalesce(transform(filter(all, x -> x.gone), x -> x.line), cast(array() AS array<int>)) AS removed_lines",
        "coalesce(aggregate(all, 0L, (s, x) -> s + x.links), 0L) AS n_links",
        f"coalesce(transform(all, x -> struct(x.line AS line, {hexed} AS class, x.links AS links)), cast(array() AS array<struct<line:int,class:string,links:bigint>>)) AS lines",
    )


def drop_lines(documents: DataFrame, columns: list[str], percent: int = 80, counted: str | None = None) -> DataFrame:
    """The documents less their later lines; a text whose words are all gone goes with its row.

    A text without words in the input (null, empty, blank) stays as it is. `counted` names a column that
    holds the number of characters, set anew where a text has changed.
    """
    folder = shared_folder(documents.sparkSession)
    lines = linked_lines(documents, percent, folder)
    per = lines.groupBy("doc", "tie").agg(F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("cut"), F.bool_and("gone").alias("whole"))
    per = settle(per.where("size(cut) > 0"), folder, "changes")
    # the other columns of a row are carried as one, so that no name of their own can clash
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in columns if c != "text"))
    rows = _keyed(documents, others.alias("row")).join(per, ["doc", "tie"], "left").where("whole IS NULL OR NOT whole")
    text = F.expr("CASE WHEN cut IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), (l, i) -> NOT array_contains(cut, i)), '\\n') END")
    new = {"text": text, counted: F.when(F.col("cut").isNull(), F.col("row").getField(counted)).otherwise(F.length(text)).cast(documents.schema[counted].dataType) if counted else None}
    return rows.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: every line of every document."""
    return judge(table(spark, sf_dir, "documents"))
