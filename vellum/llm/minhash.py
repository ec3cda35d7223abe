"""Near-duplicates by b-bit MinHash: bands of minima propose, packed low bits estimate, full sets confirm.

1. One kernel per text: distinct word shingles, 2048 minima, 32 band keys of 4 minima each, low bits of every
   minimum (2 of its hash) packed into 64 longs, and a 128-bit fingerprint of the set.
2. Texts with one and the same set become one class, whatever their number.
3. Every class is compared with the first class of each of its bands; the packed bits estimate the
   similarity (corrected for chance agreement), and what can pass is confirmed on the full sets.
   Components of those links make most of a group of copies one component.
4. Classes of one band that are not yet in one component are compared pair by pair under the same
   estimate, so that no link between components is missed; components are taken again. Of such a pair one
   class at least is outside of the band's largest component: only those look for others.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 32 < 5e-8, and the estimate
lets pairs pass down to 4.5 standard errors (of 0.0105) below the threshold.

A text without words (null, empty, white space) has an empty set, is linked with nothing and is its own
component. Repeated rows with one id come out as often as they go in. A row with a null id takes no part:
its component is null and it is kept. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import LOWERED, blocks, byte_texts, mix, release, settle, shared_folder, table, word_hashes, word_ranges
from vellum.llm.graph import components

BANDS, ROWS, BITS = 32, 4, 2
PERMUTATIONS = 2048  # the first BANDS * ROWS make the bands, all of them the packed bits
LONGS = PERMUTATIONS * BITS // 64
_random = np.random.default_rng(20240607)
_FACTORS = _random.integers(1 << 31, dtype=np.uint32, size=PERMUTATIONS) * np.uint32(2) + np.uint32(1)
_MIXERS = _random.integers(1 << 63, dtype=np.uint64, size=16) * np.uint64(2) + np.uint64(1)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each text's distinct shingles, texts in order; raw is lower-cased already."""
    starts, ends, owner = word_ranges(raw, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = word_hashes(raw, starts, ends)
    per = np.bincount(owner, minlength=n)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if len(word) >= width:
        at = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        full = np.zeros(len(at), np.uint64)
        for k in range(width):
            full += word[at + k] * _MIXERS[k]
        full = mix(full + np.uint64(width))
    # texts with fewer words: the whole sequence is the one shingle
    few = np.flatnonzero((per > 0) & (per < width))
    first = np.concatenate(([0], np.cumsum(per)))
    short = np.zeros(len(few), np.uint64)
    for k in range(width - 1):
        has = per[few] > k
        short[has] += word[first[few[has]] + k] * _MIXERS[k]
    short = mix(short + per[few].astype(np.uint64))
    hashes = np.concatenate((full, short))
    owners = np.concatenate((owner[at], few))
    fresh = ~pd.Series(hashes ^ mix(owners.astype(np.uint64) + np.uint64(1))).duplicated().to_numpy()
    hashes, owners = hashes[fresh], owners[fresh]
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def signatures(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima that make the bands, packed low bits of all minima) of each run of hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(low)
    minima = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    packed = np.zeros((LONGS, len(starts)), np.uint64)
    each = 64 // BITS
    for k in range(PERMUTATIONS):  # an odd factor permutes the 32-bit integers
        np.multiply(low, _FACTORS[k], out=turned)
        least = np.minimum.reduceat(turned, starts)
        if k < len(minima):
            minima[k] = least
        # low bits of a hash of the minimum: minima alone are small numbers
        bits = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        packed[k // each] |= bits.astype(np.uint64) << np.uint64(k % each * BITS)
    return minima, packed


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.empty((BANDS, minima.shape[1]), np.uint64)
    for b in range(BANDS):
        total = np.full(minima.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            total = mix(total * _MIXERS[8 + r] + minima[b * ROWS + r].astype(np.uint64))
        keys[b] = total
    return keys


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, fingerprint (f1, f2), packed bits (s0...) and bands of every text."""

    def kernel(batches):
        for batch in batches:
            raw, offsets = byte_texts(batch.column(1))
            for a, b in blocks(np.diff(offsets)):
                part = LOWERED[raw[offsets[a] : offsets[b]]]
                hashes, owners = shingle_hashes(part, offsets[a : b + 1] - offsets[a], width)
                n = b - a
                size = np.bincount(owners, minlength=n)
                has = np.flatnonzero(size)
                f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bits, keys = np.zeros((LONGS, n), np.uint64), np.zeros((0, BANDS), np.uint64)
                if len(has):
                    starts = np.concatenate(([0], np.cumsum(size[has])[:-1]))
                    f1[has] = np.add.reduceat(mix(hashes), starts)
                    f2[has] = np.add.reduceat(mix(hashes + np.uint64(77)), starts)
                    minima, bits[:, has] = signatures(hashes, starts)
                    keys = band_keys(minima).T
                ends = np.concatenate(([0], np.cumsum((size > 0) * BANDS))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(keys).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(size, pa.int64()), signed(f1), signed(f2), *(signed(np.ascontiguousarray(x)) for x in bits), bands],
                    ["doc_id", "tie", "n_shingles", "f1", "f2", *(f"s{k}" for k in range(LONGS)), "bands"],
                )

    schema = "doc_id long, tie long, n_shingles long, f1 long, f2 long, " + ", ".join(f"s{k} long" for k in range(LONGS)) + ", bands array<long>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie")).mapInArrow(kernel, schema)


def may_pass(a: str, b: str, percent: int):
    """The corrected estimate from packed bits, less 4.5 standard errors, reaches the threshold."""
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        both = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ += F.bit_count(both)
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * percent / 100
    error = (agree * (1 - agree) / PERMUTATIONS) ** 0.5
    return differ <= int(PERMUTATIONS * (1 - agree + 4.5 * error)) + 1


def _size_fits(a: str, b: str, percent: int):
    return (F.col(f"{a}.n_shingles") * 100 >= F.col(f"{b}.n_shingles") * percent) & (F.col(f"{b}.n_shingles") * 100 >= F.col(f"{a}.n_shingles") * percent)


def confirm(pairs: DataFrame, documents: DataFrame, classes: DataFrame, width: int, percent: int, once: bool, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets of shingles, word by word, are similar enough; once: no id is repeated."""
    pairs = settle(pairs, folder, f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    lead = classes.join(wanted, "node").select("node", "rep", "f1", "f2")
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    texts = settle(lead.hint("merge").join(texts, "rep").select("node", "f1", "f2", "text"), folder, f"{name}-texts")
    left = texts.select(F.col("node").alias("a"), F.col("f1").alias("af"), F.col("text").alias("at"))
    right = texts.select(F.col("node").alias("b"), F.col("f1").alias("bf"), F.col("text").alias("bt"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "af", "bf", "at", "bt")

    def shingles(data: bytes) -> frozenset:
        words = data.lower().split()  # A-Z alone, and the six ASCII white-space characters
        return frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)])

    def kernel(batches):
        for batch in batches:
            (ra, oa), (rb, ob) = byte_texts(batch.column(4)), byte_texts(batch.column(5))
            # an id that comes with several texts joins all of them: only the class's own text counts
            good = own_text(ra, oa, batch.column(2)) & own_text(rb, ob, batch.column(3))
            for k in np.flatnonzero(good).tolist():
                # on the words themselves, not on their hashes
                x, y = shingles(ra[oa[k] : oa[k + 1]].tobytes()), shingles(rb[ob[k] : ob[k + 1]].tobytes())
                shared = len(x & y)
                good[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    def own_text(raw, offsets, prints) -> np.ndarray:
        if once:
            return np.ones(len(prints), bool)
        found = np.zeros(len(prints), np.uint64)
        for x, y in blocks(np.diff(offsets)):
            hashes, owners = shingle_hashes(LOWERED[raw[offsets[x] : offsets[y]]], offsets[x : y + 1] - offsets[x], width)
            np.add.at(found[x:y], owners, mix(hashes))
        return found == prints.to_numpy().view(np.uint64)

    found = settle(both.mapInArrow(kernel, "a long, b long"), folder, f"{name}-links")
    release(documents.sparkSession, folder, f"{name}-pairs", f"{name}-texts")
    return found


def grouped(documents: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """doc_id, tie, n_shingles, component (null without words or id) and component_id of every row."""
    once = not documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    rows = settle(sketch(documents, width), folder, "sketch")
    real = rows.where("n_shingles > 0 and doc_id is not null").withColumn("node", F.xxhash64("f1", "f2", "n_shingles"))
    bits = [f"s{k}" for k in range(LONGS)]
    # texts of one set have one sketch: any of them stands for the class
    sketches = real.groupBy("node", "f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", *bits)).alias("s"))
    sketches = settle(sketches.select("node", "f1", "f2", "n_shingles", "rep", "s.*"), folder, "classes")
    classes = sketches.select("node", "f1", "f2", "n_shingles", "rep")
    slim = settle(rows.select("doc_id", "tie", "n_shingles", "f1", "f2"), folder, "rows")
    release(documents.sparkSession, folder, "sketch")
    entries = sketches.select("node", F.posexplode("bands").alias("no", "band"))
    leaders = settle(entries.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader"), folder, "leaders")
    shared = settle(entries.join(leaders, "band"), folder, "shared")  # classes with company in a band

    light = sketches.select("node", "n_shingles", "bands", *bits)
    # a class has at most BANDS leaders
    led = shared.where("node <> leader").groupBy("node").agg(F.collect_set("leader").alias("leaders"))
    stars = led.join(light, "node").select(F.struct("node", "n_shingles", *bits).alias("x"), F.explode("leaders").alias("b"))
    stars = stars.join(light.alias("y"), F.col("b") == F.col("y.node")).where(may_pass("x", "y", percent) & _size_fits("x", "y", percent))
    links = confirm(stars.select(F.col("x.node").alias("a"), "b"), documents, classes, width, percent, once, folder, "stars")
    groups = settle(components(links, folder, "first"), folder, "first-components")

    # bands whose classes are not all in one component yet
    held = shared.select("no", "band", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = settle(held, folder, "held")
    parts = held.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
    mixed = settle(parts.where("parts > 1").select("band", F.col("largest.component").alias("major")), folder, "mixed")
    open_ = settle(held.join(mixed, "band").withColumn("minor", F.expr("component <> major")).drop("major").join(light, "node"), folder, "open")
    # Of two components in a band one at least is not its largest: only classes outside of that look for others, so that
    # a large group of near copies is not joined with itself. Each pair in the first band that it shares, once.
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.no") + 1
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.minor") | (F.col("x.node") < F.col("y.node")))
    crossed = open_.where("minor").alias("x").join(open_.alias("y"), met & _size_fits("x", "y", percent) & may_pass("x", "y", percent) & first)
    crossed = crossed.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = confirm(crossed, documents, classes, width, percent, once, folder, "crossed")
    release(documents.sparkSession, folder, "leaders", "shared", "held", "mixed", "open")
    groups = settle(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), folder, "second"), folder, "second-components")

    member = classes.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    member = settle(member, folder, "members")
    release(documents.sparkSession, folder, "classes")
    least = settle(member.groupBy("component").agg(F.min("rep").alias("component_id")), folder, "least")
    named = settle(member.join(least, "component").select("node", "component", "component_id"), folder, "named")
    rows = slim.select("doc_id", "tie", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("f1", "f2", "n_shingles")).alias("node"))
    return rows.join(named, "node", "left").select("doc_id", "tie", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    out = grouped(documents, width, percent, folder or shared_folder(documents.sparkSession)).drop("tie", "component")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame, columns: list[str], width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, whole rows: that of the least id, then of the least hash of its text.

    Rows that share an id but not the text are different documents, identical rows are one.
    """
    folder = shared_folder(documents.sparkSession)
    rows = settle(grouped(documents, width, percent, folder), folder, "grouped")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("first")).select("first.*")
    kept = settle(first.union(rows.where("component IS NULL AND doc_id IS NOT NULL").select("doc_id", "tie").distinct()), folder, "kept")
    whole = documents.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("tie"))
    named = whole.where("doc IS NOT NULL").join(kept.withColumnRenamed("doc_id", "doc"), ["doc", "tie"], "left_semi")
    if rows.where("doc_id IS NOT NULL").groupBy("doc_id", "tie").count().where("count > 1").limit(1).count():
        named = named.dropDuplicates(["doc", "tie"])
    return named.unionByName(whole.where("doc IS NULL")).select(*(F.col("row").getField(c).alias(c) for c in columns))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles, eighty percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
