"""Quality rules: a decision list of threshold conjunctions, learned from labelled statistics.

Statistics of whole texts are counted in byte kernels (one pass, no shuffle). Sequential covering then
grows one conjunction after another on two thirds of a bounded sample of labelled rows, prunes it on the
remaining third, removes what it covers and goes on; the ordered rules become one CASE expression that
Spark evaluates beside the statistics.

Null and empty texts have zero statistics. Repeated rows are judged alike and all come out. Labels
without a document, without a value, or with a null id are not learned from; an id with contradicting
labels counts once for each. With no usable labels the list is empty and only the base rule judges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, blocks, byte_texts, free_name, table

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")
WINDOW = 8
#: Base rule: fewer words, or a larger percentage of them in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 20, 30

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?;:")] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER = _IS_UPPER.copy()
_IS_LETTER[97:123] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _codes(values) -> np.ndarray:
    return pd.factorize(values)[0]


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a block; raw holds the texts end to end."""
    n = len(offsets) - 1
    data = raw.tobytes()
    words: list[bytes] = []
    n_words = np.zeros(n, np.int64)
    dup_lines, n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        text = data[offsets[i] : offsets[i + 1]]
        own = text.split()
        words += own
        n_words[i] = len(own)
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        n_lines[i] = len(lines)
        dup_lines[i] = len(lines) - len(set(lines))
    starts = np.concatenate(([0], np.cumsum(n_words)))
    word = _codes(np.array(words, dtype=object)) if words else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), n_words)

    # codes of windows of 2, 4 and 8 words; equal codes are equal windows
    code, width = word, 1
    while width < WINDOW and len(code) > width:
        code = _codes(code[:-width].astype(np.int64) * (int(code.max()) + 1) + code[width:])
        width *= 2
    repeated = np.zeros(len(word), bool)
    if width == WINDOW and len(word) >= WINDOW:
        inside = owner[: len(code)] == owner[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        same = _codes(code[at].astype(np.int64) * n + owner[at])
        many = at[np.bincount(same)[same] > 1] if len(at) else at
        steps = np.zeros(len(word) + 1, np.int64)
        np.add.at(steps, many, 1)
        np.add.at(steps, many + WINDOW, -1)
        repeated = np.cumsum(steps[:-1]) > 0
    distinct = np.zeros(n, np.int64)
    if len(word):
        first = np.unique(owner * (int(word.max()) + 1) + word)
        distinct = np.bincount(first // (int(word.max()) + 1), minlength=n)
    chars = (raw & 0xC0) != 0x80
    return {
        "n_words": n_words,
        "word_chars": _per_text(chars & ~SPACE[raw], offsets),
        "n_symbols": _per_text(_IS_SYMBOL[raw], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.diff(np.concatenate(([0], np.cumsum(repeated)))[starts]),
        "n_lines": n_lines,
        "n_upper": _per_text(_IS_UPPER[raw], offsets),
        "n_letters": _per_text(_IS_LETTER[raw], offsets),
        "n_marks": _per_text(_IS_MARK[raw], offsets),
        "n_distinct": distinct,
    }


def with_counts(df: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""

    def kernel(batches):
        for batch in batches:
            raw, offsets = byte_texts(batch.column(1))
            for a, b in blocks(np.diff(offsets)):
                found = text_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(found[k], pa.int64()) for k in COUNTS)], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(kernel, schema)


#: name: (numerator, factor, denominator); a value is numerator * factor / max(denominator, 1), in exact double steps.
FEATURES = {
    "words": ("n_words", 1, None),
    "symbols_per_word": ("n_symbols", 1, "n_words"),
    "marks_per_word": ("n_marks", 1, "n_words"),
    "chars_per_word": ("word_chars", 1, "n_words"),
    "repeated_share": ("n_repeat_words", 1, "n_words"),
    "dup_line_share": ("n_dup_lines", 1, "n_lines"),
    "words_per_line": ("n_words", 1, "n_lines"),
    "upper_share": ("n_upper", 1, "n_letters"),
    "letters_per_char": ("n_letters", 1, "word_chars"),
    "distinct_share": ("n_distinct", 1, "n_words"),
}


def feature_column(name: str) -> Column:
    top, factor, bottom = FEATURES[name]
    value = F.col(top).cast("double") * F.lit(float(factor))
    return value / F.greatest(F.col(bottom), F.lit(1)).cast("double") if bottom else value


def feature_matrix(counts: pd.DataFrame) -> np.ndarray:
    columns = []
    for top, factor, bottom in FEATURES.values():
        value = counts[top].to_numpy(float) * factor
        columns.append(value / np.maximum(counts[bottom].to_numpy(float), 1) if bottom else value)
    return np.column_stack(columns) if len(counts) else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Test:
    """One threshold: feature > cut, or feature <= cut."""

    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.cut if self.above else x[:, self.feature] <= self.cut

    def column(self) -> Column:
        value = feature_column(list(FEATURES)[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{list(FEATURES)[self.feature]} {'>' if self.above else '<='} {self.cut:.6g}"


def covered(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _best_test(x: np.ndarray, bad: np.ndarray, inside: np.ndarray, most_cuts: int) -> tuple[float, Test | None]:
    """The test with the largest information gain over the rows the rule holds so far."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0:
        return 0.0, None
    base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for f in range(x.shape[1]):
        values = x[inside, f]
        order = np.argsort(values, kind="stable")
        v, hits = values[order], np.cumsum(bad[inside][order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        if len(ends) > most_cuts:
            ends = ends[np.linspace(0, len(ends) - 1, most_cuts).astype(int)]
        cuts = (v[ends] + v[ends + 1]) / 2
        below_p, below = hits[ends], ends + 1
        for above, p, t in ((False, below_p, below), (True, p0 - below_p, p0 + n0 - below)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / t) - base)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Test(f, above, float(cuts[k])))
    return best


def _worth(rule: list[Test], x: np.ndarray, bad: np.ndarray) -> float:
    """(p - n) / (p + n) on held-out rows: what pruning maximises."""
    hit = covered(rule, x)
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_tests: int = 4, least_precision: float = 0.8, most_cuts: int = 256) -> list[list[Test]]:
    """Sequential covering: rules in order, each a conjunction that rejects. fold: True where a row prunes."""
    rules: list[list[Test]] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[left & ~fold].any():
        grow, prune = left & ~fold, left & fold
        rule: list[Test] = []
        inside = grow.copy()
        while len(rule) < most_tests and (~bad[inside]).any():
            _, test = _best_test(x, bad, inside, most_cuts)
            if test is None:
                break
            rule.append(test)
            inside &= test.holds(x)
        while len(rule) > 1 and _worth(rule[:-1], x[prune], bad[prune]) >= _worth(rule, x[prune], bad[prune]):
            rule = rule[:-1]
        hit = covered(rule, x) & left
        if not rule or not hit.any() or bad[hit].mean() < least_precision or bad[hit & ~fold].sum() < 2:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_expression(rules: list[list[Test]]) -> tuple[Column, Column]:
    """(number of the first rule that holds, or null; the same list as text) as ordered conditionals."""
    number = F.lit(None).cast("int")
    said = F.lit(None).cast("string")
    for k in reversed(range(len(rules))):
        holds = rules[k][0].column()
        for test in rules[k][1:]:
            holds &= test.column()
        number = F.when(holds, F.lit(k)).otherwise(number)
        said = F.when(holds, F.lit(" and ".join(map(str, rules[k])))).otherwise(said)
    return number, said


def labelled_sample(documents: DataFrame, labels: DataFrame, most_rows: int) -> pd.DataFrame:
    """At most most_rows labelled documents with their counts; those with the least hash of their id.

    An id that several rows bear counts once, with the least counts among them.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(most_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = F.broadcast(chosen.groupBy("doc_id").agg(F.sum("quality").alias("good"), F.count("*").alias("n")))  # most_rows bounds it
    picked = with_counts(texts.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi"))
    one = picked.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "c.*")
    return one.join(wanted, "doc_id").toPandas().sort_values("doc_id", ignore_index=True)


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = 10_000) -> list[list[Test]]:
    """The decision list learned from a bounded sample of labelled documents."""
    sample = labelled_sample(documents, labels, most_rows)
    # what the base rule rejects teaches the list nothing
    sample = sample[(sample["n_words"] >= LEAST_WORDS) & (100 * sample["n_repeat_words"] <= MOST_REPEATED * sample["n_words"])]
    if not len(sample):
        return []
    bad = sample["good"].to_numpy() * 2 < sample["n"].to_numpy()
    fold = pd.util.hash_array(sample["doc_id"].to_numpy(np.int64)) % 3 == 0
    return learn(feature_matrix(sample), bad, fold)


def judge(documents: DataFrame, rules: list[list[Test]], least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """Counts, base verdict, deciding rule and kept of every document."""
    number, said = as_expression(rules)
    base = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(most_repeated) * F.col("n_words"))
    return (
        with_counts(documents)
        .withColumn("base_failed", base)
        .withColumn("rule_no", number)
        .withColumn("rule", said)
        .withColumn("kept", ~F.col("base_failed") & F.col("rule_no").isNull())
    )


def keep_good(documents: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that the base rule and the decision list keep, with the given columns."""
    rules = fit(documents, labels)
    number, _ = as_expression(rules)
    names = [free_name(columns, f"_{k}") for k in COUNTS]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def kernel(batches):
        for batch in batches:
            raw, offsets = byte_texts(batch.column(batch.schema.get_field_index("text")))
            for a, b in blocks(np.diff(offsets)):
                found = text_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(found[k], pa.int64()) for k in COUNTS)], [*columns, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{n} long" for n in names)])
    counted = documents.select(*columns).mapInArrow(kernel, schema)
    inner = counted.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *(F.col(f"`{n}`").alias(k) for n, k in zip(names, COUNTS, strict=True)))
    good = inner.where((F.col("n_words") >= LEAST_WORDS) & (F.lit(100) * F.col("n_repeat_words") <= F.lit(MOST_REPEATED) * F.col("n_words")) & number.isNull())
    return good.select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(documents, table(spark, sf_dir, "labels")))
