"""Texts to lines, shingles and blocks with exact byte ranges."""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import REPETITION
from vellum.functions.text import tokens

#: What stands between paragraphs.
BLANK_LINES = r"(?:\r?\n){2,}"


def line_spans(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, line, byte_start, byte_end: half-open UTF-8 ranges without the line feed.

    One shuffle by document and a running sum: linear in the number of lines of a text.
    """
    size = F.octet_length("line").cast("long")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(documents).withColumn("byte_end", F.sum(size + 1).over(before) - 1)
    return rows.select("doc_id", "line_no", "line", (F.col("byte_end") - size).alias("byte_start"), "byte_end")


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, line without offsets."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, block_no, block, byte_start, byte_end: what stands between runs of two or more line ends.

    Offsets are summed inside of a row, from the blocks and their separators; nothing is shuffled.
    """
    parts = documents.select("doc_id", F.split("text", BLANK_LINES).alias("b"), F.regexp_extract_all("text", F.lit(BLANK_LINES), F.lit(0)).alias("s"))
    sizes = parts.withColumn("n", F.transform("b", lambda x: F.octet_length(x).cast("long"))).withColumn("m", F.transform("s", lambda x: F.octet_length(x).cast("long")))
    # (blocks, end of the last separator) so far
    step = "(a, i) -> struct(concat(a.o, array(a.at)) AS o, a.at + n[i] + coalesce(get(m, i), 0L) AS at)"
    offsets = F.expr(f"aggregate(sequence(0, size(n) - 1), struct(cast(array() AS array<bigint>) AS o, 0L AS at), {step}).o")
    rows = sizes.select("doc_id", F.posexplode(F.arrays_zip(F.col("b").alias("block"), offsets.alias("byte_start"), F.col("n").alias("size"))).alias("block_no", "x"))
    return rows.select("doc_id", "block_no", "x.block", "x.byte_start", (F.col("x.byte_start") + F.col("x.size")).alias("byte_end"))


#: Tokens that a kernel holds at a time, and bytes of texts in a batch.
HELD_TOKENS, BATCH_BYTES = 8192, "8m"


def shingle_parts(text: str | None, size: int, least_chars: int):
    """(digests, byte starts, byte ends) of the shingles of a text, those of `HELD_TOKENS` tokens at a time."""
    text, words, starts, ends, char, byte = text or "", [], [], [], 0, 0
    plain, found = text.isascii(), re.finditer(r"[^\W_]+", text)
    while some := list(itertools.islice(found, HELD_TOKENS)):
        done = max(0, len(words) - size + 1)
        words, starts, ends = words[done:], starts[done:], ends[done:]
        if plain:  # bytes are characters, and lower case is all that folding does
            words += [m[0].lower() for m in some]
            starts += [m.start() for m in some]
            ends += [m.end() for m in some]
        else:
            for m in some:
                start, end = m.span()
                word = m[0]
                byte += len(text[char:start].encode())
                starts.append(byte)
                byte += len(word.encode())
                ends.append(byte)
                words.append(word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).casefold())
                char = end
        joined = " ".join(words).encode()
        chars = [0, *itertools.accumulate(map(len, words))]
        at = [k + c for k, c in enumerate(chars)] if len(joined) == chars[-1] + len(words) - 1 else [0, *itertools.accumulate(len(w.encode()) + 1 for w in words)]
        own = [k for k in range(len(words) - size + 1) if chars[k + size] - chars[k] >= least_chars]
        if own:
            yield [hashlib.sha256(joined[at[k] : at[k + size] - 1]).hexdigest() for k in own], [starts[k] for k in own], [ends[k + size - 1] for k in own]


def shingle_spans(documents: DataFrame, size: int = REPETITION.shingle_tokens, least_chars: int = REPETITION.shingle_chars) -> DataFrame:
    """doc_id, digest, byte_start, byte_end of every run of `size` tokens (case-folded) with `least_chars` characters in all."""

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "digest", "byte_start", "byte_end"])

    def kernel(batches):
        held = [], [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for part in shingle_parts(text.as_py(), size, least_chars):
                    for column, values in zip(held, ([doc.as_py()] * len(part[0]), *part), strict=True):
                        column += values
                    if len(held[0]) >= HELD_TOKENS:
                        yield batch_of(held)
                        held = [], [], [], []
        yield batch_of(held)

    # texts may be long: a batch is bounded by bytes, not by rows alone
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, digest string, byte_start long, byte_end long")


def shingles(rows: DataFrame, key: str, size: int = REPETITION.shingle_tokens, least_chars: int = REPETITION.shingle_chars) -> DataFrame:
    """key, shingle: distinct runs of tokens, joined by a space."""
    own = rows.select(key, tokens(F.col("text")).alias("t"))
    n = F.size("t") - (size - 1)
    runs = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("t", i, size), " "))
    return own.select(key, F.explode(F.array_distinct(runs)).alias("shingle")).where(F.length("shingle") >= least_chars)


def sticky(rows: DataFrame, value: str, partition: str, order: str, name: str) -> DataFrame:
    """Carries the last non-null value forward within a partition."""
    window = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))
