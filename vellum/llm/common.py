"""What the operators share: tables, byte texts, the shared folder and packed Arrow columns."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a kernel holds in working arrays at a time.
BLOCK_BYTES = 2 << 20


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Texts may be long: what one Arrow batch holds is bounded by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that executors and the driver share (spark.checkpoint.dir).

    A session on local threads that names none, as in tests, has the driver's temporary folder; on a cluster a
    session without a shared folder is an error.
    """
    bound_batches(spark)
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    held = context._jsc.sc().getCheckpointDir()
    if top is None and held.isDefined():
        top = held.get()
    if top is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    if top is None:
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="vellum-")
    if not held.isDefined():
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, folder: str = "", *names: str) -> None:
    """Let go of what is no longer read: written tables by name, and shuffle files of finished frames."""
    import gc

    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def free_name(columns, name: str) -> str:
    """The name, with as many underscores before it as none of the columns bears (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(column):
    """A-Z to a-z, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, n + 1 offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[ends[0] : ends[-1]]
    return raw, (ends - ends[0]).astype(np.int64)


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a row over the limit stands alone and stays whole."""
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def input_bytes(df: DataFrame) -> int:
    """The planner's size of a scan, from file sizes, or the texts' own size where it knows none.

    Decides numbers of shards only.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _powers[int(base)] = held = np.multiply.accumulate(held)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RangeHash:
    """64-bit hashes of any short ranges of a block of bytes, from one prefix sum.

    A polynomial modulo 2 ** 64: unlike ranges of about a thousand bytes can be made to collide, so this is for
    grams and segments of at most some hundred bytes; words go through `word_hashes`.
    """

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(raw) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def every(self, width: int) -> np.ndarray:
        """Hashes of the range of `width` bytes at each place that has one."""
        out = np.empty(len(self.sums) - width, np.uint64)
        for a in range(0, len(out), 1 << 16):  # stays in the processor's cache
            b = min(a + (1 << 16), len(out))
            out[a:b] = mix((self.sums[a + width : b + width] - self.sums[a:b]) * self.inverse[a:b])
        return out


#: Words of more bytes are hashed by a cryptographic function, one by one.
LONG_WORD = 1024


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many words: their length, then eight bytes at a time, mixed in order."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(8, np.uint8))), 8)
    live, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(live):
        chunk = np.ascontiguousarray(eights[starts[live] + at]).view(np.uint64).ravel()
        left = np.minimum(sizes[live] - at, 8).astype(np.uint64)
        chunk &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        out[live] = mix((out[live] ^ chunk) * _BASE + left)
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word of a block of texts laid end to end."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[raw]
    borders = np.zeros(n + 1, bool)
    borders[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | borders[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | borders[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
