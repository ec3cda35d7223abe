"""LM scoring: an interpolated trigram model in an Elias-Fano trie, built on the executors and memory-mapped.

Tokens are words (A-Z lower-cased) by a 64-bit fingerprint, and one end token for each text; the first word of
a text follows the end token. All training tokens, pairs and triples are counted exactly and kept. Counts travel
as sorted, delta-coded blobs, one for each shard of the fingerprint range and task, so a shuffle moves a few
rows and few bytes. Texts are tokenised once more for their word ids, which the later passes read.

Level 1 (a file for each shard): the sorted fingerprints as an Elias-Fano sequence, the exact count of each word
and its quantised probability. Level 2: for each word of the shard a monotone pointer to its successors; their
ids as an Elias-Fano sequence, searched within the range of the context; quantised discounted probabilities,
and for each word the quantised mass that it leaves to its successors' own frequency. Level 3: the same for each
pair of level 2; a successor's id is relative to the context, its rank among the successors of the pair's last
word, so that ids are small. Quantisation only ever rounds down, so no context gives more than one in all:

    P(w | g h) = q(ghw) + left(gh) * P(w | h),   q(ghw) <= (c(ghw) - D) / c(gh)
    P(w | h)   = q(hw)  + left(h)  * P(w),       q(hw)  <= (c(hw) - D) / c(h)
    P(w)       <= (c(w) + 1) / (N + V + 1)

The first word of a text has no pair before it and takes P(w | end).

A null text is an empty one (its end token counts). A null id is in training. Repeated rows count as often as
they come. With no training text every token has P = 1 (N = V = 0). Fingerprints of different words collide
with probability V ** 2 / 2 ** 65. Very long texts are whole; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import LOWERED, blocks, byte_texts, input_bytes, release, settle, shared_folder, table, word_hashes, word_ranges
from vellum.llm.eliasfano import EliasFano, build, map_file, pack, write_file

END = np.uint64(0x5BD1E995A5A5F00D)
DISCOUNT = 0.75
STEPS = 32  # quantisation steps of a power of ten
#: Partitions of a shuffle; more shards than these are taken one after the other in a task.
MOST_PARTS = 1 << 15
RANK_BITS = 36  # of an id (level 2) or a rank among successors (level 3) below a context's place in its shard
#: Pointers of so many contexts are kept decoded by a task.
DECODED = 4_000_000
HELD = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2, false)"


def token_stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text number) of every token: the words of a text, then its end."""
    starts, ends, owner = word_ranges(raw, offsets)
    n = len(offsets) - 1
    words = word_hashes(LOWERED[raw], starts, ends)
    per = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + owner] = words
    return out, np.repeat(np.arange(n), per + 1)


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as bytes: differences, byte planes, then a fast compressor."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    body = np.ascontiguousarray(gaps).tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(body)


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(blob[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=12 * n + 1), np.uint8)
    keys = np.ascontiguousarray(body[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(keys, dtype=np.uint64), np.ascontiguousarray(body[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of keys with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row (shard, blob) for each shard that has keys; keys are sorted by shard, then by themselves."""
    ids, first = np.unique(shard, return_index=True)
    last = np.append(first, len(keys))[1:]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array([squeeze(keys[a:b], counts[a:b]) for a, b in zip(first, last, strict=True)], pa.binary())], ["shard", "blob"])


def quantised(p: np.ndarray) -> np.ndarray:
    """Steps of a probability, rounded down; 65,535 steps are 2,047 powers of ten."""
    return np.ceil(-np.log10(p) * STEPS - 1e-9).astype(np.uint16)


def value_of(steps: np.ndarray) -> np.ndarray:
    return 10.0 ** (-steps.astype(float) / STEPS)


class Model:
    """The trie as a task sees it: files are mapped when a shard is first asked for."""

    def __init__(self, folder: str, bits: int, bases: np.ndarray, total: int, types: int):
        self.folder, self.bits, self.bases, self.total, self.types = folder, bits, bases, total, types
        self.files: dict[tuple[str, int], dict] = {}
        self.decoded: dict[int, np.ndarray] = {}
        self.unknown = int(quantised(np.array([1 / (total + types + 1)]))[0]) if total else 0

    def level(self, name: str, shard: int) -> dict:
        if (name, shard) not in self.files:
            parts = map_file(self.folder, f"{name}-{shard}")
            parts["ids"] = EliasFano(parts)
            if "pointer_shape" in parts:
                parts["pointers"] = EliasFano({k[8:]: v for k, v in parts.items() if k.startswith("pointer_")})
            self.files[name, shard] = parts
        return self.files[name, shard]

    def words(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted fingerprints."""
        ids, counts = np.full(len(prints), -1, np.int64), np.zeros(len(prints), np.int64)
        own = (prints >> np.uint64(64 - self.bits)).astype(np.int64)
        for shard, a, b in _runs(own):
            if self.bases[shard + 1] == self.bases[shard]:
                continue
            held = self.level("words", shard)
            at = held["ids"].find(prints[a:b] & np.uint64((1 << (64 - self.bits)) - 1))
            has = np.flatnonzero(at >= 0)
            c = held["small"][at[has]].astype(np.int64)
            over = np.flatnonzero(c == 0)
            if len(over):
                c[over] = held["big"][np.searchsorted(held["big_at"], at[has][over])]
            ids[a + has], counts[a + has] = at[has] + self.bases[shard], c
        return ids, counts

    def _by_shard(self, context: np.ndarray):
        """(shard, places) of the known contexts, shard by shard."""
        known = np.flatnonzero(context >= 0)
        own = (np.searchsorted(self.bases, context[known], side="right") - 1).astype(np.uint16 if len(self.bases) < 65_536 else np.int64)
        order = np.argsort(own, kind="stable")
        for shard, a, b in _runs(own[order]):
            yield shard, known[order[a:b]]

    def plain(self, word: np.ndarray) -> np.ndarray:
        """P(w) of ids; -1 is a word not seen."""
        steps = np.full(len(word), self.unknown, np.uint16)
        for shard, at in self._by_shard(word):
            steps[at] = self.level("words", shard)["steps"][word[at] - self.bases[shard]]
        return value_of(steps)

    def _pointers(self, shard: int) -> np.ndarray:
        if shard not in self.decoded:
            if sum(map(len, self.decoded.values())) > DECODED:
                self.decoded.clear()
            held = self.level("pairs", shard)["pointers"]
            self.decoded[shard] = held.get(np.arange(held.n)).astype(np.int64)
        return self.decoded[shard]

    def pairs(self, context: np.ndarray, word: np.ndarray, shares: bool = True):
        """(place of the pair in its shard or -1, rank among the context's successors, q, left) of ids; -1 is unknown."""
        place, rank = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        share, left = np.zeros(len(context)), np.ones(len(context))
        for shard, at in self._by_shard(context):
            held, pointers = self.level("pairs", shard), self._pointers(shard)
            own = context[at] - self.bases[shard]
            low, high = pointers[own], pointers[own + 1]
            if shares:
                left[at] = value_of(held["left"][own])
            ask = np.flatnonzero((word[at] >= 0) & (low < high))
            found = held["ids"].find_within(own[ask].astype(np.uint64) * np.uint64(self.bases[-1]) + word[at[ask]].astype(np.uint64), low[ask], high[ask])
            hit = np.flatnonzero(found >= 0)
            to = at[ask[hit]]
            place[to], rank[to] = found[hit], found[hit] - low[ask[hit]]
            if shares:
                share[to] = value_of(held["quanta"][found[hit]])
        return place, rank, share, left

    def triples(self, first: np.ndarray, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(q, left) of a pair (its first word and its place) and the rank of the next word; -1 is unknown."""
        share, left = np.zeros(len(first)), np.ones(len(first))
        for shard, at in self._by_shard(np.where(place >= 0, first, -1)):
            held = self.level("triples", shard)
            own = place[at]
            left[at] = value_of(held["left"][own])
            ask = np.flatnonzero(rank[at] >= 0)
            own = own[ask]
            ranges = [x.astype(np.int64) for x in held["pointers"].get_both(own)]
            stride = held["stride"][0]
            fits = rank[at[ask]] < int(stride)
            found = held["ids"].find_within(own.astype(np.uint64) * stride + rank[at[ask]].astype(np.uint64), ranges[0], np.where(fits, ranges[1], 0))
            hit = np.flatnonzero(found >= 0)
            share[at[ask[hit]]] = value_of(held["quanta"][found[hit]])
        return share, left


def _runs(sorted_ids: np.ndarray):
    """(value, begin, end) of the runs of a sorted array."""
    if len(sorted_ids):
        cut = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(sorted_ids[a]), a, b


def _streams(batches, column: int, block_bytes: int = 4 << 20):
    """(rows from, rows to, batch, fingerprints, owners) of each block of texts."""
    for batch in batches:
        raw, offsets = byte_texts(batch.column(column))
        for a, b in blocks(np.diff(offsets), block_bytes):
            yield a, b, batch, *token_stream(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _lookup(model: Model, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, count) of each token of a block."""
    unique, place = np.unique(prints, return_inverse=True)
    ids, counts = model.words(unique)
    return ids[place], counts[place]


def dealt(rows: DataFrame, shards: int, parts: int = MOST_PARTS) -> tuple[DataFrame, bool]:
    """Rows by shard; whether they come in order. Only where a task has many shards are they sorted, to be taken one after the other."""
    if shards <= (parts := min(parts, MOST_PARTS)):
        return rows.repartition(shards, "shard"), False
    return rows.repartition(parts, "shard").sortWithinPartitions("shard"), True


def by_shard(items, in_order: bool):
    """(shard, values) from (shard, value) items: as soon as the next shard begins if they come in order, else at the end."""
    held: dict[int, list] = {}
    for shard, value in items:
        if in_order and held and shard not in held:
            yield from held.items()
            held = {}
        held.setdefault(shard, []).append(value)
    for shard in sorted(held):
        yield shard, held.pop(shard)


def _by_shard(rows: DataFrame, shards: int, build_shard, schema: str) -> DataFrame:
    """One call of build_shard(shard, keys, counts) for each shard, on all its blobs."""
    parted, in_order = dealt(rows, shards)

    def kernel(batches):
        blobs = ((s, x) for batch in batches for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for shard, own in by_shard(blobs, in_order):
            parts = []
            while own:
                parts.append(unsqueeze(own.pop()))
                if len(parts) > 24:  # bounds what waits to be merged
                    parts = [merged(parts)]
            yield build_shard(shard, *merged(parts))

    return parted.mapInArrow(kernel, schema)


def _counted(context_shard: np.ndarray, keys: np.ndarray, parts: dict[int, list]) -> int:
    """Put the distinct keys of a block and their counts to the parts of their shards; returns how many."""
    order = np.argsort(context_shard.astype(np.uint16) if not len(context_shard) or context_shard.max() < 65_536 else context_shard, kind="stable")
    n = 0
    for shard, a, b in _runs(context_shard[order]):
        own, counts = np.unique(keys[order[a:b]], return_counts=True)
        parts.setdefault(shard, []).append((own, counts.astype(np.int64)))
        n += len(own)
    return n


def _flushed(parts: dict[int, list]) -> pa.RecordBatch:
    shards = sorted(parts)
    held = [merged(parts[s]) for s in shards]
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([squeeze(*h) for h in held], pa.binary())], ["shard", "blob"])


def _successors(context: np.ndarray, ids: np.ndarray, stride: int, own_counts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """A level below len(own_counts) contexts: sorted (context, id) with counts, c(context) = own_counts."""
    n = len(own_counts)
    quanta = quantised((counts - DISCOUNT) / own_counts[context])
    left = np.maximum(1e-300, 1 - np.bincount(context, value_of(quanta), minlength=n))
    pointers = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n))))
    parts = build(context.astype(np.uint64) * np.uint64(stride) + ids, n * stride)
    return parts | {f"pointer_{k}": v for k, v in build(pointers, int(pointers[-1]) + 1).items()} | {"quanta": quanta, "left": quantised(left)}


def _id_blocks(batches, column: int, limit: int = 4 << 20):
    """(batch, rows from, rows to, ids, ends of rows) of blocks of id blobs; ids are -1 for unknown words."""
    for batch in batches:
        raw, offsets = byte_texts(batch.column(column))
        for a, b in blocks(np.diff(offsets), limit):
            ids = np.frombuffer(raw[offsets[a] : offsets[b]].tobytes(), "<u4").astype(np.int64) - 1
            yield batch, a, b, ids, (offsets[a + 1 : b + 1] - offsets[a]) // 4


def _before(ids: np.ndarray, end: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before each token, the end token before the first of a text; whether a token is the first of its text)."""
    first = np.zeros(len(ids), bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    before = np.roll(ids, 1)
    before[first] = end
    return before, first


def train(texts: DataFrame, folder: str, shards: int | None = None) -> Model | None:
    """Count the words of the texts (a column `text`) and write level 1 to the shared folder; None without a text."""
    bits = max(4, (input_bytes(texts) // (16 << 20)).bit_length()) if shards is None else shards.bit_length() - 1
    n_shards = 1 << bits
    source = texts.select(F.col("text").cast("binary").alias("text"))

    def count_words(batches):
        parts, held = [], 0
        for _, _, _, prints, _ in _streams(batches, 0):
            parts.append(tuple(x.astype(t) for x, t in zip(np.unique(prints, return_counts=True), (np.uint64, np.int64), strict=True)))
            held += len(parts[-1][0])
            if held > 1_500_000:
                keys, counts = merged(parts)
                parts, held = [(keys, counts)], len(keys)
                if held > 1_000_000:
                    yield _blobs((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)
                    parts, held = [], 0
        if parts:
            keys, counts = merged(parts)
            yield _blobs((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)

    counted = settle(_by_shard(source.mapInArrow(count_words, "shard int, blob binary"), n_shards, lambda shard, keys, counts: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([squeeze(keys, counts)], pa.binary())], ["shard", "types", "total", "blob"]), "shard int, types long, total long, blob binary"), folder, "counted")
    sizes = counted.select("shard", "types", "total").collect()  # a row for each shard
    types = np.zeros(n_shards, np.int64)
    for r in sizes:
        types[r.shard] = r.types
    bases = np.concatenate(([0], np.cumsum(types)))
    total = sum(r.total for r in sizes)
    if not total:
        return None
    model = (folder, bits, bases, total, int(bases[-1]))

    def write_words(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = unsqueeze(blob)
                known = build(keys & np.uint64((1 << (64 - bits)) - 1), 1 << (64 - bits))
                big_at = np.flatnonzero(counts > 255)
                known |= {"small": np.where(counts > 255, 0, counts).astype(np.uint8), "big_at": big_at.astype(np.int64), "big": counts[big_at], "steps": quantised((counts + 1) / (total + int(bases[-1]) + 1))}
                write_file(folder, f"words-{shard}", pack(known))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["shard"])

    settle(counted.select("shard", "blob").mapInArrow(write_words, "shard int"), folder, "level-1")
    release(texts.sparkSession, folder, "counted")
    return Model(*model)


def word_ids(documents: DataFrame, model: Model | None, folder: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and ids (id + 1 of every token, 0: not seen) of every row."""
    made = (model.folder, model.bits, model.bases, model.total, model.types) if model else None
    if model and model.types >= 1 << 32:
        raise ValueError("more than 2 ** 32 words")

    def kernel(batches):
        trie = Model(*made) if made else None
        total, types = (trie.total, trie.types) if trie else (0, 0)
        for a, b, batch, prints, owner in _streams(batches, 2):
            n = b - a
            per = np.bincount(owner, minlength=n)
            ids, counts = _lookup(trie, prints) if trie else (np.full(len(prints), -1), np.zeros(len(prints), np.int64))
            known = np.bincount(owner, counts > 0, minlength=n).astype(np.int64)
            base = np.bincount(owner, np.log10((counts + 1) / (total + types + 1)), minlength=n) if trie else np.zeros(n)
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((np.concatenate(([0], np.cumsum(per))) * 4).astype(np.int64)), pa.py_buffer((ids + 1).astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(per, pa.int64()), pa.array(known), pa.array(np.full(n, total), pa.int64()), pa.array(base), blobs.cast(pa.binary())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "ids"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(HELD).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return settle(rows.mapInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, ids binary"), folder, "ids")


def grow(ids: DataFrame, model: Model, folder: str) -> None:
    """Write levels 2 and 3 from the ids of the training texts (a column `ids`)."""
    made = (model.folder, model.bits, model.bases, model.total, model.types)
    bases, n_shards = model.bases, 1 << model.bits
    end = int(model.words(np.array([END]))[0][0])
    source = ids.select("ids")
    spark = ids.sparkSession

    def count_pairs(batches):
        parts, held = {}, 0
        for _, _, _, own, ends in _id_blocks(batches, 0):
            before, _ = _before(own, end, ends)
            shard = np.searchsorted(bases, before, side="right") - 1
            held += _counted(shard, ((before - bases[shard]).astype(np.uint64) << np.uint64(RANK_BITS)) | own.astype(np.uint64), parts)
            if held > 2_000_000:
                yield _flushed(parts)
                parts, held = {}, 0
        if parts:
            yield _flushed(parts)

    def write_pairs(shard, keys, counts):
        n = int(bases[shard + 1] - bases[shard])
        held = Model(*made).level("words", shard)
        own = held["small"].astype(np.float64)
        own[held["big_at"]] = held["big"]
        context, word = (keys >> np.uint64(RANK_BITS)).astype(np.int64), keys & np.uint64((1 << RANK_BITS) - 1)
        write_file(folder, f"pairs-{shard}", pack(_successors(context, word, int(bases[-1]), own[:n], counts)))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64())], ["shard", "kept"])

    # every word of a training text is followed by another or by the end, and the end by the first word of a text
    pairs = settle(_by_shard(source.mapInArrow(count_pairs, "shard int, blob binary"), n_shards, write_pairs, "shard int, kept long"), folder, "pairs")
    kept = {r.shard: r.kept for r in pairs.collect()}  # a row for each shard
    release(spark)

    def count_triples(batches):
        trie = Model(*made)
        parts, held = {}, 0
        for _, _, _, own, ends in _id_blocks(batches, 0):
            before, first = _before(own, end, ends)
            place, rank, _, _ = trie.pairs(before, own, False)
            inner = np.flatnonzero(~first)  # a triple is a pair and the word after it, within a text
            shard = np.searchsorted(bases, before[inner - 1], side="right") - 1
            held += _counted(shard, (place[inner - 1].astype(np.uint64) << np.uint64(64 - RANK_BITS)) | rank[inner].astype(np.uint64), parts)
            if held > 2_000_000:
                yield _flushed(parts)
                parts, held = {}, 0
        if parts:
            yield _flushed(parts)

    def write_triples(shard, keys, counts):
        context, rank = (keys >> np.uint64(64 - RANK_BITS)).astype(np.int64), keys & np.uint64((1 << (64 - RANK_BITS)) - 1)
        stride = int(rank.max()) + 1 if len(rank) else 1
        own = np.maximum(1, np.bincount(context, counts, minlength=kept[shard]))
        write_file(folder, f"triples-{shard}", pack(_successors(context, rank, stride, own, counts) | {"stride": np.array([stride], np.uint64)}))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64())], ["shard", "kept"])

    # a shard whose pairs all end their texts still needs its third level: an empty blob makes sure of it
    every = spark.createDataFrame([(s, squeeze(np.zeros(0, np.uint64), np.zeros(0, np.int64))) for s in kept], "shard int, blob binary")
    settle(_by_shard(source.mapInArrow(count_triples, "shard int, blob binary").union(every), n_shards, write_triples, "shard int, kept long"), folder, "triples")
    release(spark)


def score_ids(ids: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    made = (model.folder, model.bits, model.bases, model.total, model.types) if model else None
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]

    def kernel(batches):
        trie = Model(*made)
        end = int(trie.words(np.array([END]))[0][0])
        for batch, a, b, own, ends in _id_blocks(batches, 6):
            before, first = _before(own, end, ends)
            place, rank, share, left = trie.pairs(before, own)
            p = share + left * trie.plain(own)
            inner = np.flatnonzero(~first)
            share, left = trie.triples(before[inner - 1], place[inner - 1], rank[inner])
            p[inner] = share + left * p[inner]
            sums = np.add.reduceat(np.log10(p), np.concatenate(([0], ends[:-1])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(6)), pa.array(sums)], [*columns, "score"])

    if made is None:
        return ids.select(*columns, F.lit(0.0).alias("score"))
    return ids.select(*columns, "ids").mapInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(documents: DataFrame, train_texts: DataFrame, folder: str) -> DataFrame:
    """All documents scored by a model of other texts (a column `text`)."""
    model = train(train_texts, folder)
    if model is not None:
        grow(word_ids(train_texts.select(F.lit(None).cast("long").alias("doc_id"), "text"), model, f"{folder}/train"), model, folder)
    return score_ids(word_ids(documents, model, folder), model)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn from the documents not held out, score all."""
    documents, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    model = train(documents.where(f"NOT {HELD}"), folder)
    ids = word_ids(documents, model, folder)
    if model is not None:
        grow(ids.where("NOT held_out"), model, folder)
    return score_ids(ids, model)
