"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Anchors. A text's 20-byte grams are hashed; the least hash of each run of 31 grams (one 50-byte string) marks
an anchor. Equal strings have equal anchors at equal places, so comparing strings under one anchor is exact,
and only every sixteenth byte or so is an anchor.

1. Anchor hashes travel as sorted delta blobs to wide shards of the hash range; a wide shard keeps those of two
   or more documents as an Elias-Fano file in the shared folder.
2. Texts are read again. For every anchor that repeats, the segment of all strings it stands for (at most 80
   bytes) goes to the shard. Equal segments within a task are settled there: all but those of the least
   document are covered, and only the least goes on, so a passage in any share of all documents costs a task
   one record.
3. A shard settles equal segments of all tasks alike. Anchors with different segments left are compared string
   by string in a logarithmic index family: batches get suffix arrays (sorted strings with their least
   document), equal-sized levels merge geometrically, and every batch is scanned against the levels.
4. Covered ranges go to wide shards of documents, are merged, and joined to the texts.

A task holds what it sends until it is worth a blob for each shard, and a task takes the shards of a wide one: blobs
for each pair of a block of text and a shard would grow with the square of the input.

Null and empty texts have no bytes. Rows with one id do not cover each other; they are told apart by a hash of
the text, identical rows being one document. Null ids come last (they cover nothing but other texts' copies in
no document: a null id is not smaller than any). Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import RangeHash, blocks, byte_texts, input_bytes, mix, release, settle, shared_folder, table
from vellum.llm.eliasfano import EliasFano, build, map_file, pack, write_file
from vellum.llm.ngram import MOST_PARTS, _blobs, _by_shard, _runs, by_shard, dealt, merged

SPAN, GRAM = 50, 20
RUN = SPAN - GRAM + 1
#: Bytes of segments that are compared at a time.
PORTION = 3 << 20
#: Bytes of segments and number of covered ranges that a task holds before it sends them.
HELD_BYTES, HELD_SPANS = 8 << 20, 250_000
#: A wide shard is as large as so many shards, as a power of two.
WIDE = 2
#: Bytes of the longest segment: the strings whose leftmost least gram is at one place.
WIDEST = 2 * SPAN - GRAM
#: Records that make a batch of an index family.
BATCH = 16384
LAST = 9223372036854775807
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at every byte, places of the anchors) of a block of texts laid end to end.

    Grams that cross a text's end have the largest hash, so that no run of them is taken for a string.
    """
    n = len(raw)
    if n < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.full(n, _FAR, np.uint64)
    grams[: n - GRAM + 1] = RangeHash(raw).every(GRAM) >> np.uint64(1)
    # the last GRAM - 1 bytes of each text start no gram
    for k in range(1, GRAM):
        ends = offsets[1:] - k
        grams[ends[ends >= offsets[:-1]]] = _FAR
    least = _sliding(grams, RUN, np.minimum)
    # runs that reach over a text's end stand for no string
    steps = np.zeros(len(least) + 1, np.int32)
    first = np.maximum(offsets[1:-1] - SPAN + 1, 0)
    np.add.at(steps, np.minimum(first, len(least)), 1)
    np.add.at(steps, np.minimum(offsets[1:-1], len(least)), -1)
    least = np.where(np.cumsum(steps[:-1]) > 0, np.uint64(0), least)
    padded = np.concatenate((np.zeros(RUN - 1, np.uint64), least, np.zeros(RUN - 1, np.uint64)))
    chosen = _sliding(padded, RUN, np.maximum)
    return grams, np.flatnonzero((chosen == grams[: len(chosen)]) & (grams[: len(chosen)] != _FAR))


def keys_of(grams: np.ndarray, places: np.ndarray) -> np.ndarray:
    """63 bits for each anchor, mixed anew: least hashes are small ones, and shards of them would be uneven."""
    return mix(grams[places]) >> np.uint64(1)


def strings_of(grams: np.ndarray, places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the strings whose leftmost least gram is at each place; begin, end: of its text."""
    own = grams[places]
    left, right = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    go_left, go_right = np.ones(len(places), bool), np.ones(len(places), bool)
    for d in range(1, RUN):
        go_left &= (places - d >= begin) & (grams[np.maximum(places - d, 0)] > own)
        left += go_left
        go_right &= (places + d < end) & (grams[np.minimum(places + d, len(grams) - 1)] >= own)
        right += go_right
    return places - left, np.minimum(np.minimum(places, places + right - RUN + 1), end - SPAN)


class SuffixFamily:
    """Sorted strings, each with the occurrences of its least document, in levels of doubling size.

    A level is a suffix array of its batches: strings in order and, for each, a document and a row that names the
    occurrence. No string is in a level under two documents, nor in two levels under different ones.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def insert(self, strings: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scan a batch against the levels, put it in, and return the rows that a smaller document covers now.

        Every occurrence but those of a string's least document is returned once, in whatever order they come.
        """
        order = np.argsort(docs, kind="stable")
        order = order[np.argsort(strings[order], kind="stable")]
        strings, docs, rows = strings[order], docs[order], rows[order]
        if not len(strings):
            return rows
        fresh = np.concatenate(([True], strings[1:] != strings[:-1]))
        first = np.flatnonzero(fresh)
        gone = docs > docs[first][np.cumsum(fresh) - 1]
        covered = [rows[gone]]
        strings, docs, rows = strings[~gone], docs[~gone], rows[~gone]
        for k, (known, owners, places) in enumerate(self.levels):
            low = np.searchsorted(known, strings)
            at = np.minimum(low, len(known) - 1)
            met = known[at] == strings if len(known) else np.zeros(len(strings), bool)
            behind = met & (docs > (owners[at] if len(known) else 0))
            ahead = np.flatnonzero(met & ~behind)
            ahead = ahead[docs[ahead] < owners[at[ahead]]] if len(ahead) else ahead
            if len(ahead):  # the level's occurrences of these strings are covered by the batch
                high = np.searchsorted(known, strings[ahead], side="right")
                steps = np.zeros(len(known) + 1, np.int64)
                np.add.at(steps, low[ahead], 1)
                np.add.at(steps, high, -1)
                lost = np.cumsum(steps[:-1]) > 0
                covered.append(places[lost])
                self.levels[k] = (known[~lost], owners[~lost], places[~lost])
            covered.append(rows[behind])
            strings, docs, rows = strings[~behind], docs[~behind], rows[~behind]
        self.levels.append((strings, docs, rows))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (s, d, r), (t, e, q) = self.levels.pop(), self.levels.pop()
            at = np.searchsorted(s, t)  # merge of two sorted levels
            self.levels.append((np.insert(s, at, t), np.insert(d, at, e), np.insert(r, at, q)))
        return np.concatenate(covered)

    def rows(self) -> np.ndarray:
        """The rows that nothing covers."""
        return np.concatenate([r for _, _, r in self.levels]) if self.levels else np.zeros(0, np.int64)


def _segments(raw: np.ndarray, first: np.ndarray, sizes: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Segments as strings of one width: the anchor's place, the size, and the bytes themselves."""
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(WIDEST, np.uint8))), WIDEST)
    out = np.empty((len(first), WIDEST + 2), np.uint8)
    # no zero byte ends a record's head; sizes tell zero bytes of a segment from padding
    out[:, 0], out[:, 1], out[:, 2:] = delta + 1, sizes, wide[first]
    out[:, 2:][np.arange(WIDEST) >= sizes[:, None]] = 0
    return out


def _pack_columns(*columns: np.ndarray) -> bytes:
    import zstandard

    body = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(1).compress(len(columns[0]).to_bytes(8, "little") + body)


def _unpack_columns(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    body = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(blob), np.uint8)
    n, at, out = int(body[:8].view(np.int64)[0]), 8, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(body[at : at + size].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return [*out, body[at:]]


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, end to end."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(sizes), 4096):  # the places of a few ranges at a time
        b = min(a + 4096, len(sizes))
        low, high = int(ends[a] - sizes[a]), int(ends[b - 1])
        out[low:high] = raw[np.repeat(starts[a:b] - ends[a:b] + sizes[a:b], sizes[a:b]) + np.arange(low, high)]
    return out


def _prints(records: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the anchor's gram in each segment (a row of bytes), some of them at a time."""
    out = np.empty(len(begin), np.uint64)
    for a in range(0, len(begin), 8192):
        some = begin[a : a + 8192]
        at = np.arange(len(some)) * records.shape[1] + some
        out[a : a + 8192] = RangeHash(records[a : a + 8192].ravel())(at, at + GRAM)
    return out


def _settled(prints: np.ndarray, records: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which segments have an equal one, byte by byte, in a smaller document. prints only bring equal ones together."""
    order = np.lexsort((docs, prints))
    same = (prints[order][1:] == prints[order][:-1]) & (records[order[1:]] == records[order[:-1]]).all(1)
    fresh = np.concatenate(([True], ~same))
    least = docs[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    covered = np.zeros(len(docs), bool)
    covered[order] = docs[order] > least
    return covered


def _merge_spans(docs, ties, starts, ends):
    """Ranges of each document, overlapping and touching ones joined."""
    order = np.lexsort((starts, ties, docs))
    docs, ties, starts, ends = (x[order] for x in (docs, ties, starts, ends))
    if not len(docs):
        return docs, ties, starts, ends
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1])))
    group = np.cumsum(new)
    reach = np.maximum.accumulate(ends + group * (1 << 40))  # the furthest end so far, within a document
    gap = new.copy()
    gap[1:] |= starts[1:] + group[1:] * (1 << 40) > reach[:-1]
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], ties[first], starts[first], reach[last] - group[last] * (1 << 40)


def _span_blobs(kind: int, shards: int, docs, ties, starts, ends):
    """Rows (shard of the document, kind, blob) of covered ranges."""
    docs, ties, starts, ends = _merge_spans(docs, ties, starts, ends)
    own = ((docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards
    order = np.argsort(own, kind="stable")
    runs = list(_runs(own[order]))
    pick = [order[a:b] for _, a, b in runs]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _, _ in runs], pa.int32()), pa.array([kind] * len(runs), pa.int32()), pa.array([_pack_columns(docs[p], ties[p], starts[p], ends[p]) for p in pick], pa.binary())],
        ["shard", "kind", "blob"],
    )


def _gathered(found, shards: int):
    """Covered ranges (docs, ties, starts, ends) as they are found, in as few batches of blobs as memory allows."""
    parts, held = [], 0
    for spans in found:
        parts.append(spans)
        held += len(spans[0])
        if held >= HELD_SPANS:
            yield _span_blobs(1, shards, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts, held = [], 0
    if held:
        yield _span_blobs(1, shards, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _segment_blobs(parts: list[tuple]) -> pa.RecordBatch:
    """Rows (shard, kind 0, blob) of segments: parts of (shards, docs, ties, places in the text and of the anchor, sizes, bytes end to end)."""
    shard, docs, ties, at, delta, sizes, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(shard, kind="stable")
    shards, blobs = [], []
    for number, x, y in _runs(shard[order]):
        p = order[x:y]
        head = _pack_columns(docs[p], ties[p], at[p], delta[p].astype(np.uint8), sizes[p].astype(np.uint8))
        shards.append(number)
        blobs.append(len(head).to_bytes(8, "little") + head + _pack_columns(_gather(raw, starts[p], sizes[p])))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([0] * len(shards), pa.int32()), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])


_ROW = "shard int, kind int, blob binary"


def covered_spans(texts: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """doc, tie, spans (start and end of each covered range as 64-bit integers) of each document with any."""
    # a shard is for some 4 MB of text, whatever the size of the input; a task takes those of a wide one after the other
    bits = max(4 + WIDE, (input_bytes(texts) // (4 << 20)).bit_length()) if shards is None else shards.bit_length() - 1
    wide = max(0, bits - WIDE)
    n_shards, n_wide = 1 << bits, 1 << wide

    def collect_anchors(batches):
        parts, held = [], 0
        for batch in batches:
            raw, offsets = byte_texts(batch.column(2))
            for a, b in blocks(np.diff(offsets)):
                cut = offsets[a : b + 1] - offsets[a]
                grams, places = anchors(raw[offsets[a] : offsets[b]], cut)
                keys, owner = keys_of(grams, places), np.searchsorted(cut, places, side="right")
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                once = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, bool)
                own, n = np.unique(keys[once], return_counts=True)
                parts.append((own, np.minimum(n, 2).astype(np.int64)))
                held += len(own)
                if held > 1_500_000:
                    keys, n = merged(parts)
                    yield _blobs((keys >> np.uint64(63 - wide)).astype(np.int64), keys, np.minimum(n, 2))
                    parts, held = [], 0
        if parts:
            keys, n = merged(parts)
            yield _blobs((keys >> np.uint64(63 - wide)).astype(np.int64), keys, np.minimum(n, 2))

    def write_repeated(shard, keys, counts):
        keys = keys[counts > 1] & np.uint64((1 << (63 - wide)) - 1)
        write_file(folder, f"grams-{shard}", pack(build(keys, 1 << (63 - wide))))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64())], ["shard", "n"])

    known = settle(_by_shard(texts.mapInArrow(collect_anchors, "shard int, blob binary"), n_wide, write_repeated, "shard int, n long"), folder, "repeated")
    held_shards = {r.shard for r in known.where("n > 0").collect()}  # shard numbers
    release(texts.sparkSession)

    def collect_segments(batches):
        parts, spans, held, n_spans = [], [], 0, 0
        for own, covered in block_segments(batches):
            parts.append(own)
            spans.append(covered)
            held, n_spans = held + len(own[-1]), n_spans + len(covered[0])
            if held >= HELD_BYTES or n_spans >= HELD_SPANS:
                yield _segment_blobs(parts)
                yield from _gathered(spans, n_wide)
                parts, spans, held, n_spans = [], [], 0, 0
        if parts:
            yield _segment_blobs(parts)
            yield from _gathered(spans, n_wide)

    def block_segments(batches):
        """(segments that go on, ranges that are settled) of each block of texts."""
        files: dict[int, EliasFano] = {}
        for batch in batches:
            raw_all, offsets = byte_texts(batch.column(2))
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b in blocks(np.diff(offsets)):
                cut, raw = offsets[a : b + 1] - offsets[a], raw_all[offsets[a] : offsets[b]]
                grams, places = anchors(raw, cut)
                keys = keys_of(grams, places)
                order = np.argsort(keys, kind="stable")
                places, keys = places[order], keys[order]
                hit = np.zeros(len(keys), bool)
                for shard, x, y in _runs((keys >> np.uint64(63 - wide)).astype(np.int64)):
                    if shard in held_shards:
                        if shard not in files:
                            files[shard] = EliasFano(map_file(folder, f"grams-{shard}"))
                        hit[x:y] = files[shard].find(keys[x:y] & np.uint64((1 << (63 - wide)) - 1)) >= 0
                places, keys = places[hit], keys[hit]
                owner = np.searchsorted(cut, places, side="right") - 1
                first, last = strings_of(grams, places, cut[owner], cut[owner + 1])
                good = first <= last
                places, keys, owner, first, last = (x[good] for x in (places, keys, owner, first, last))
                if not len(places):
                    continue
                docs, tie = ids[a:b][owner], ties[a:b][owner]
                prints = RangeHash(raw)(first, last + SPAN) + (places - first).astype(np.uint64)
                covered = _settled(prints, _segments(raw, first, last - first + SPAN, places - first), docs)
                at, sizes, on = first - cut[owner], last - first + SPAN, ~covered
                shard_of = (keys[on] >> np.uint64(63 - bits)).astype(np.int32)
                own = (shard_of, docs[on], tie[on], at[on], (places - first)[on].astype(np.uint8), sizes[on], _gather(raw, first[on], sizes[on]))
                yield own, _merge_spans(docs[covered], tie[covered], at[covered], (at + sizes)[covered])

    def compare(blobs):
        """Covered ranges from all segments of a shard: batches of segments go into one family, then strings into another."""
        family, parts, held = SuffixFamily(), [], 0
        docs, ties, at, delta, sizes = [], [], [], [], []

        def spans(found):
            d, t, a, n = (np.concatenate(x) for x in (docs, ties, at, sizes))
            return d[found], t[found], a[found], a[found] + n[found]

        for k, blob in enumerate(blobs):
            size = int.from_bytes(blob[:8], "little")
            for column, values in zip((docs, ties, at, delta, sizes), _unpack_columns(blob[8 : 8 + size], np.int64, np.int64, np.int64, np.uint8, np.uint8), strict=False):
                column.append(values.astype(np.int64))
            raw = _unpack_columns(blob[8 + size :], np.uint8)[0]
            first = np.concatenate(([0], np.cumsum(sizes[-1])[:-1]))
            parts.append(_segments(raw, first, sizes[-1], delta[-1]))
            if (waiting := sum(map(len, parts))) >= BATCH or k == len(blobs) - 1:
                keys = np.ascontiguousarray(np.concatenate(parts)).view(f"S{WIDEST + 2}").ravel()
                covered = family.insert(keys, np.concatenate(docs)[held : held + waiting], np.arange(held, held + waiting))
                parts, held = [], held + waiting
                if len(covered):
                    yield spans(covered)
        if not held:
            return
        # what is left is one kind of segment for each record; kinds under one anchor are compared string by string
        docs, ties, at, delta, sizes = ([np.concatenate(x)] for x in (docs, ties, at, delta, sizes))
        strings = [k for k, _, _ in family.levels]
        rows = family.rows()
        records = np.ascontiguousarray(np.concatenate(strings).view(np.uint8).reshape(-1, WIDEST + 2)[:, 2:])
        del family, strings
        prints = _prints(records, delta[0][rows])
        order = np.lexsort((docs[0][rows], prints))
        new = np.concatenate(([True], prints[order][1:] != prints[order][:-1]))
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        order, group = order[several], (np.cumsum(new) - 1)[several]
        # strings meet under one anchor only: whole anchors until a portion is full, each portion with a family of its own
        weight = np.cumsum(sizes[0][rows[order]])
        cut = [0]
        for end in np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1 if len(order) else []:
            if weight[end - 1] - (weight[cut[-1] - 1] if cut[-1] else 0) >= PORTION or end == len(order):
                cut.append(int(end))
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            own, family = order[x:y], SuffixFamily()
            n = sizes[0][rows[own]] - SPAN + 1
            for u, v in blocks(n, BATCH):
                number = np.repeat(np.arange(u, v), n[u:v])
                shift = np.arange(len(number)) - np.repeat(np.cumsum(n[u:v]) - n[u:v], n[u:v])
                view = np.lib.stride_tricks.sliding_window_view(records.ravel(), SPAN)[own[number] * WIDEST + shift]
                # a string is told from a shorter one with zero bytes at its end by its width, which all share
                keys = np.ascontiguousarray(view).view(f"S{SPAN}").ravel()
                row = rows[own[number]]
                covered = family.insert(keys, docs[0][row], row * 64 + shift)
                if len(covered):
                    row, shift = covered >> 6, covered & 63
                    start = at[0][row] + shift
                    yield docs[0][row], ties[0][row], start, start + SPAN

    def settle_shards(batches):
        passed = []

        def items():
            for batch in batches:
                for shard, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if kind:
                        passed.append((shard, blob))
                    else:
                        yield shard, blob

        def through():
            rows, passed[:] = list(passed), []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "kind", "blob"])

        def found():
            for _, blobs in by_shard(items(), in_order):
                yield from compare(blobs)

        for batch in _gathered(found(), n_wide):
            yield batch
            yield through()
        yield through()

    segments = texts.mapInArrow(collect_segments, _ROW)
    # ranges that a task has settled go round the comparison; only their shard of documents matters
    parted, in_order = dealt(segments, n_shards, n_wide)
    spans = parted.mapInArrow(settle_shards, _ROW)

    def by_document(batches):
        blobs = ((s, x) for batch in batches for s, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        for _, own in by_shard(blobs, n_wide > MOST_PARTS):
            held = []
            while own:
                held.append(_unpack_columns(own.pop(), *[np.int64] * 4)[:4])
                if len(held) > 64:
                    held = [_merge_spans(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield from ranges(held)

    def ranges(held):
        if held:
            docs, ties, starts, ends = _merge_spans(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1]), [True]))) if len(docs) else np.zeros(1, np.int64)
            both = np.column_stack((starts, ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[cut[:-1]]), pa.array(ties[cut[:-1]]), pa.array([both[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc", "tie", "spans"]
            )

    merged_ = dealt(spans, n_wide)[0].mapInArrow(by_document, "doc long, tie long, spans binary")
    out = settle(merged_, folder, "spans")
    release(texts.sparkSession)
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, doc, tie and text (binary) of every row; tie is 0 unless some id comes more than once."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    repeated = documents.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count()
    tie = F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated else F.lit(0)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), tie.cast("long").alias("tie"), F.col("text").cast("binary").alias("text"))


def remove_spans(documents: DataFrame, digests: bool = True, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or kept, the bytes) of every row."""
    folder = folder or shared_folder(documents.sparkSession)
    rows = _keyed(documents)
    spans = covered_spans(rows.drop("doc_id"), folder, shards)

    def kernel(batches):
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                size, removed, n = len(data), 0, 0
                if own.is_valid:
                    cuts = np.frombuffer(own.as_buffer(), np.int64).reshape(-1, 2)
                    removed, n = int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts)
                    edges = [0, *cuts.ravel().tolist(), size]
                    data = b"".join([data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)])
                rows.append((size, removed, n, hashlib.sha256(data).hexdigest() if digests else data))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(columns[k], pa.int64()) for k in range(3)), pa.array(columns[3], pa.string() if digests else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digests else "kept"
    joined = rows.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(kernel, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests else 'binary'}")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents."""
    return remove_spans(table(spark, sf_dir, "documents"))
