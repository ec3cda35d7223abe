"""Elias-Fano sequences over memory-mapped words, with vectorised access and search."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

import numpy as np

_BLOCK = 256
_SELECT = np.full((256, 8), 8, np.uint8)  # place of the k-th one of a byte
for _byte in range(256):
    for _k, _place in enumerate([i for i in range(8) if _byte >> i & 1]):
        _SELECT[_byte, _k] = _place


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The parts of a monotone sequence of integers below universe."""
    n = len(values)
    width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    highs = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = n + (max(0, universe - 1) >> width) + 2
    upper = np.zeros(-(-size // _BLOCK) * _BLOCK, bool)
    upper[highs] = True
    words = np.packbits(upper, bitorder="little").view(np.uint64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(1)))).astype(np.uint64)
    low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
    if width:
        rest = values & np.uint64((1 << width) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, rest << shift)
        over = shift + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
    return {"shape": np.array([n, width], np.uint64), "upper": words, "ones": ones, "low": low}


class EliasFano:
    """A monotone sequence: get(i) is its i-th value, find(v) the place of v."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in parts["shape"])
        self.upper, self.low = parts["upper"], parts["low"]
        self.ones = np.asarray(parts["ones"]).astype(np.int64)
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * _BLOCK - self.ones

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one or zero of the upper bits."""
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        left = k - directory[block]
        word = block * (_BLOCK // 64)
        bits = self.upper[word] if ones else ~self.upper[word]
        for _ in range(_BLOCK // 64 - 1):
            count = np.bitwise_count(bits).astype(np.int64)
            go = np.flatnonzero(left >= count)
            # once a word holds the place it is left alone
            left[go] -= count[go]
            word[go] += 1
            bits[go] = self.upper[word[go]] if ones else ~self.upper[word[go]]
        place = word * 64
        for half in (32, 16, 8):
            count = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            go = left >= count
            left -= count * go
            shift = go * half
            bits >>= shift.astype(np.uint64)
            place += shift
        return place + _SELECT[(bits & np.uint64(255)).astype(np.int64), left]

    def _run(self, place: np.ndarray, ones: bool) -> np.ndarray:
        """How many ones, or zeros, stand in a row from each place on; -1 where they reach the end of a word."""
        bits = self.upper[place >> 6]
        bits = (~bits if ones else bits) >> (place & 63).astype(np.uint64)
        low = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return np.where(bits == 0, -1, low)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def get_both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th value and the one after it."""
        place = self._select(i, True)
        gap = self._run(place + 1, False)
        far = np.flatnonzero(gap < 0)
        after = place + 1 + gap
        after[far] = self._select(i[far] + 1, True)
        width = np.uint64(self.width)
        return ((place - i).astype(np.uint64) << width) | self._lows(i), ((after - i - 1).astype(np.uint64) << width) | self._lows(i + 1)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) places of the values with these high bits."""
        # the bucket lies behind the zero that ends the one before it
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        size = self._run(start, True)
        far = np.flatnonzero(size < 0)
        size[far] = self._select(high[far], False) - start[far]
        return start - high, start - high + size

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1; by successor search among those with the same high bits."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        target = values & np.uint64((1 << self.width) - 1)
        first, end = self._bucket(high)
        lo, hi = first, end.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._lows(mid) < target[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        hit = lo < end
        hit[hit] = self._lows(lo[hit]) == target[hit]
        return np.where(hit, lo, -1)


    def find_within(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each value among the places [low, high), or -1: a successor search bounded by the range and the high bits."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        live = np.flatnonzero(low < high)
        if not self.n or not len(live):
            return out
        top, target = (values[live] >> np.uint64(self.width)).astype(np.int64), values[live] & np.uint64((1 << self.width) - 1)
        first, end = self._bucket(top)
        end = np.minimum(end, high[live])
        lo, hi = np.maximum(first, low[live]), end.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._lows(mid) < target[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        hit = np.flatnonzero(lo < end)
        hit = hit[self._lows(lo[hit]) == target[hit]]
        out[live[hit]] = lo[hit]
        return out


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file, each at a multiple of 64 bytes."""
    head, at, body = {}, 0, []
    for name, a in parts.items():
        a = np.ascontiguousarray(a)
        head[name] = (str(a.dtype), at, len(a))
        body.append(a.tobytes() + bytes(-a.nbytes % 64))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder whole or not at all; a second attempt writes the same again."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        part = f"{url.path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{url.path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


def map_file(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else read."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        raw = np.memmap(f"{url.path}/{name}", np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    out = {}
    for key, (kind, at, n) in head.items():
        kind, begin = np.dtype(kind), 8 + size + at
        out[key] = raw[begin : begin + n * kind.itemsize].view(kind)
    return out
