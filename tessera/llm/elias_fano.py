"""Elias-Fano sequences in numpy, and files of arrays that are mapped into memory.

A monotone sequence keeps the low bits of each value packed, and the high bits as a bit vector: value i, with high part
h, sets bit h + i. select() on ones reads a value; select() on zeros bounds the values of one high part. All operations
take arrays of queries.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np

from tessera.llm.common import store

#: Place of the k-th one (from 0) in a byte, by byte and k.
_IN_BYTE = np.array([[*(i for i in range(8) if byte >> i & 1), *[0] * 8][:8] for byte in range(256)], np.int64)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th one (from 0), or zero if flip. before: their number in front of each word."""
    word = np.searchsorted(before, k, side="right") - 1
    k, rest, place = k - before[word], words[word], word * 64
    rest = ~rest if flip else rest
    for width in (32, 16, 8):
        n = np.bitwise_count(rest & np.uint64((1 << width) - 1))
        up = k >= n
        k = k - n * up
        shift = up * width
        place += shift
        rest = rest >> shift.astype(np.uint64)
    return place + _IN_BYTE[(rest & np.uint64(255)).astype(np.int64), k]


def _run(words: np.ndarray, place: np.ndarray, ones: bool) -> np.ndarray:
    """How many ones, or zeros, follow each other from a place on."""
    length, open_ = np.zeros(len(place), np.int64), np.arange(len(place))
    while open_.size:
        at = place[open_] + length[open_]
        bit = at & 63
        word = words[np.minimum(at >> 6, len(words) - 1)]
        word = (~word if ones else word) >> bit.astype(np.uint64)
        step = np.minimum(np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)), 64 - bit)
        length[open_] += step
        open_ = open_[(step == 64 - bit) & (at >> 6 < len(words) - 1)]
    return length


class EliasFano:
    """A sequence from encode()."""

    def __init__(self, arrays: Mapping[str, np.ndarray], name: str) -> None:
        self.n, self.bits = (int(x) for x in arrays[f"{name}.shape"][:2])
        self.low, self.high, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros"))

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        """Arrays of a sequence of ascending numbers, equal ones allowed."""
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (int(place[-1]) if n else 0) + 2  # ends with a zero
        length += -length % 64
        high = np.zeros(length, np.uint8)
        high[place] = 1
        high = np.packbits(high, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        ahead = lambda x: np.concatenate([[0], np.cumsum(x)[:-1]]).astype(np.int64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return {f"{name}.shape": np.array([n, bits], np.int64), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ahead(ones), f"{name}.zeros": ahead(64 - ones)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        more = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift) | more) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self.ones, i, False) - i
        return (high << self.bits) | self._low(i).astype(np.int64)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1."""
        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = _select(self.high, self.ones, i, False)
        after = place + 1 + _run(self.high, place + 1, False)
        low = self._low(np.concatenate([i, i + 1])).astype(np.int64)
        return ((place - i) << self.bits) | low[: len(i)], ((after - i - 1) << self.bits) | low[len(i) :]

    def _bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place of x or more among the values of x's high part, the end of those, and x's low part."""
        high, part = x >> self.bits, (x & ((1 << self.bits) - 1)).astype(np.uint64)
        some = np.flatnonzero(high > 0)
        bit = np.zeros(len(x), np.int64)
        bit[some] = _select(self.high, self.zeros, high[some] - 1, True) + 1
        start = bit - high
        end = start + _run(self.high, bit, True)
        last = end.copy()
        while (open_ := np.flatnonzero(start < end)).size:
            middle = (start[open_] + end[open_]) >> 1
            less = self._low(middle) < part[open_]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
        return start, last, part

    def _inside(self, x: np.ndarray) -> np.ndarray:
        last = int(self.get(np.array([self.n - 1]))[0]) if self.n else -1
        return np.flatnonzero((x >= 0) & (x <= last))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is x or more, for x of 0 or more; n if there is none."""
        place = np.full(len(x), self.n)
        inside = self._inside(x)
        if inside.size:
            place[inside] = self._bounds(x[inside])[0]
        return place

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is x; -1 if there is none."""
        place = np.full(len(x), -1)
        inside = self._inside(x)
        if inside.size:
            at, end, part = self._bounds(x[inside])
            hit = np.flatnonzero(at < end)
            hit = hit[self._low(at[hit]) == part[hit]]
            place[inside[hit]] = at[hit]
        return place


def save(uri: str, arrays: Mapping[str, np.ndarray]) -> None:
    """Writes arrays to one file: the length of a JSON header, the header, the arrays in steps of 64 bytes."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [str(a.dtype), list(a.shape), at]
        at += a.nbytes + -a.nbytes % 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    files, path = store(uri)
    with files.open_output_stream(path, compression=None) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped into memory where the folder is mounted, else read."""
    files, path = store(uri)
    data = np.memmap(path, np.uint8, "r") if files.type_name == "local" else np.frombuffer(files.open_input_file(path).read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(data[8 : 8 + size].tobytes()).items():
        at += 8 + size
        count = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.asarray(data[at : at + count]).view(kind).reshape(shape)
    return out


#: What held() keeps: bytes of files that were read, and number of files that are mapped, which takes no memory of its own.
HELD_BYTES = 256 << 20
MAPPED = 4096
_held: dict[str, dict[str, np.ndarray]] = {}


def held(uri: str) -> dict[str, np.ndarray]:
    """load(), and keeps the files that were used last."""
    if uri in _held:
        _held[uri] = _held.pop(uri)
        return _held[uri]
    own, mapped = load(uri), store(uri)[0].type_name == "local"
    size = lambda arrays: 0 if mapped else sum(a.nbytes for a in arrays.values())
    total = sum(map(size, _held.values())) + size(own)
    if total > HELD_BYTES or len(_held) >= MAPPED:
        for old in list(_held):
            if total > HELD_BYTES // 2 or len(_held) > MAPPED // 2:
                total -= size(_held.pop(old))
    _held[uri] = own
    return own
