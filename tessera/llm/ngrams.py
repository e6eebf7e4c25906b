"""Character n-grams of batches of texts, hashed side by side in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters that are hashed in one go.
CHUNK = 1 << 17
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: Iterable[str | None], longest: int) -> Iterator[tuple[int, str, int]]:
    """(number of the text, a piece of it in lower case with a blank at both ends, where n-grams may begin in it)."""
    for i, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for at in range(0, len(text), CHUNK):
            yield i, text[at : at + CHUNK + longest - 1], min(CHUNK, len(text) - at)


def _together(pieces: Iterator[tuple[int, str, int]]) -> Iterator[list[tuple[int, str, int]]]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def hashed(texts: Iterable[str | None], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 64-bit hashes of all n-grams of texts, with the number of the text that each is of, ascending; about CHUNK
    characters at a time, so that a text of any length takes no more. Null is the empty text."""
    longest = max(orders)
    for pieces in _together(_pieces(texts, longest)):
        length = np.array([len(p) for _, p, _ in pieces])
        chars = np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.array([i for i, _, _ in pieces]), length)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(length) - length, length)
        starts = np.array([s for _, _, s in pieces])
        run = np.zeros(len(chars), np.uint64)
        for n in range(1, min(longest, len(chars)) + 1):
            run = (run[: len(chars) - n + 1] + chars[n - 1 :] + np.uint64(n)) * _MULTIPLIER
            run ^= run >> np.uint64(31)
            if n in orders:
                inside = np.flatnonzero(place[: len(run)] < np.repeat(np.minimum(starts, length - n + 1), length)[: len(run)])
                yield owner[inside], (run[inside] * _MULTIPLIER)
