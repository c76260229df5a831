"""Words of a batch of texts, and hashes of words and word windows, as numpy arrays.

Words are maximal runs of bytes other than \\x20 and \\x09-\\x0D in UTF-8. All helpers work on a slice of a partition:
`pieces` cuts a batch so that the arrays of one slice stay small, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """Bytes of all texts, start and end of each word in them, and the first word of each text (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray

    def of(self, doc: int) -> slice:
        return slice(int(self.first[doc]), int(self.first[doc + 1]))


def pieces(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text stands alone."""
    return sized_pieces([len(t) if t else 0 for t in texts], most)


def sized_pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """`pieces` of texts of which only the sizes are at hand."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def split(texts: list[bytes | None], lower: bool = False) -> Words:
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8) if parts else np.zeros(0, np.uint8)
    if lower:
        data = LOWER[data]
    space = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    text_starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=text_starts[1:])
    return Words(data, starts, ends, np.searchsorted(starts, text_starts), text_starts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: np.uint64) -> np.ndarray:
    powers = np.full(BLOCK, base)
    powers[0] = 1
    return np.cumprod(powers)


BLOCK = 1 << 15  # values that are hashed at a time, so the tables of powers have a fixed size
_UP, _DOWN = _power_table(_BASE), _power_table(_INVERSE)


def _long_span(values: np.ndarray) -> np.ndarray:
    """The hash of one span of any length, block by block."""
    total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for lo in range(0, len(values), BLOCK):
        own = values[lo : lo + BLOCK].astype(np.uint64) + np.uint64(1)
        total += power * (own * _UP[: len(own)]).sum(dtype=np.uint64)
        power = power * _UP[-1] * _BASE
    return total


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values: a polynomial in them. Spans are in order and do not overlap.

    Spans that lie within a block of values are read off the running sums of the block; longer ones are hashed alone.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + BLOCK, "right"))
        if to <= at:
            out[at : at + 1] = _long_span(values[base : ends[at]])
            at += 1
            continue
        first, last = starts[at:to] - base, ends[at:to] - base
        own = values[base : base + int(last[-1])]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _UP[: len(own)], out=sums[1:])
        out[at:to] = (sums[last] - sums[first]) * _DOWN[first]
        at = to
    return mix(out)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.starts, words.ends)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values; entry i starts at i. Windows over text ends are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out)


def whole_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for the whole sequence, as an array of length 1 (0 for no words)."""
    return window_hashes(hashes, len(hashes)) if len(hashes) else np.zeros(0, np.uint64)
