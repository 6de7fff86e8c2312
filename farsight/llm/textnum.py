"""Vectorised words, shingles and windows of a batch of texts, as 64-bit hashes.

A batch of texts becomes one byte (or code point) array. Prefix sums of a polynomial modulo 2**64 then
give the hash of any word or window by two look-ups, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that end a word: the ASCII blank characters, or all ASCII characters but letters, digits and "_".
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SPACES_AND_MARKS = np.array([b < 128 and not (chr(b).isalnum() or b == 0x5F) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (base, inverse))
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of values[start:end] for many ranges."""
    power, inverse = _powers(_BASES[base], len(values))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * power[: len(values)])])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))


def sums_by_place(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for ranges in order that don't overlap: sums of values mixed with their places within the range.

    Unlike a polynomial modulo 2**64 it has no ranges, however long, that collide by construction for any base.
    """
    n = end - start
    flat, at = gathered(values, start, end)
    place = np.arange(len(flat)) - np.repeat(at[:-1], n)
    mixed = mix(mix(flat + _U(_BASES[1])) ^ mix((place.astype(_U) + _U(1)) * _U(_BASES[0])))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed)])
    return mix(sums[at[1:]] - sums[at[:-1]] + n.astype(_U))


def gathered(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a few ranges, one after the other, and where each begins (and the last ends)."""
    at = np.concatenate([[0], np.cumsum(end - start)])
    return values[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])], at


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about `limit` characters each (more only where a single text has more)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of a few texts: their hashes, the text of each, and where the words of each text begin."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray = SPACES, *, by_place: bool = False):
        #: whether words are hashed so that equality may be taken from the hash
        self.by_place = by_place
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.diff((~breaks[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.data = data
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        #: words[first[i]:first[i + 1]] are those of text i
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    @cached_property
    def hash(self) -> np.ndarray:
        return (sums_by_place if self.by_place else ranges)(_BYTE[self.data], self.start, self.end)

    @cached_property
    def whole(self) -> np.ndarray:
        """A hash of all words of each text."""
        return sums_by_place(self.hash, self.first[:-1], self.first[1:])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within one text, and the index of the first word of each."""
        if len(self.hash) < n:
            return np.empty(0, _U), np.empty(0, np.int64)
        at = np.arange(len(self.hash) - n + 1)
        at = at[self.text[at] == self.text[at + n - 1]]
        return ranges(self.hash, at, at + n, 1), at

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and the text of each; a text of fewer words is one run of all its words."""
        full, at = self.windows(n)
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        less = ranges(self.hash, self.first[short], self.first[short + 1], 1)
        return np.concatenate([full, less]), np.concatenate([self.text[at], short])


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, without the finaliser of `ranges`."""
    if len(values) < n:
        return np.empty(0, _U)
    power, inverse = _powers(_BASES[0], len(values))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * power[: len(values)])])
    return (sums[n:] - sums[:-n]) * inverse[: len(values) - n + 1]
