"""Words of many texts at once, as NumPy arrays: byte offsets and 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D. In UTF-8 these bytes are never part of another
character, so bytes and code points give the same words. The hash of a word is a polynomial over random byte
values modulo 2**64, mixed with its length; it depends on the word alone. Long buffers are taken in pieces
that end at a word's end, so memory beyond the result is bounded unless one single word is longer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

PIECE_BYTES = 1 << 19
BATCH_BYTES = 3 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a batch of texts. ``first`` has len(texts) + 1 entries: the words of text i are
    first[i]:first[i + 1]. ``begin`` has the byte at which each text begins."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class WordHasher:
    """Words and their hashes; ``lower`` makes A-Z equal to a-z, ``apart`` tells which bytes part words (space and
    0x09-0x0D, unless given). Make one per task."""

    def __init__(self, lower: bool, apart: np.ndarray | None = None) -> None:
        if apart is None:
            apart = np.zeros(256, dtype=bool)
            apart[32] = apart[9:14] = True
        self.apart = apart
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        if lower:
            self.values[65:91] = self.values[97:123]
        self._grow(PIECE_BYTES + 4096)

    def _grow(self, size: int) -> None:
        powers = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p))
        self.power, self.inverse = powers

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~self.apart[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = self._parts(data, edges[0::2], edges[1::2])
        if len(data) > len(self.power):
            self._grow(len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        return start, end, self._finish(h, end - start)

    def _parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each run of bytes is parted into: itself."""
        return start, end

    @staticmethod
    def _finish(h: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def stems(self, words: Words, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the ascending ``sizes`` hash and bytes of the first ``size`` code points of each word, of the word
        itself where it is not longer."""
        data = np.frombuffer(words.data, dtype=np.uint8)
        plain = data.max(initial=0) < 128
        if not plain:
            lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), [len(data)] * (max(sizes) + 1))
            first = np.searchsorted(lead[: len(lead) - max(sizes) - 1], words.start)
        h, done = np.zeros(len(words.start), dtype=np.uint64), np.zeros(len(words.start), dtype=np.int64)
        for size in sizes:
            length = np.minimum(words.end, words.start + size if plain else lead[first + size]) - words.start
            more = np.flatnonzero(length > done)
            while len(more):
                at = done[more]
                h[more] += self.values[data[words.start[more] + at]] * self.power[at]
                done[more] = at + 1
                more = more[length[more] > at + 1]
            yield self._finish(h, length), length

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word of a byte buffer."""
        at, parts = 0, []
        while at < len(data):
            stop = min(at + PIECE_BYTES, len(data))
            reach = 4096
            while stop < len(data):  # to the next space
                gap = np.flatnonzero(self.apart[data[stop : stop + reach]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop, reach = min(stop + reach, len(data)), reach * 4
            start, end, h = self._piece(data[at:stop])
            parts.append((start + at, end + at, h))
            at = stop
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0, dtype=np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def words(self, texts: Sequence[bytes | None]) -> Words:
        """Words of each text; NULL has none."""
        texts = [t or b"" for t in texts]
        data = b" ".join(texts)
        start, end, h = self.hashes(np.frombuffer(data, dtype=np.uint8))
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        return Words(data, start, end, h, np.searchsorted(start, begins), begins[:-1])


def slices(texts: Sequence[bytes | None], max_bytes: int = BATCH_BYTES) -> Iterator[slice]:
    """Consecutive slices of at most ``max_bytes`` of text, or of one longer text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or b"") + 1
        if i > begin and held + size > max_bytes:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield slice(begin, len(texts))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries of ``words``; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = (h ^ words[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix(h)
