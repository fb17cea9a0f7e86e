"""Sets of word shingles and their one-permutation signatures, for batches of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from siftrank.llm.words import WordHasher, mix, window_hashes

BINS = 128
ROWS = 4


def shingle_sets(hasher: WordHasher, texts: Sequence[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; a text with fewer words has its
    whole word sequence as the only one, a text without words has none."""
    return counted_sets(hasher, texts, size)[1]


def counted_sets(hasher: WordHasher, texts: Sequence[bytes | None], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text, and its ``shingle_sets``."""
    words = hasher.words(texts)
    every = window_hashes(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= size:
            h = np.sort(every[a : b - size + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            out.append(window_hashes(words.hash[a:b], b - a) ^ np.uint64(0xA5A5A5A5 + (b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return np.diff(words.first), out


def first_by_bin(sets: Sequence[np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ascending set the smallest hash of each bin, which the top bits choose, and which bins have any."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    out = np.zeros((len(sets), bins), dtype=np.uint64)
    full = np.zeros((len(sets), bins), dtype=bool)
    for row, values in enumerate(sets):
        place = (values >> shift).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
        out[row, place[at]] = values[at]
        full[row, place[at]] = True
    return out, full


def set_digest(values: np.ndarray) -> bytes:
    """16 bytes that depend on the set alone."""
    parts = [mix(values ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x1234567, 0xFEDCBA987)]
    return np.array(parts, dtype=np.uint64).tobytes()


class Signer:
    """One-permutation hashing with optimal densification, cut into bands. Make one per task.

    The top bits of a shingle's hash choose its bin, a bin keeps its smallest hash. An empty bin takes the
    value of the first full bin in a random order of the bins that belongs to it, so two empty bins borrow
    independently, yet the same way in every document.
    """

    def __init__(self, bins: int = BINS) -> None:
        draw = np.random.default_rng(20240229)
        self.order = np.empty((bins, bins), dtype=np.int64)
        for i in range(bins):
            rest = np.delete(np.arange(bins), i)
            self.order[i] = np.concatenate(([i], draw.permutation(rest)))
        self.bins = bins

    def signatures(self, sets: Sequence[np.ndarray]) -> np.ndarray:
        """One row of ``bins`` numbers per set. Rows of empty sets mean nothing."""
        out, full = first_by_bin(sets, self.bins)
        sparse = np.flatnonzero(~full.all(axis=1))
        kept, mask = out[sparse], full[sparse]
        rows = np.arange(len(sparse))
        for i in range(self.bins if len(sparse) else 0):
            source = self.order[i][mask[:, self.order[i]].argmax(axis=1)]
            out[sparse, i] = kept[rows, source]
        return out

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """Bucket numbers, one per band: a hash of the band's number and its rows."""
        parts = signatures.reshape(len(signatures), -1, ROWS)
        h = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = np.broadcast_to(h, parts.shape[:2])
        for j in range(ROWS):
            h = mix(h ^ parts[:, :, j])
        return h
