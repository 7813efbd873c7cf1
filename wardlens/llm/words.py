"""Hashes of words and word windows over whole Arrow slices, without a Python step per word.

A word has two hashes of 64 bits, each a chain of a bijective mixing over its
bytes, eight at a time (BLAKE2 for long words). A window's hash is a polynomial
in one of them modulo 2**64, taken as a difference of running sums, so every
window costs the same whatever its length; it is meant for windows of less than
a thousand words. Whole texts of any length are hashed with one random odd
factor per place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from wardlens.session import ship_by_value

ship_by_value(__name__)

#: Bytes of text hashed at a time; a longer text is hashed alone and whole.
SLICE_BYTES = 500_000
WORD_BASE, OTHER_BASE = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # odd, so they have inverses
#: Start and factor of the two chains over a word's bytes.
CHAINS = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)))
#: Longer words are hashed one by one.
LONG_WORD = 512
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word. Words that differ in one step of eight bytes or in length stay apart in it."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = end - start
    hashes = [np.full(len(start), seed) ^ (size.astype(np.uint64) * factor) for seed, factor in CHAINS]
    active, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(active):
        left = size[active] - at
        lane = eight[start[active] + at]
        short = left < 8
        lane = np.where(short, lane & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), lane)
        for h, (seed, factor) in zip(hashes, CHAINS, strict=True):
            h[active] = mixed((h[active] ^ lane) * factor + seed)
        at += 8
        active = active[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        hashes[0][i], hashes[1][i] = np.frombuffer(digest, np.uint64)
    return hashes[0], hashes[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    held = POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        held = both[0], both[1]
        if size <= 2 * SLICE_BYTES:
            POWERS[base] = held
    return held


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values times powers of the base before each place, one more than there are values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(base, len(sums))[1][start]


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most SLICE_BYTES together; a longer text comes alone."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and where each text starts (and the last ends)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: hashes, places and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.text_starts = text_bytes(texts)
        self.data = data
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.text_starts] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Text i has the words first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, self.text_starts)
        self.hash, self.other = word_hashes(LOWER[data] if lower else data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.hash)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self, base: int = WORD_BASE) -> np.ndarray:
        return running(self.hash if base == WORD_BASE else self.other, base)

    def texts(self) -> np.ndarray:
        """A hash of all words of each text, for texts of any length."""
        counts = self.counts()
        place = np.arange(len(self)) - np.repeat(self.first[:-1], counts)
        factor = mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(OTHER_BASE)) | np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.other * factor)))
        return mixed(sums[self.first[1:]] - sums[self.first[:-1]] + counts.astype(np.uint64)).view(np.int64)

    def of(self, sums: np.ndarray, start: np.ndarray, size, base: int = WORD_BASE) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start at the given words."""
        return mixed(between(sums, start, start + size, base) + np.asarray(size).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The words at which a window of ``size`` words starts that stays within its text."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self))
        return np.flatnonzero(left >= size)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, one without words none."""
    words = Words(texts, lower=True)
    sums = words.sums()
    starts = words.windows(size)
    found = words.of(sums, starts, size)
    cuts = np.searchsorted(starts, words.first)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = words.of(sums, words.first[short], counts[short])
    sets = [np.unique(found[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for i, h in zip(short.tolist(), whole, strict=True):
        sets[i] = np.array([h], np.uint64)
    return sets
