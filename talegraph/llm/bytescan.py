"""Vectorised scanning of whole texts as UTF-8 bytes, for use inside Spark's Arrow tasks.

Every word class the operators use is made of ASCII limits, so words can be found in the
raw bytes: no byte of a multi-byte character is below 0x80.  Hashes are polynomials over
the bytes (or over word hashes) modulo 2**64, so the hash of any run is a difference of two
prefix sums; a finaliser then spreads them over 64 bits.

Memory: texts are taken in pieces of about ``CHUNK`` bytes (several short texts, or a part
of a long one cut between words), so the temporaries stay near 100 MB whatever a batch or a
single text holds; what grows with a text is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

# The word classes that the contracts state, as sets of bytes.
SPACE_BYTES = [0x20, *range(0x09, 0x0E)]
IS_WORD = np.ones(256, bool)
IS_WORD[SPACE_BYTES] = False
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial over all 64 bits (in place where possible)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    return h


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random odd value for each byte; with ``lower``, A-Z share those of a-z."""
    t = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            steps = np.full(size, self.base, U64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=U64)
            steps[1:] = self.inverse
            self.down = np.cumprod(steps, dtype=U64)
        return self.up[:n], self.down[:n]


class RunHash:
    """Hashes of any runs ``[s, e)`` of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        length = (e - s).astype(U64)
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + length * U64(_ODD[3]))


_BYTE_POWERS, _WORD_POWERS = Powers(_ODD[0]), Powers(_ODD[1])
_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def table(seed: int, lower: bool) -> np.ndarray:
    if (seed, lower) not in _TABLES:
        _TABLES[seed, lower] = byte_table(seed, lower)
    return _TABLES[seed, lower]


def byte_runs(data: np.ndarray, seed: int = 1) -> RunHash:
    """Run hashes over bytes."""
    return RunHash(table(seed, False)[data], _BYTE_POWERS)


def value_runs(values: np.ndarray) -> RunHash:
    """Run hashes over 64-bit values, for example word hashes."""
    return RunHash(values, _WORD_POWERS)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and where each begins (one more than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0): about CHUNK bytes, or one long text."""
    raw, offsets = text_buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 2) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower`` A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    if len(data) <= 2 * CHUNK:
        return RunHash(table(seed, lower)[data], _BYTE_POWERS).of(starts, ends)
    out, lo = [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        out.append(RunHash(table(seed, lower)[data[a:b]], _BYTE_POWERS).of(starts[lo:hi] - a, ends[lo:hi] - a))
        lo = hi
    return np.concatenate(out)


class Words:
    """The words of the texts of one piece: their hashes, bytes and texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, is_word: np.ndarray = IS_WORD):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.before = word_bounds(data, offsets, is_word)
        self.hashes = hash_words(data, self.starts, self.ends, lower)

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def owner(self) -> np.ndarray:
        """For each word the index of its text in the piece."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def words_of(column: pa.Array, lower: bool, is_word: np.ndarray = IS_WORD) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in pieces(column):
        yield lo, hi, Words(data, offsets, lower, is_word)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    done, out = 1, keys
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out[:n]
