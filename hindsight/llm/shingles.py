"""Words and word shingles of Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes that are not ASCII white space; A-Z are lower-cased, other characters
stay. A word's hash takes its bytes eight at a time, each lane mixed into the hash of those before by a
non-linear bijection; the few words of more than LONG bytes are hashed by BLAKE2. Two given words that
weren't built against these constants share a hash with a probability of about 2**-64, two shingles of
about 2**-59; the inner structure of a word (repetition, self-similarity) doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64


@dataclass(frozen=True)
class Letters:
    """How bytes are read: what each counts as, and which belong to words."""

    fold: np.ndarray
    inner: np.ndarray


def _letters(lower: bool, plain: bool = False) -> Letters:
    fold, inner = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    inner[[9, 10, 11, 12, 13, 32]] = False
    if lower:
        fold[ord("A") : ord("Z") + 1] += 32
    if plain:
        inner[[c for c in range(128) if not chr(c).isalnum()]] = False
    return Letters(fold, inner)


WORDS = _letters(lower=True)
#: Words of letters and digits: other ASCII characters separate them, too.
PLAIN = _letters(lower=True, plain=True)
#: Case is kept.
EXACT = _letters(lower=False)

#: Bytes of text that a task holds as arrays of words at a time, which take about forty times as much.
SLICE = 1 << 18
LONG = 64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers for each seed."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of about SLICE bytes at a time; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, min(int(np.searchsorted(off, off[a] + SLICE, "right")) - 1, len(column)))
        yield a, b - a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def lane(x: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of lanes x those at `at`, of which `left` bytes count (more than 8 are 8, below 1 none)."""
    drop = (8 - np.clip(left, 1, 8)).astype(np.uint64) << _U(3)
    v = x[np.minimum(at, len(x) - 1)]
    return np.where(left > 0, (v << drop) >> drop, _U(0))


def words(data: np.ndarray, off: np.ndarray, letters: Letters = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each row (rows + 1 entries), and each word's first and end byte."""
    full = letters.inner[data]
    first = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    start, stop = full.copy(), full.copy()
    start[1:] &= ~full[:-1]
    start[first] = full[first]
    stop[:-1] &= ~full[1:]
    stop[last] = full[last]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    data = letters.fold[data]
    x, n = lanes(data), b - a
    h = mix(lane(x, a, n) ^ (n.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)), 1)
    go = np.flatnonzero(n > 8)
    for k in range(8, LONG, 8):
        if not len(go):
            break
        h[go] = mix((h[go] * _U(0x9E3779B97F4A7C15)) ^ lane(x, a[go] + k, n[go] - k), 2)
        go = go[n[go] > k + 8]
    for i in go.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[a[i] : b[i]], digest_size=8).digest(), "little")
    return h, np.searchsorted(a, off), a, b


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of words i .. i+n-1 at each i (n - 1 fewer than words)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + h[k : k + m]
    return mix(out, n)


LOW = _U((1 << 59) - 1)


class Rarity:
    """Bands of words by their share of all words: 0 for what isn't in the table (rare), up to 31, half a power of two each."""

    def __init__(self, word: np.ndarray, count: np.ndarray, total: int, bits: int = 20):
        self.mask = _U((1 << bits) - 1)
        self.key, self.band = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)
        band = np.clip(np.floor(2 * np.log2(count / max(total, 1) * 2**20)) + 1, 1, 31).astype(np.uint8)
        order = np.argsort(band, kind="stable")  # of two words in one place the more frequent stays
        at = word[order] & self.mask
        self.key[at], self.band[at] = word[order], band[order]

    def bands(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return np.where(self.key[at] == h, self.band[at], 0).astype(np.uint64)


def sets(column: pa.Array, n: int, rarity: Rarity | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, its sorted distinct shingle tokens, its words). A text of fewer than n words has its whole sequence as its one shingle; without words it has none.

    A token is 59 bits of hash; with a rarity table the 5 bits above are its rarest word's band, an upper
    bound of its own frequency, so that rare tokens come first in order of value.
    """
    for first, rows, data, off in text_slices(column):
        h, at, _, _ = words(data, off)
        s = shingle_hashes(h, n) & LOW
        if rarity is not None and len(s):
            band = rarity.bands(h)
            s |= np.min([band[k : k + len(s)] for k in range(n)], axis=0) << _U(59)
        for i in range(rows):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                x = np.sort(s[a : b - n + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield first + i, x[keep], h[a:b]
            elif b > a:
                yield first + i, shingle_hashes(h[a:b], int(b - a)) & LOW, h[a:b]
            else:
                yield first + i, np.empty(0, np.uint64), h[a:b]
