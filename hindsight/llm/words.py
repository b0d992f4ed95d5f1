"""Token ids of whole texts from the ids of their white-space chunks.

The word-level tokenizer normalises white space away and never joins characters across it, so a text's
ids are its chunks' ids in order; tests compare this with whole-text encoding. Chunks are cut and hashed
on the Arrow buffers; a table of fixed size per Python worker remembers the bytes and ids of recent
chunks of up to KEPT bytes. A chunk takes remembered ids only if its bytes are the remembered ones; all
others become strings and are encoded.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import shingles

#: Chunks of up to so many bytes are remembered, as lanes of eight.
KEPT = 24


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1 for each i, in one array."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


class ChunkCoder:
    """Ids of chunks by encode(list of chunks) -> list of id lists.

    Holds 2**bits chunks at most, each in one of two places, and `most` ids, after which it starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list], bits: int = 20, most: int = 1 << 24):
        self.encode, self.mask, self.most = encode, np.uint64((1 << bits) - 1), most
        self.key = np.zeros((1 << bits, KEPT // 8), np.uint64)
        self.bytes, self.start, self.size = np.zeros(1 << bits, np.int16), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0

    def _coded(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the chunks raw[a:b]; gives their places in ids."""
        coded = self.encode([raw[i:j].decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), total), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in coded for i in x), np.uint32, total)
        start = self.used + np.cumsum(size) - size
        self.used += total
        return start, size

    def _held(self, at: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the places hold exactly these chunks."""
        return (self.bytes[at] == n) & (self.key[at] == key).all(axis=1)

    def _known(self, h: np.ndarray, key: np.ndarray, n: np.ndarray, raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids of the short chunks raw[a:b], whose hashes, lanes and lengths are h, key and n."""
        one, two = h & self.mask, (h >> np.uint64(40)) & self.mask
        slot = np.where(self._held(one, key, n), one, two)
        miss = np.flatnonzero(~self._held(slot, key, n))
        start, size = self.start[slot], self.size[slot].astype(np.int64)
        if len(miss):
            _, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[where]
            s, z = self._coded(raw, a[where], b[where])
            start[miss], size[miss] = s[back], z[back]
            at = np.where(self.bytes[one[where]] == 0, one[where], two[where])
            at, last = np.unique(at[::-1], return_index=True)
            last = len(where) - 1 - last
            self.key[at], self.bytes[at], self.start[at], self.size[at] = key[where[last]], n[where[last]], s[last], z[last]
            same = (n[miss] == n[where[back]]) & (key[miss] == key[where[back]]).all(axis=1)
            if not same.all():  # another chunk with the same hash
                odd = miss[~same]
                start[odd], size[odd] = self._coded(raw, a[odd], b[odd])
        return start, size

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, all ids, ids per row) of a text column, a slice at a time; a null is an empty text."""
        for first, rows, data, off in shingles.text_slices(column):
            if self.used > self.most:
                self.bytes[:], self.used = 0, 0
            h, at, a, b = shingles.words(data, off, shingles.EXACT)
            raw, x, n = data.tobytes(), shingles.lanes(data), b - a
            start, size = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
            few, many = np.flatnonzero(n <= KEPT), np.flatnonzero(n > KEPT)
            key = np.stack([shingles.lane(x, a[few] + k, n[few] - k) for k in range(0, KEPT, 8)], axis=1)
            start[few], size[few] = self._known(h[few], key, n[few], raw, a[few], b[few])
            if len(many):
                start[many], size[many] = self._coded(raw, a[many], b[many])
            sums = np.concatenate([[0], np.cumsum(size)])
            yield first, rows, self.ids[ragged(start, size)], np.diff(sums[at])


@functools.lru_cache(maxsize=1)
def library_coder(path: str) -> ChunkCoder:
    """The coder of this Python worker for a tokenizer file: later tasks of the worker find its chunks."""
    return ChunkCoder(library(path))


def library(path: str) -> Callable[[list[str]], list]:
    """encode() by the tokenizers library, without truncation, padding or special tokens of its own."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda words: [x.ids for x in tok.encode_batch_fast(words, add_special_tokens=False)]
