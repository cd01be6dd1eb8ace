"""Words of a batch of texts as numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All functions work on whole
Arrow batches, so that no Python statement runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of windows of words, and the mixing constants.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
#: Key of the word hash; words above LONG_WORD bytes are digested by a cryptographic hash first.
KEY, LONG_WORD = 0x6A09E667F3BCC909, 256
#: Texts are taken in slices of about so many bytes.
SLICE_BYTES = 1 << 20
#: Masks of the lowest 0 to 8 bytes.
_LOWEST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text; a longer text has a range of its own."""
    sizes = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(sizes, sizes[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_binary array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_binary()).fill_null(b"")


class Words:
    """Words of the rows first..last of a large_binary array.

    ``row`` numbers each word's text from 0, ``bounds`` has the first word of each text,
    ``start`` and ``end`` are byte positions in ``data``, ``inside`` tells which bytes are in words.
    """

    def __init__(self, texts: pa.Array, first: int, last: int, lower: bool = False):
        cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + first : texts.offset + last + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[cuts[0] : cuts[-1]] if body is not None and cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
        cuts = cuts - cuts[0]
        if lower:
            data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edges = cuts[(cuts > 0) & (cuts < len(data))]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[edges] = inside[edges]
        closes[:-1] &= ~inside[1:]
        closes[edges - 1] = inside[edges - 1]
        self.data, self.cuts, self.inside, self.n_rows = data, cuts, inside, last - first
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(cuts, self.start, "right") - 1
        self.bounds = np.searchsorted(self.start, cuts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes at a time go through the mixer, which no polynomial relation passes."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64) + np.uint64(KEY))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        for w in np.flatnonzero(length > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.start[w] : self.end[w]], digest_size=8, key=KEY.to_bytes(8, "little")).digest()
            out[w] = int.from_bytes(digest, "little")
        at = np.flatnonzero(length <= LONG_WORD) if len(length) and length.max() > LONG_WORD else np.arange(len(length))
        done = 0
        while len(at):
            left = length[at] - done
            chunk = eights[self.start[at] + done] & _LOWEST[np.minimum(left, 8)]
            out[at] = mix((out[at] ^ chunk) * np.uint64(BASE))
            at, done = at[left > 8], done + 8
        return out

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each window of n words within one text."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = len(hashes) - n + 1
        out = np.zeros(size, np.uint64)
        for k in range(n):
            out = out * np.uint64(BASE) + hashes[k : k + size]
        at = np.flatnonzero(self.row[:size] == self.row[n - 1 :])
        return mix(out[at]), at
