"""numpy kernels over whole Arrow batches: the bytes of a string column, its words, their hashes, shingles and set digests.

Words are found in UTF-8 bytes. Only ASCII bytes separate words, so bytes of multi-byte characters always belong to words,
and lower-casing A-Z never touches them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
#: A random 64-bit value for each byte, and odd multipliers for the places in a word.
BYTE = _rng.integers(0, 2**64, 256, dtype=U)
PLACE = _rng.integers(0, 2**64, 1024, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text that are handled at once; one text may be longer.
SLICE = 1 << 21
SEED = 0xA0761D6478BD642F


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits that spreads every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends in them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, np.int64))


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes together are about at most `most`."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of several texts: `start` and `end` in `low` (lower-cased bytes), `doc` (index of the text)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, letters: np.ndarray):
        self.low = LOWER[raw]
        self.n_docs = len(at) - 1
        inside = letters[self.low]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = at[(at > 0) & (at < len(raw))]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        self.inside = inside

    def first(self) -> np.ndarray:
        """Where each text's words begin among all words, with the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def hashes(self) -> np.ndarray:
        """64 bits of each word: a multilinear hash of its bytes, mixed with its length."""
        if not len(self.start):
            return np.zeros(0, U)
        size = self.end - self.start
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        factor = PLACE[place & 1023]
        if size.max() > 1024:
            factor = factor + (place >> 10).astype(U) * U(0x9E3779B97F4A7C16)
        return mixed(np.add.reduceat(BYTE[self.low[self.inside]] * factor, begin) + size.astype(U))


def single(h: np.ndarray) -> np.ndarray:
    """What shingle_sets has for shingles of one word, from words' hashes."""
    return mixed(np.full(1, U(SEED * 0x9E3779B97F4A7C15 % 2**64)) + h)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int, letters: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of each text, ascending within it, and their bounds. A text of fewer words has its whole sequence."""
    w = Words(raw, at, letters)
    h, first = w.hashes(), w.first()
    count = np.diff(first)
    seed = [U(x * SEED % 2**64) for x in range(k + 1)]  # by the number of words
    if len(h) >= k:
        m = len(h) - k + 1
        g = np.full(m, seed[k])
        for j in range(k):
            g = mixed(g * U(0x9E3779B97F4A7C15) + h[j : j + m])
        whole = w.doc[:m] == w.doc[k - 1 :]
        g, doc = g[whole], w.doc[:m][whole]
    else:
        g, doc = np.zeros(0, U), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.zeros(len(few), U)
        for x, i in enumerate(few):
            s = np.full(1, seed[count[i]])
            for v in h[first[i] : first[i + 1]]:
                s = mixed(s * U(0x9E3779B97F4A7C15) + v)
            short[x] = s[0]
        g, doc = np.concatenate((g, short)), np.concatenate((doc, few))
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    ends = np.searchsorted(doc, np.arange(len(at)))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        g[a:b].sort()
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(at)))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each range of values, modulo 2**64; an empty range has 0."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
    return total[ends[1:]] - total[ends[:-1]]
