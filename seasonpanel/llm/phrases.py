"""Words and word n-grams of Arrow text batches as numpy arrays of hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Kinds of bytes: parts of words, blanks between words, ends of pieces.
BLANK, BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Words of more bytes are hashed by XXH64, as a polynomial modulo 2**64 is weak on long patterns.
LONG_WORD = 256
_ROW = 1 << 12


def _mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash; every bit of ``h`` reaches every bit of the result."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class _Polynomial:
    """Hashes of byte ranges: sums of byte values times powers of an odd base, shifted to the range's start."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.low = self._powers(self.base, _ROW), self._powers(self.inverse, _ROW)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base % (1 << 64), np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rows = len(data) // _ROW + 1
        sums = self.values[data]
        sums *= np.multiply.outer(self._powers(pow(self.base, _ROW, 1 << 64), rows), self.low[0]).ravel()[: len(data)]
        np.cumsum(sums, out=sums)
        found = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
        far = self._powers(pow(self.inverse, _ROW, 1 << 64), rows)
        return found * far[starts // _ROW] * self.low[1][starts % _ROW]


_POLYNOMIALS = [_Polynomial(seed) for seed in (11, 12)]
_TIMES = np.random.default_rng(13).integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)


@dataclass
class Words:
    """The words of a batch: byte ranges of ``data``, their document, and whether the next word is in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    joined: np.ndarray

    def phrase(self, at: int, words: int) -> bytes:
        """The words from ``at`` on, space-joined."""
        return b" ".join(self.data[self.starts[at] : self.ends[at + words - 1]].tobytes().split())

    def hashes(self, salts: np.ndarray, which: int = 0) -> np.ndarray:
        """One hash per word; ``salts`` has a number per document that is hashed with its words."""
        found = _POLYNOMIALS[which].ranges(self.data, self.starts, self.ends)
        for at in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            found[at] = xxhash.xxh64_intdigest(self.data[self.starts[at] : self.ends[at]].tobytes(), which)
        return _mix(found + salts[self.doc])

    def spans(self, words: int) -> np.ndarray:
        """For each word, whether ``words`` words of one piece start there."""
        n = len(self.starts)
        fits = np.ones(n, bool)
        for k in range(words - 1):
            fits[: n - k] &= self.joined[k:]
            fits[n - k :] = False
        return fits


def longer(left: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of n-grams of ``size`` words from those of one word less and of single words, cut to the shorter length."""
    n = max(0, len(words) - size + 1)
    return _mix(left[:n] * _TIMES[0] + words[size - 1 :][:n] * _TIMES[1] + np.uint64(size))


def read_words(texts: pa.Array) -> Words:
    """Lower-cases A-Z and cuts texts at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at blanks into words; null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = _LOWER[raw]
    kind = _KIND[data]
    # a word starts or ends where a byte of a word follows another kind or a text's border
    change = np.zeros(len(data) + 1, bool)
    change[1:-1] = (kind[1:] == 0) != (kind[:-1] == 0)
    change[offsets] = True
    change = np.flatnonzero(change)
    inside = np.flatnonzero(kind[change[:-1]] == 0) if len(data) else np.zeros(0, np.int64)
    starts, ends = change[inside], change[inside + 1]
    pieces = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
    doc = np.searchsorted(offsets, starts, "right") - 1
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (pieces[1:] == pieces[:-1]) & (doc[1:] == doc[:-1])
    return Words(data, starts, ends, doc, joined)
