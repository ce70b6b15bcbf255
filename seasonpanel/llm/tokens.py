"""Hashed word ids of Arrow text columns, computed on bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are cut at white space.
CHUNK = 1 << 21

# byte classes: 0 white space and control, 1 letters, digits and all of non-ASCII, 2 other
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
_CLASS[128:] = 1
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(data: np.ndarray, starts: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hashes) of every word or symbol run; no run crosses one of ``starts``."""
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[starts[starts < len(data)]] = True
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(data)))
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    within = np.arange(len(data)) - np.repeat(first, length)
    total = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[within], first)
    keep = kind[first] > 0
    total, first, length = _mix(total[keep]), first[keep], length[keep]
    if not prefix:
        return first, total
    stem = np.zeros(len(first), np.uint64)
    for k in range(prefix):
        byte = data[np.minimum(first + k, len(data) - 1)].astype(np.uint64) + np.uint64(1)
        stem = stem * np.uint64(257) + np.where(k < length, byte, np.uint64(0))
    return first, np.stack([total, _mix(stem * _BASE)], axis=1)


def word_ids(texts: pa.Array, buckets: int, fold: bool, prefix: int = 0, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, ids, offsets): row ``first row + i`` holds ids[offsets[i]:offsets[i + 1]].

    Words and symbol runs are hashed to ``buckets`` ids; ``fold`` lower-cases A-Z. A null text has
    no ids. With ``prefix`` each word has two ids, of itself and of its first ``prefix`` bytes.
    Rows come in order, in groups of about ``chunk`` bytes.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + chunk, side="right")) - 1)
        lo, hi = int(ends[row]), int(ends[last])
        ids, at = [], []
        while lo < hi:
            stop = hi
            if hi - lo > 2 * chunk:  # a single long text: cut after the last white space of the chunk, if any
                blank = np.flatnonzero(_CLASS[raw[lo : lo + chunk]] == 0)
                stop = lo + (int(blank[-1]) + 1 if len(blank) else chunk)
            data = raw[lo:stop]
            first, total = _hashes(_FOLD[data] if fold else data, ends[row:last] - lo if lo == ends[row] else np.zeros(0, np.int64), prefix)
            ids.append((total % np.uint64(buckets)).astype(np.int32))
            at.append(first + lo)
            lo = stop
        ids = np.concatenate(ids) if ids else np.zeros((0, 2) if prefix else 0, np.int32)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        yield row, ids, np.searchsorted(at, ends[row : last + 1])
        row = last
