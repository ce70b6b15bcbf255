"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A collection is concatenated with one terminator (0) behind each string; terminators sort before
all characters and among themselves in the order of the strings. Characters are bytes + 1 and must
be below 256, as the bytes of UTF-8 are.
"""

from __future__ import annotations

import numpy as np

#: Transforms merged in one go.
FAN_IN = 120


def build(strings: list[bytes]) -> np.ndarray:
    """The transform (uint8) of a collection.

    Suffixes are ordered by their first 8 characters, then in rounds that double the depth, in
    which only suffixes that still share their rank with others are sorted.
    """
    length = np.array([len(s) for s in strings], np.int64) + 1
    n = int(length.sum())
    text = np.zeros(n + 8, np.uint64)
    body = np.ones(n, bool)
    ends = np.cumsum(length) - 1
    body[ends] = False
    text[:n][body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
    last = np.repeat(ends, length)
    string = np.repeat(np.arange(len(strings)), length)
    left = last - np.arange(n)
    packed = np.zeros(n, np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | np.where(left >= k, text[k : n + k], np.uint64(0))
    order = np.argsort(packed)
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    key = packed[order]
    depth, group = 8, np.arange(n)  # of the rows of ``order`` that ``group`` names
    while True:
        # equal keys get the place of the first of them as rank
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, place[group], 0))
        rank[order[group]] = first
        alone = fresh & np.concatenate([fresh[1:], [True]])
        group, first = group[~alone], first[~alone]
        if not len(group):
            break
        who = order[group]
        # a suffix that ended within the depth is equal to the others of its rank: the string decides
        ahead = np.where(left[who] >= depth, rank[np.minimum(who + depth, n - 1)], string[who])
        key = first * (n + 1) + ahead
        by = np.argsort(key)
        order[group] = who[by]
        key = key[by]
        depth *= 2
    starts = ends - length + 1
    before = np.empty(n, np.uint8)
    before[1:] = text[: n - 1]
    before[starts] = 0
    return before[order]


def numbered_rows(bwts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, row of the suffix one character longer, rows of the terminators) of all transforms, numbered through."""
    steps, ends, at = [], [], 0
    for b in bwts:
        step = np.empty(len(b), np.int32)
        step[np.argsort(b, kind="stable")] = np.arange(at, at + len(b))
        steps.append(step)
        ends.append(np.arange(at, at + int((b == 0).sum())))
        at += len(b)
    chars = np.concatenate(bwts)
    used = np.flatnonzero(np.bincount(chars))
    code = np.zeros(int(used[-1]) + 1, np.uint8)
    code[used] = np.arange(len(used))
    return code[chars], np.concatenate(steps), np.concatenate(ends).astype(np.int32)


def places(char: np.ndarray, step: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset of each row's suffix, string lengths), found by walking back from all terminators at once."""
    string, back = np.empty(len(char), np.int32), np.empty(len(char), np.int32)
    length = np.zeros(len(ends), np.int64)
    who, row, walked = np.arange(len(ends)), ends, 0
    while len(who):
        string[row], back[row] = who, walked
        more = char[row] != 0
        if not more.all():
            length[who[~more]] = walked
            who, row = who[more], row[more]
        row = step[row]
        walked += 1
    return string, length[string] - back, length


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Keys as their ranks, in the smallest type, for radix passes."""
    used = np.flatnonzero(np.bincount(keys))  # pairs of bytes, so below 1 << 16
    if len(used) >= 1 << 16:
        return keys
    code = np.zeros(int(used[-1]) + 1, np.uint8 if len(used) < 256 else np.uint16)
    code[used] = np.arange(len(used))
    return code[keys]


def _pairs(char: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(the two characters before each row, the row two characters further on, width of the alphabet)."""
    wide = int(char.max()) + 1
    return char[step].astype(np.int64) * wide + char, step[step], wide


def merge(bwts: list[np.ndarray]) -> np.ndarray:
    """The transform of all strings of ``bwts``, in their order.

    Rows are numbered through all transforms; those of one transform never change places among
    themselves, only how the transforms interleave does. A round puts the rows in the order of two
    characters more: every row, in the present order, hands on the two characters before it, and a
    stable pass over these pairs is the new order. No suffix is sorted again. It ends when the
    interleave stays. Suffixes of no or one character before their terminator have fixed places, in
    the order of the strings.
    """
    char, step, ends = numbered_rows(bwts)
    pair, twice, wide = _pairs(char, step)
    # fixed places: terminators first, then each character's suffixes of that character alone
    ordered = np.sort(pair)
    one = step[ends]
    one = one[np.argsort(char[ends], kind="stable")]
    fixed = np.flatnonzero((ordered % wide == 0) & (ordered >= wide))
    pair = _numbered(pair)
    now = np.concatenate([ends, np.setdiff1d(np.arange(len(char), dtype=np.int32), ends)])
    while True:
        new = twice[now[np.argsort(pair[now], kind="stable")]]
        new[: len(ends)] = ends
        new[fixed] = one
        if np.array_equal(new, now):
            return np.concatenate(bwts)[now]
        now = new


def window_intervals(char: np.ndarray, step: np.ndarray, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, interval) of the suffixes ``depth`` characters before ``rows``, by these characters.

    The interleave is refined as in :func:`merge`, for the rows alone that reach a window of
    ``depth`` characters, and only as deep. Of every round's order the common prefixes are known: a
    row starts a new interval if its pair differs from the row above, or if the rows they come from
    were in different intervals. After the last round an interval is a set of equal windows. A row alone
    in its interval stays so and leaves the rounds; these come last, in no order. None of the rows may
    be closer than ``depth`` characters to the start of its string.
    """
    if depth % 2:
        raise ValueError("depth must be even")
    pair, twice, _ = _pairs(char, step)
    pair = _numbered(pair)
    now, order, interval = rows, np.arange(len(rows), dtype=np.int32), np.zeros(len(rows), np.int32)
    alone = []
    for _ in range(depth // 2):
        if not len(now):
            break
        keys = pair[now]
        by = np.argsort(keys, kind="stable")
        now, order, keys, before = twice[now[by]], order[by], keys[by], interval[by]
        starts = np.ones(len(now) + 1, bool)
        starts[1:-1] = (before[1:] != before[:-1]) | (keys[1:] != keys[:-1])
        interval = np.cumsum(starts[:-1], dtype=np.int32)
        single = starts[:-1] & starts[1:]
        if 8 * np.count_nonzero(single) > len(now):
            alone.append(order[single])
            now, order, interval = now[~single], order[~single], interval[~single]
    single = np.concatenate([np.zeros(0, np.int32), *alone])
    last = interval[-1] if len(interval) else 0
    return np.concatenate([order, single]), np.concatenate([interval, last + 1 + np.arange(len(single), dtype=np.int32)])


def least_per_window(bwts: list[np.ndarray], values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, lengths): for every string and every start of ``depth`` characters in it, in that order,
    the least of ``values`` (one per string) over all strings that hold the same characters anywhere.
    """
    while len(bwts) > FAN_IN:
        bwts = [merge(bwts[i : i + FAN_IN]) for i in range(0, len(bwts), FAN_IN)]
    char, step, ends = numbered_rows(bwts)
    string, offset, length = places(char, step, ends)
    rows = np.flatnonzero(offset >= depth).astype(np.int32)
    order, interval = window_intervals(char, step, rows, depth)
    many = np.maximum(length - depth + 1, 0)
    base = np.concatenate([[0], np.cumsum(many)])
    least = np.empty(int(base[-1]), np.int64)
    if len(rows):
        rows = rows[order]
        cut = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        low = np.minimum.reduceat(values[string[rows]], cut)
        least[base[string[rows]] + offset[rows] - depth] = np.repeat(low, np.diff(np.append(cut, len(rows))))
    return least, many
