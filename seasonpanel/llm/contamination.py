"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, stored

#: Shortest tile and seed, in words.
MIN_TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bytes of benchmark text that tasks hold at once.
BLOCK_BYTES = 8 << 20
#: Scripts written without blanks: every letter is a word (Thai to Tibetan, Myanmar, Khmer, kana, Han).
_UNSPACED = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[^\W]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``length`` ids, each from the one before in constant time."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # prefix sums of id * base^i; the difference of two, times base^-i, belongs to the window
    power = np.cumprod(np.full(len(ids), _BASE, np.uint64))
    back = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    return (total[length:] - total[:-length]) * back


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in doc, place in item, length) of matches that overlap in neither.

    The search length starts at the item's length and is halved down to ``shortest``. At each length
    unmarked windows of both sides meet by their rolling hash, matches are extended while words are
    equal and unmarked, and are marked from the longest on (ties: first in the document, then in the
    item). A match that an earlier one cut into is looked for again. Negative ids match nothing.
    """
    free_doc, free_item = doc >= 0, np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    length = max(shortest, len(item))
    while length >= shortest:
        again = True
        while again:
            again = False
            starts_item = _windows(free_item, length)
            starts_doc = _windows(free_doc, length)
            if not len(starts_item) or not len(starts_doc):
                break
            by_hash: dict[int, list[int]] = {}
            hashes = rolling(item, length)
            for j in starts_item.tolist():
                by_hash.setdefault(int(hashes[j]), []).append(j)
            hashes = rolling(doc, length)[starts_doc]
            hit = np.isin(hashes, np.fromiter(by_hash, np.uint64, len(by_hash)))
            matches, reach = [], {}
            for i, h in zip(starts_doc[hit].tolist(), hashes[hit].tolist()):
                for j in by_hash[int(h)]:
                    if i < reach.get(i - j, -1):  # inside a match on the same diagonal
                        continue
                    if not np.array_equal(doc[i : i + length], item[j : j + length]):
                        continue
                    n = length
                    while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                        n += 1
                    reach[i - j] = i + n
                    matches.append((-n, i, j))
            for n, i, j in sorted(matches):
                n = -n
                if free_doc[i : i + n].all() and free_item[j : j + n].all():
                    free_doc[i : i + n] = free_item[j : j + n] = False
                    found.append((i, j, n))
                    again = True
        length = length // 2 if length // 2 > shortest or length == shortest else shortest
    return sorted(found)


def _windows(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of ``length`` that are free throughout."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[length:] == taken[:-length]) if len(free) >= length else np.zeros(0, np.int64)


@dataclass
class Seeds:
    """Windows of one length in the items of a block, by hash."""

    length: int
    hashes: np.ndarray
    #: Item numbers of hash i: owners[starts[i]:starts[i + 1]].
    starts: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, length: int, items: dict[int, np.ndarray]) -> Seeds:
        pairs = sorted({(int(h), k) for k, ids in items.items() for h in rolling(ids, length)})
        hashes, starts = np.unique(np.array([h for h, _ in pairs], np.uint64), return_index=True)
        return cls(length, hashes, np.append(starts, len(pairs)), np.array([k for _, k in pairs], np.int64))

    def found(self, ids: np.ndarray) -> set[int]:
        """Numbers of the items that share a window with a text."""
        open_ = _windows(ids >= 0, self.length)
        if not len(open_):
            return set()
        hashes = rolling(ids, self.length)[open_]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.unique(at[self.hashes[at] == hashes])
        return {int(o) for i in at for o in self.owners[self.starts[i] : self.starts[i + 1]]}


@dataclass
class Block:
    """Benchmark items as word ids, and where their seeds occur."""

    vocabulary: dict[str, int]
    names: list
    items: list[np.ndarray]
    seeds: list[Seeds]
    shortest: int

    @classmethod
    def of(cls, rows: list[tuple], shortest: int) -> Block:
        """The seed of an item of fewer than ``shortest`` words is the whole item."""
        vocabulary: dict[str, int] = {}
        names, items, by_length = [], [], {}
        for name, text in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], np.int64)
            if len(ids):
                by_length.setdefault(min(shortest, len(ids)), {})[len(items)] = ids
                names.append(name)
                items.append(ids)
        return cls(vocabulary, names, items, [Seeds.of(n, part) for n, part in sorted(by_length.items())], shortest)

    def matches(self, text: str | None, coverage: float) -> tuple[float, list]:
        """(largest coverage of an item, names of the items covered enough)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words(text)), np.int64)
        best, names = 0.0, []
        for k in sorted(set().union(*(s.found(ids) for s in self.seeds))):
            item = self.items[k]
            covered = sum(n for _, _, n in tiles(ids, item, min(self.shortest, len(item)))) / len(item)
            best = max(best, covered)
            if covered >= coverage:
                names.append(self.names[k])
        return best, names


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  coverage: float = COVERAGE, shortest: int = MIN_TILE) -> DataFrame:
    """``docs`` with ``coverage`` (largest share of an item that tiles cover), ``item_ids`` and ``contaminated``.

    ``item_ids`` lists all items with at least ``coverage``. Words are lower-cased runs of letters and
    digits, so case, punctuation and spacing don't matter, and passages in another order still tile; in
    scripts without blanks every letter is a word. An item shorter than ``shortest`` words is one tile
    and must occur whole. Null texts and texts or items without a word match nothing. Whole texts are
    read; columns of these names are replaced, rows and repetitions stay.

    The benchmark goes to the tasks in blocks of at most about BLOCK_BYTES of text each, however
    large it is; every block is compared with all documents, and results are stored now and then.
    """
    spark = docs.sparkSession
    # an equal text of another item is another item; items are dealt to blocks by hash
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    id_type = benchmark.schema[item_col].dataType.simpleString()
    fields = {"coverage": "double", "item_ids": f"array<{id_type}>"}
    out = docs.withColumns({"coverage": F.lit(0.0), "item_ids": F.array().cast(f"array<{id_type}>")})
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()]
        shared = spark.sparkContext.broadcast(Block.of(rows, shortest))

        def search(batch: pa.RecordBatch, shared=shared) -> list[pa.Array]:
            block = shared.value
            best, names = batch.column("coverage").to_pylist(), batch.column("item_ids").to_pylist()
            for k, text in enumerate(batch.column(text_col)):
                share, found = block.matches(text.as_py(), coverage)
                best[k] = max(best[k], share)
                names[k] = names[k] + found
            return [pa.array(best, pa.float64()), pa.array(names, batch.schema.field("item_ids").type)]

        out = appended(out, search, fields)
        if b % 4 == 3 and b + 1 < blocks:
            out = stored(out, "contamination")
    return out.withColumn("contaminated", F.col("coverage") >= coverage)
