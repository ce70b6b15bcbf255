"""Mixing sources to target weights: exact block quotas, split among shards by a hypergeometric tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, appended, sliced
from .feistel import permute

#: Weights of the sources in order of their names, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of a block, and of an output shard on average.
BLOCK_WORDS = 256
SHARD_WORDS = 1 << 22
#: Words of one part of a source in which places are counted; the number of parts follows the data.
PART_WORDS = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text_col: str = "text"):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^" + SPACE[1:] + "+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words each source should give: ``share`` of all words by weight, at most ``cap`` times its size.

    Sources are weighed in code point order, null last. What a capped source cannot give is shared
    again by weight among the others until no target is above its cap.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass
class Quota:
    """What is drawn of one source: ``full`` whole passes, then ``blocks`` blocks and ``rest`` words."""

    index: int
    size: int
    target: float
    block: int
    full: int = field(init=False)
    blocks: int = field(init=False)
    rest: int = field(init=False)

    def __post_init__(self):
        words = int(self.target + 0.5)
        self.full, left = divmod(words, self.size) if self.size else (0, 0)
        self.blocks, self.rest = divmod(left, self.block)

    @property
    def whole(self) -> int:
        """Blocks of full length in a pass; the shorter tail is always the last in order."""
        return self.size // self.block

    @property
    def per_pass(self) -> int:
        return self.whole + (self.size % self.block > 0)

    @property
    def drawn(self) -> int:
        return self.full * self.per_pass + self.blocks + (self.rest > 0)


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric draw; beyond 1e9 blocks in two strata of half the blocks each."""
    if counts.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    low = counts // 2
    take = min(n // 2, int(low.sum()))
    take = max(take, n - int((counts - low).sum()))
    return _draw(rng, low, take) + _draw(rng, counts - low, n - take)


class SplittingTree:
    """Deals every source's drawn blocks to ``shards`` shards whose block counts differ by at most 1.

    A node holds a range of shards and the block count of each source. Its left half's composition
    is drawn without replacement from the node's blocks, with a seed of the node's own, so any task
    finds the same split without a table of all shards: it walks only the nodes its blocks reach.
    The left half takes the first blocks in a source's order, the right half the others.
    """

    def __init__(self, drawn: np.ndarray, shards: int, seed: int):
        self.drawn, self.shards, self.seed = drawn, shards, seed
        self.total = int(drawn.sum())
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def _before(self, shard: int) -> int:
        return shard * (self.total // self.shards) + min(shard, self.total % self.shards)

    def shard_of(self, source: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        todo = [(0, self.shards, self.drawn, np.arange(len(order)), order)]
        while todo:
            lo, hi, counts, rows, at = todo.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            mid = (lo + hi) // 2
            left = self.known.get((lo, hi))
            if left is None:
                rng = np.random.default_rng([self.seed, lo, hi])
                left = self.known[lo, hi] = _draw(rng, counts, self._before(mid) - self._before(lo))
            goes = at < left[source[rows]]
            todo.append((lo, mid, left, rows[goes], at[goes]))
            todo.append((mid, hi, counts - left, rows[~goes], at[~goes] - left[source[rows[~goes]]]))
        return out


def _pieces(source: np.ndarray, start: np.ndarray, size: np.ndarray, quotas: list[Quota], tree: SplittingTree, seed: int):
    """(row, pass, first word, end word, shard, place) of everything that is taken of the rows."""
    block = quotas[0].block if quotas else BLOCK_WORDS
    first, last = start // block, (start + np.maximum(size, 1) - 1) // block
    many = np.where(size > 0, last - first + 1, 0)
    row = np.repeat(np.arange(len(size)), many)
    number = np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    found = []
    for q in quotas:
        own = np.flatnonzero(source[row] == q.index)
        if not len(own):
            continue
        r, b = row[own], number[own]
        order = np.full(len(b), q.whole)
        inner = b < q.whole
        order[inner] = permute(b[inner], q.whole, seed + q.index) if inner.any() else 0
        lo = np.maximum(b * block, start[r])
        for turn in range(q.full + 1):
            end = np.minimum((b + 1) * block, start[r] + size[r])
            if turn == q.full:
                end = np.where(order < q.blocks, end, np.where(order == q.blocks, np.minimum(end, b * block + q.rest), 0))
            take = np.flatnonzero(end > lo)
            place = turn * q.per_pass + order[take]
            rt = r[take]
            shard = tree.shard_of(np.full(len(take), q.index), place)
            mixed = permute(place, max(q.drawn, 1), seed ^ 0x5DEECE66D ^ q.index)
            found.append(np.stack([rt, np.full(len(take), turn), lo[take] - start[rt], end[take] - start[rt], shard, mixed]))
    out = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
    return out[:, np.lexsort((out[2], out[1], out[0]))].astype(np.int64)


@dataclass
class Placed:
    """Rows with ``_source``, ``_start`` (their place in the source's stream), and how much is drawn."""

    rows: DataFrame
    index: dict[str | None, int]
    quotas: list[Quota]
    tree: SplittingTree
    size_col: str
    seed: int

    def pieces(self, batch: pa.RecordBatch):
        source = np.array([self.index[s] for s in batch.column("_source").to_pylist()], np.int64)
        start = batch.column("_start").to_numpy(zero_copy_only=False)
        size = batch.column(self.size_col).to_numpy(zero_copy_only=False)
        return source, _pieces(source, start, size, self.quotas, self.tree, self.seed)


def _place(docs: DataFrame, id_col: str, source_col: str, size_col: str, weights: tuple[float, ...], share: float, cap: float, block_words: int, shard_words: int, seed: int) -> Placed:
    """Only one line per source comes to the driver. Places in a stream are counted inside parts of
    a source, so that a source with most of the rows is many tasks."""
    docs = docs.withColumn(size_col, F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(size_col))
    keyed = docs.withColumns({"_source": F.col(source_col), "_h": h})
    slim = keyed.select("_source", "_h", size_col)
    sizes = {r["_source"]: r["s"] for r in slim.groupBy("_source").agg(F.sum(size_col).alias("s")).collect()}
    goal = targets(sizes, weights, share, cap)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    quotas = [Quota(i, sizes[s], goal[s], block_words) for i, s in enumerate(names)]
    shards = max(1, -(-int(sum(goal.values())) // shard_words))
    parts = max(1, -(-max(sizes.values(), default=0) // PART_WORDS))
    part = F.pmod(F.col("_h"), F.lit(parts))
    sums = slim.groupBy("_source", part.alias("_part")).agg(F.sum(size_col).alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_part").orderBy("_h", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_part", part).withColumn("_before", F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    placed = placed.withColumn("_start", F.col("_base") + F.col("_before")).drop("_h", "_part", "_s", "_p", "_base", "_before")
    tree = SplittingTree(np.array([q.drawn for q in quotas], np.int64), shards, seed)
    return Placed(placed, {s: i for i, s in enumerate(names)}, quotas, tree, size_col, seed)


PIECES = "array<struct<pass:int,first:bigint,end:bigint,shard:bigint,place:bigint>>"


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[float, ...] = WEIGHTS,
             share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 1) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``pieces``: what the mix takes of each row.

    A source's rows, in a hashed order, form one stream of words that is cut into blocks of
    ``block_words``. The target is met to the word: whole passes over the stream, then blocks in a
    keyed permutation, the last one cut. A piece is the part of a block inside a row (words first
    to end of that row, in ``pass``), its output shard and its place in the local shuffle. No row
    is taken more than ``cap`` times, rounded up to whole passes.

    Null sources are one source, weighed last; a null size counts as 0 and gives no pieces; repeated
    rows are taken like others. Columns of these names are replaced; an empty table gives no rows.
    """
    placed = _place(docs.drop("source_size", "target", "pieces"), id_col, source_col, size_col, weights, share, cap, block_words, shard_words, seed)

    def draw(batch: pa.RecordBatch) -> list[pa.Array]:
        source, (row, *values) = placed_parts.pieces(batch)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        names = ["pass", "first", "end", "shard", "place"]
        flat = pa.StructArray.from_arrays([pa.array(v, pa.int32() if n == "pass" else pa.int64()) for n, v in zip(names, values)], names)
        sizes = [placed_parts.quotas[i].size for i in source]
        goals = [float(placed_parts.quotas[i].target) for i in source]
        return [pa.array(sizes, pa.int64()), pa.array(goals, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]

    placed_parts = replace(placed, rows=None)
    out = appended(placed.rows, draw, {"source_size": "bigint", "target": "double", "pieces": PIECES})
    return out.drop("_source", "_start")


def taken():
    """Words taken of a row, repeats counted."""
    return F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["end"] - p["first"])


def mix_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
              share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 1) -> DataFrame:
    """The mix itself: one row per row of ``docs`` and pass that takes words of it, with these words as its text.

    The words are those of :func:`mix_plan` with sizes in words. A row that is taken whole keeps its
    text as it is; otherwise its pieces, neighbours joined, stand on lines of their own. The rows of
    a shard stand together, in the order of the local shuffle; a row that several shards draw from
    stands in the first one's.
    """
    columns = docs.columns
    placed = _place(docs.withColumn("_size", word_count(text_col)), id_col, source_col, "_size", weights, share, cap, block_words, shard_words, seed)
    parts = replace(placed, rows=None)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def cut(batches):
        for whole in batches:
            for batch in sliced(whole):
                _, (row, turn, first, end, shard, place) = parts.pieces(batch)
                texts, sizes = batch.column(text_col), batch.column("_size")
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (turn[1:] != turn[:-1])])) if len(row) else row
                out = []
                for a, b in zip(start, np.append(start[1:], len(row))):
                    # neighbours joined: a run ends where the next piece does not follow on
                    gap = np.flatnonzero(first[a + 1 : b] != end[a : b - 1]) + a
                    runs = list(zip(first[np.append(a, gap + 1)].tolist(), end[np.append(gap, b - 1)].tolist()))
                    text = texts[int(row[a])].as_py()
                    if runs != [(0, sizes[int(row[a])].as_py())]:
                        spans = [m.span() for m in _WORD.finditer(text)]
                        text = "\n".join(text[spans[x][0] : spans[y - 1][1]] for x, y in runs)
                    out.append(text)
                rows = pa.array(row[start])
                new = {text_col: pa.array(out, pa.string()), "_shard": pa.array(shard[start]), "_place": pa.array(place[start])}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c).take(rows) for c in [*columns, "_shard", "_place"]], [*columns, "_shard", "_place"])

    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "_shard long", "_place long"])
    mixed = placed.rows.mapInArrow(cut, shape)
    return mixed.repartition("_shard").sortWithinPartitions("_shard", "_place").drop("_shard", "_place")
