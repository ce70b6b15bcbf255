"""Near copies by the Jaccard similarity of their word shingles: MinHash bands, then the true similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, components, discarded, stored
from .simhash import kept_rows, links, simhash

#: Words of a shingle, and the similarity from which two texts are near copies, as a fraction.
WORDS = 5
SIMILAR = (4, 5)
#: Bands of minima. Two texts of similarity 0.8 share none with probability (1 - 0.8**ROWS)**BANDS, 7e-4.
BANDS, ROWS = 24, 6
SEED = 42
#: Shingles whose minima are taken at once.
BLOCK = 1 << 12
#: Smallest shingles of a text that are compared inside tasks, and the per cent of them in common from which
#: longer texts are then compared whole: 4 standard deviations below 0.8.
SKETCH, LIKELY = 256, 70
#: Texts of a block of a band, and shingles that are looked at together.
BLOCK_TEXTS, COLUMNS = 256, 4096

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted XXH64 values of the distinct word shingles, as signed longs.

    Words are lower-cased in A-Z only and split at ASCII white space. Fewer words than
    ``words``: the whole sequence is one shingle. No word, or null: none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    hashed = xxhash.xxh64_intdigest
    found = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)
    return np.unique(found.view(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One long per band: the hash of the band's number and its minima over the shingles ``found``."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    h = found.view(np.uint64)
    for at in range(0, len(h), BLOCK):
        np.minimum(least, ((h[at : at + BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    parts = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def _node(found: np.ndarray) -> int:
    """The hash of a whole shingle set; texts with the same set are one node."""
    h = xxhash.xxh64_intdigest(found.astype("<i8").tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketched(docs: DataFrame, text_col: str, words: int = WORDS) -> DataFrame:
    """``docs`` with ``_fp`` (the node), ``_size`` (number of shingles), ``_sim`` (SimHash) and ``_keys`` (one per band)."""

    def sketch(batch: pa.RecordBatch) -> list[pa.Array]:
        nodes, sizes, sims, keys = [], [], [], []
        for t in batch.column(text_col):
            found = shingles(t.as_py(), words)
            nodes.append(_node(found))
            sizes.append(len(found))
            sims.append(simhash(found))
            keys.append(band_keys(found))
        return [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sims, pa.int64()), _lists(keys)]

    return appended(docs, sketch, {"_fp": "bigint", "_size": "int", "_sim": "bigint", "_keys": "array<bigint>"})


def _sets(texts: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, found): the shingles of each node of ``texts``."""

    def sets(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [shingles(t.as_py(), words) for t in batch.column(text_col)]
        return [pa.array([_node(x) for x in found], pa.int64()), _lists(found)]

    return appended(texts.select(text_col), sets, {"node": "bigint", "found": "array<bigint>"}).select("node", "found").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of SIMILAR at least, in whole numbers."""
    a, b = SIMILAR
    left = sets.select(F.col("node").alias("u"), F.col("found").alias("_left"))
    right = sets.select(F.col("node").alias("v"), F.col("found").alias("_right"))
    both = F.size(F.array_intersect("_left", "_right"))
    enough = both * (a + b) >= (F.size("_left") + F.size("_right")) * a
    return pairs.join(left, "u").join(right, "v").where(enough).select("u", "v")


def _cell_links(lists: list[np.ndarray], size: np.ndarray, root: np.ndarray, allowed: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(sure, open): pairs of positions that are linked, and that may be; of those ``allowed``.

    ``lists`` has the SKETCH smallest shingles of each text. If they are all it has, the similarity
    is exact, and only pairs that join two components (``root``, then the links found here) are
    listed. Else the common part of the smallest shingles of both estimates it.
    """
    a, b = SIMILAR
    n = len(lists)
    whole = size <= SKETCH
    last = np.array([np.iinfo(np.int64).max if w or not len(x) else x[-1] for x, w in zip(lists, whole)])
    upto = np.stack([np.searchsorted(x, last, "right") for x in lists])
    values, place, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[place]
    line = np.repeat(np.arange(n), [len(x) for x in lists])
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    line, column = line[order], column[order]
    for at in range(0, int((often > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        marks = np.zeros((n, COLUMNS), np.float32)
        marks[line[lo:hi], column[lo:hi] - at] = 1
        common += marks @ marks.T
    common = np.rint(common).astype(np.int64)
    union = upto + upto.T - common
    exact = whole[:, None] & whole[None, :]
    close = np.minimum(size[:, None], size[None, :]) * b >= np.maximum(size[:, None], size[None, :]) * a
    likely = allowed & close & np.where(exact, common * b >= union * a, common * 100 >= union * LIKELY)
    likely = np.triu(likely, 1)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    sure, open_ = [], []
    for i, j in np.argwhere(likely & exact).tolist():
        x, y = find(int(root[i])), find(int(root[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            sure.append((i, j))
    for i, j in np.argwhere(likely & ~exact).tolist():
        if find(int(root[i])) != find(int(root[j])):
            open_.append((i, j))
    return sure, open_


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """(u, v, sure): the pairs that ``_cell_links`` finds in a cell: two blocks of a band, or one with itself."""
    table = table.sort_by("node")
    node, root, block, size = (table.column(c).to_numpy() for c in ("node", "root", "block", "size"))
    flat = table.column("found").combine_chunks()
    lists = np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])
    lo, hi = key[1].as_py(), key[2].as_py()
    allowed = (root[:, None] != root[None, :]) & (np.minimum(block[:, None], block[None, :]) == lo) & (np.maximum(block[:, None], block[None, :]) == hi)
    sure, open_ = _cell_links(lists, size.astype(np.int64), root, allowed)
    both = np.array(sure + open_, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(node[both].max(axis=1)), "v": pa.array(node[both].min(axis=1)), "sure": pa.array([True] * len(sure) + [False] * len(open_), pa.bool_())})


def _cells(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, sure): what is left to link in each band of ``rows`` (key, node, root).

    In a band, the component with most texts needs no comparison with itself. Its texts, and
    the others, are dealt to blocks of about BLOCK_TEXTS by hash; two blocks meet in one cell,
    so a large band is spread over many tasks, and only links leave a cell.
    """
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    bands = by_root.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most")).where("most.m < n")
    blocks = lambda c: F.ceil(c / BLOCK_TEXTS).cast("long")
    bands = bands.select("key", F.col("most.root").alias("_main"), blocks(F.col("n") - F.col("most.m")).alias("_own"), blocks(F.col("most.m")).alias("_others"))
    dealt = rows.join(bands, "key").withColumn("_rest", F.col("root") != F.col("_main"))
    block = F.when(F.col("_rest"), F.pmod(F.xxhash64("node"), "_own")).otherwise(F.col("_own") + F.pmod(F.xxhash64("node"), "_others"))
    meets = F.when(F.col("_rest"), F.col("_own") + F.col("_others")).otherwise(F.col("_own"))
    least = sets.select("node", F.size("found").alias("size"), F.slice("found", 1, SKETCH).alias("found"))
    dealt = dealt.select("key", "node", "root", block.alias("block"), meets.alias("_meets")).join(least, "node")
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_meets") - 1)))
    met = met.select("key", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "node", "root", "block", "size", "found")
    return met.groupBy("key", "lo", "hi").applyInArrow(_cell, "u bigint, v bigint, sure boolean")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes whose SimHash fingerprints of the same shingles differ in at most two bits.

    Each fingerprint's smallest node stands for it: the others are paired with it, and it with those
    of the fingerprints that :func:`simhash.links` finds, so no pairs of a group of equal fingerprints are listed.
    """
    first = stored(nodes.groupBy("sim").agg(F.min("node").alias("first")), "near-prints")
    same = nodes.join(first, "sim").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(first.select(F.col("sim").alias("fp")))
    near = near.join(first.select(F.col("sim").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("sim").alias("v"), F.col("first").alias("b")), "v")
    both = same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def similar_roots(nodes: DataFrame, docs: DataFrame, text_col: str, words: int = WORDS) -> DataFrame:
    """(node, root) of all nodes that have a link; ``nodes`` has node, size, sim, keys and the mark of one of its texts.

    Candidates are texts with near SimHash fingerprints and texts that share a band. First each band has one text as its centre, the one that shares bands with most others, and
    all texts of the band are compared with it. So most of a large group of near copies falls into one
    component, and no pairs of the group are listed. Then the texts of a band that are in different
    components are compared inside tasks (``_cells``). Tables are deleted when nothing reads them any more.
    """
    a, b = SIMILAR
    spread = nodes.select("node", "size", "_mark", F.explode("keys").alias("key"))
    counts = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    table = stored(spread.join(counts, "key"), "near-bands")
    prints = stored(_simhash_pairs(nodes), "near-simhash")
    if table.isEmpty() and prints.isEmpty():
        return nodes.select("node", F.col("node").alias("root"))
    ends = prints.select("u", "v").unpivot([], ["u", "v"], "_end", "node").select("node")
    wanted = table.select("_mark").unionByName(nodes.join(ends, "node", "left_semi").select("_mark")).distinct()
    texts = docs.select(text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark")).join(wanted, "_mark", "left_semi")
    sets = stored(_sets(texts, text_col, words), "near-sets")
    reach = table.groupBy("node").agg(F.sum("n").alias("reach"))
    centres = table.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node", "size")).alias("c"))
    centres = stored(centres.select("key", F.col("c.node").alias("v"), F.col("c.size").alias("_n")), "near-centres")
    close = F.least("size", "_n") * b >= F.greatest("size", "_n") * a
    pairs = table.select("key", F.col("node").alias("u"), "size").join(centres, "key").where(F.col("u") != F.col("v")).where(close)
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(prints).distinct()
    sure = stored(_verified(pairs, sets), "near-links")
    roots = stored(components(sure, "near-components"), "near-roots")
    discarded(sure)
    # what is left has two texts, none of them the centre, in different components
    now = table.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = now.join(centres, "key").where(F.col("node") != F.col("v")).groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
    rows = stored(now.join(ends.select("key"), "key"), "near-open")
    found = stored(_cells(rows, sets).groupBy("u", "v").agg(F.max("sure").alias("sure")), "near-found")
    more = found.where("sure").select("u", "v").unionByName(_verified(found.where(~F.col("sure")).select("u", "v"), sets))
    last = stored(components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "near-components"), "near-roots")
    for table in (table, prints, sets, centres, roots, rows, found):
        discarded(table)
    return last


def near_copies_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id.

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of at least 0.8 are linked,
    and a group is all that links reach. Empty texts and nulls are one group. Of rows that share the
    smallest id, and of groups without any id, one row stays, the one whose text has the smallest hash.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark")
    rows = stored(sketched(docs.select(F.col(id_col).alias("_id"), mark, text_col), text_col, words).select("_id", "_mark", "_fp", "_size", "_sim", "_keys"), "near")
    nodes = rows.groupBy(F.col("_fp").alias("node")).agg(F.min("_mark").alias("_mark"), F.first("_size").alias("size"), F.first("_sim").alias("sim"), F.first("_keys").alias("keys"), F.min("_id").alias("least_id"))
    nodes = stored(nodes, "near-nodes")
    roots = similar_roots(nodes, docs, text_col, words)
    member = nodes.join(roots, "node", "left").select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("root"), "least_id")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return kept_rows(docs, rows.select("_id", "_mark", "_fp"), member.join(least, "root").select("fp", "root", "component_id"), id_col, mark)
