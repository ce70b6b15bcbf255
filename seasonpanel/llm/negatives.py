"""Hard negatives by an inverted multi-index with certified stops.

Vectors are cut into halves; each half has a codebook, and a pair of code words is a cell. A cell's score with a query is at most
the sum of two half bounds, each the product with the code word plus the query's norm times the largest distance of a
row's half from its code word. A query visits cells by that sum and stops once no later cell can change its answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import below_rate, stored

#: Rows that the codebooks are fitted on at most, about; the index holds every row.
SAMPLE = 8_000
#: Rows of a cell that are about wanted, code words of a codebook at most, and rows of a block of a cell.
CELL_ROWS, MOST_WORDS, BLOCK_ROWS = 200, 1024, 512
#: Queries of a pack, and cells that a query visits in its first round; each later round visits this many times more.
PACK, FIRST_CELLS, GROWTH = 128, 16, 8
#: A window (least, most score) that no score is in, and that no cell is visited for.
NOTHING = (1 << 61, (1 << 61) - 1)
#: The bound of a cell is raised by this part for rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """The stored blocks (cell, block, n, us, ids, labels, rows) and what every task needs to bound a cell."""

    blocks: DataFrame
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cell_blocks: dict[int, int]
    dim: int
    largest: int


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256, dim: int | None = None) -> DataFrame:
    """(id, label, v) with v = floor(scale * x) as longs, of rows with an id, a label and finite components only.

    All vectors have ``dim`` components, by default the commonest length (ties: the shortest); others take no part, nor do rows
    with a component that would let a score pass 64 bits.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).where(fine & (F.size(v) > 0))
    if dim is None:
        lengths = kept.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        dim = lengths["d"] if lengths else 1
    most = 1 << ((54 - max(0, dim - 1).bit_length()) // 2)
    kept = kept.where((F.size(v) == dim) & F.forall(v, lambda x: F.abs(x * scale) < most))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Code words of ``points``: Lloyd's rounds from ``k`` spread-out different points."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)]
    for _ in range(rounds):
        near = _nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, distance to it) of each point."""
    near = (np.sum(centres**2, axis=1) - 2 * points @ centres.T).argmin(axis=1)
    return near, np.sqrt(np.sum((points - centres[near]) ** 2, axis=1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _type(largest: int) -> str:
    return "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"


def build_index(rows: DataFrame, code_words: int | None = None) -> Index | None:
    """The index of (id, label, v); None without rows."""
    rows = stored(rows.withColumn("u", F.monotonically_increasing_id()), "mined-rows")  # from here on a row's own number
    n, dim, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_min("v")), F.abs(F.array_max("v"))))).first()
    if not n:
        return None
    k = code_words or int(min(MOST_WORDS, max(1, 1 << round(np.log2(max(1.0, np.sqrt(n / CELL_ROWS)))))))
    key = F.concat_ws(",", "v")  # equal vectors are taken or left together, so repeats can't crowd the sample out
    share = rows.select(F.xxhash64("v").alias("h"), "v").where(below_rate("h", min(1.0, SAMPLE / n), "codebook"))
    sample = share.groupBy("v").agg(F.count(F.lit(1))).orderBy(F.xxhash64(key), key).limit(2 * SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        sample = rows.orderBy(F.xxhash64(key), key).limit(1).select("v").toArrow()
    points = _matrix(sample.column("v"), dim).astype(float)
    half = dim // 2
    words = _means(points[:, :half], k), _means(points[:, half:], k)
    cells = len(words[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dim).astype(float)
            (i, di), (j, dj) = _nearest(v[:, :half], words[0]), _nearest(v[:, half:], words[1])
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("id"), b.column("label"), b.column("v"), pa.array(i * cells + j, pa.int32()), pa.array(di), pa.array(dj)], ["u", "id", "label", "v", "cell", "near", "far"])

    placed = rows.mapInArrow(assign, "u bigint, id bigint, label bigint, v array<bigint>, cell int, near double, far double")
    sums = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("near"), F.max("far").alias("far"))
    sums = stored(sums, "mined-cells")
    radii = np.zeros(len(words[0])), np.zeros(cells)
    blocks_of = {}
    for r in sums.collect():  # one row per cell, MOST_WORDS ** 2 at most
        i, j = divmod(r["cell"], cells)
        radii[0][i], radii[1][j] = max(radii[0][i], r["near"]), max(radii[1][j], r["far"])
        blocks_of[r["cell"]] = -(-r["n"] // BLOCK_ROWS)
    width = _type(largest)

    def pack(table: pa.Table) -> pa.Table:
        ids, labels, v = table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"), dim)
        u = table.column("u").to_numpy()
        order = np.lexsort((u, ids))
        binary = [np.ascontiguousarray(x[order]).astype(t).tobytes() for x, t in ((u, "<i8"), (ids, "<i8"), (labels, "<i8"), (v, width))]
        return pa.table([table.column("cell")[:1], table.column("block")[:1], pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in binary)], names=["cell", "block", "n", "us", "ids", "labels", "rows"])

    # a row's place among the blocks of its cell, by hash; the counts are one row per cell
    dealt = placed.join(sums.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("m")), "cell")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("u"), F.col("m")).cast("int")).select("cell", "block", "u", "id", "label", "v")
    blocks = dealt.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, n int, us binary, ids binary, labels binary, rows binary")
    return Index(stored(blocks, "mined-blocks"), words, radii, blocks_of, dim, int(largest))


def _queries(index: Index, every: int) -> DataFrame:
    """(q, pack, id, label, cell, block, place, v): the rows whose id is divisible by ``every``, near ones in one pack."""
    width, dim = _type(index.largest), index.dim

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                at = np.flatnonzero(ids % every == 0)
                v = np.frombuffer(r["rows"], width).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["us"], "<i8")[at]), pa.array(ids[at]), pa.array(np.frombuffer(r["labels"], "<i8")[at]), pa.array(np.full(len(at), r["cell"], np.int32)), pa.array(np.full(len(at), r["block"], np.int32)), pa.array(at.astype(np.int32)), pa.array([v[k].tobytes() for k in at], pa.binary())],
                    ["q", "id", "label", "cell", "block", "place", "v"],
                )

    found = index.blocks.mapInArrow(pick, "q bigint, id bigint, label bigint, cell int, block int, place int, v binary")
    found = stored(found, "mined-queries")
    counts = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # one row per cell
    packs, last, held = [], 0, 0
    for r in counts:  # whole neighbouring cells share a pack; a cell of more queries is split over packs of its own
        parts = -(-r["n"] // PACK)
        if held + r["n"] > PACK and held:
            last, held = last + 1, 0
        packs.append((r["cell"], last, parts))
        last, held = (last + parts, 0) if parts > 1 else (last, held + r["n"])
    table = found.sparkSession.createDataFrame(packs, "cell int, first int, parts int")
    pack = (F.col("first") + F.pmod(F.xxhash64("q"), F.col("parts"))).cast("int").alias("pack")
    return found.join(table, "cell").select("q", pack, "id", "label", "cell", "block", "place", "v")


def _cells(index: Index, query: np.ndarray, skip: int, take: int) -> Iterator[tuple[int, float]]:
    """Cells that hold rows with their bounds, the highest first: numbers ``skip`` to ``skip + take`` of them.

    Multi-sequence: code words of both halves are sorted by their bounds, and a heap holds the pairs whose smaller
    neighbours have been visited.
    """
    half = index.dim // 2
    bounds = [w @ q + np.linalg.norm(q) * r for w, r, q in zip(index.words, index.radii, (query[:half], query[half:]))]
    orders = [np.argsort(-b, kind="stable") for b in bounds]
    a, b = (x[o] for x, o in zip(bounds, orders))
    heap, seen, cells, passed = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, len(b), 0
    while heap and passed < skip + take:
        bound, i, j = heapq.heappop(heap)
        cell = int(orders[0][i]) * cells + int(orders[1][j])
        if cell in index.cell_blocks:
            if passed >= skip:
                yield cell, -bound + SLACK * (1 + abs(bound))
            passed += 1
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < cells and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[x] + b[y]), x, y))


def _requests(index: Index, open_: DataFrame, skip: int, take: int) -> DataFrame:
    """(cell, block, q, v, label, own, limits): what each query of ``open_`` still has to look at in this round, per block.

    ``open_`` has ``need``: the query is done with all cells whose bound is below it; null: with none.
    """
    light = Index(None, index.words, index.radii, index.cell_blocks, index.dim, index.largest)
    shared, width = open_.sparkSession.sparkContext.broadcast(light), _type(index.largest)
    names = ["q", "label", "own_cell", "own_block", "place", "limits"]

    def ask(table: pa.Table) -> pa.Table:
        index, wanted = shared.value, {}
        rows = table.to_pylist()
        for k, r in enumerate(rows):
            for cell, bound in _cells(index, np.frombuffer(r["v"], width).astype(float), skip, take):
                if r["need"] is not None and bound < r["need"]:
                    break
                wanted.setdefault(cell, []).append(k)
        out = [(cell, block, at) for cell, at in sorted(wanted.items()) for block in range(index.cell_blocks[cell])]
        columns = [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32())]
        for name in names:
            kind = pa.list_(pa.list_(pa.int64())) if name == "limits" else pa.int64()
            columns.append(pa.array([[rows[k][name] for k in o[2]] for o in out], pa.list_(kind)))
        columns.append(pa.array([b"".join(rows[k]["v"] for k in o[2]) for o in out], pa.binary()))
        return pa.table(columns, names=["cell", "block", *names, "v"])

    columns = open_.select("pack", "q", "label", F.col("cell").alias("own_cell"), F.col("block").alias("own_block"), "place", "limits", "v", "need")
    shape = ", ".join(f"{n} array<{'array<array<bigint>>' if n == 'limits' else 'bigint'}>" for n in names)
    return columns.groupBy("pack").applyInArrow(ask, f"cell int, block int, {shape}, v binary")


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; in doubles where these are exact."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 53:
        return np.rint(queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _looked_up(index: Index, requests: DataFrame, most: int, other_label: bool) -> DataFrame:
    """(q, slot, score, id): the best ``most`` rows per query, block and slot.

    Without ``other_label`` the rows of the query's label other than itself, in slot 0; with it the rows of
    other labels, in a slot for each pair (least, most score) of ``limits``.
    """
    width, dim = _type(index.largest), index.dim
    lowest = -(1 << 62)  # no score is that low

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {name: b.column(name)[k] for name in b.schema.names}
                ids, labels = np.frombuffer(r["ids"].as_buffer(), "<i8"), np.frombuffer(r["labels"].as_buffer(), "<i8")
                rows = np.frombuffer(r["rows"].as_buffer(), width).reshape(-1, dim)
                score = _scores(np.frombuffer(r["v"].as_buffer(), width).reshape(-1, dim), rows)
                q, label, place, cell, block = (np.array(r[name].as_py(), np.int64) for name in ("q", "label", "place", "own_cell", "own_block"))
                wrong = (label[:, None] != labels) != other_label
                own = np.flatnonzero((cell == r["cell"].as_py()) & (block == r["block"].as_py()))
                wrong[own, place[own]] = True
                score[wrong] = lowest
                order = np.argsort(-score, axis=1, kind="stable")  # rows of a block are in the order of ids
                ranked = np.take_along_axis(score, order, axis=1)
                limits = r["limits"].as_py() if other_label else [[[lowest + 1, -lowest]]] * len(q)
                slots = max(map(len, limits))
                limits = np.array([x + [list(NOTHING)] * (slots - len(x)) for x in limits], np.int64)
                out = [[], [], [], []]
                for slot in range(limits.shape[1]):
                    low, high = limits[:, slot, :1], limits[:, slot, 1:]
                    first = (ranked > high).sum(axis=1)
                    for step in range(min(most, ranked.shape[1])):
                        at = np.minimum(first + step, ranked.shape[1] - 1)
                        s = ranked[np.arange(len(q)), at]
                        good = (first + step < ranked.shape[1]) & (s >= low[:, 0]) & (s > lowest)
                        for column, values in zip(out, (q, np.full(len(q), slot), s, ids[order[np.arange(len(q)), at]])):
                            column.append(values[good])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["q", "slot", "score", "id"])

    joined = requests.join(index.blocks, ["cell", "block"])
    found = joined.mapInArrow(look, "q bigint, slot bigint, score bigint, id bigint")
    return _best(found, most)


def _best(found: DataFrame, most: int) -> DataFrame:
    # equal (score, id) are copies of one row with another place in the index: all count
    order = Window.partitionBy("q", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def _search(index: Index, queries: DataFrame, most: int, other_label: bool, label: str) -> DataFrame:
    """(q, slot, score, id), the best ``most`` rows of each query and slot over all cells that can hold one.

    A query is certified in a slot once it has ``most`` rows and the next cell's bound is below the last of
    these, or once that bound is below the least score allowed. It goes on till all its slots are.
    """
    total, seen, take, best = len(index.cell_blocks), 0, FIRST_CELLS, None
    floor = F.array_min(F.transform("limits", lambda x: x[0])) if other_label else F.lit(None).cast("long")
    while seen < total:
        open_ = queries.withColumn("floor", floor)
        if best is not None:
            last = best.groupBy("q", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
            full = last.where(F.col("n") == most).groupBy("q").agg(F.collect_list(F.struct("slot", "last")).alias("full"))
            open_ = open_.join(full, "q", "left")
            slots = F.size("limits") if other_label else F.lit(1)
            least = F.transform(F.sequence(F.lit(0), slots - 1), lambda s: F.coalesce(F.get(F.filter("full", lambda x: x["slot"] == s), F.lit(0))["last"], F.col("limits")[s][0] if other_label else F.lit(None).cast("long")))
            need = F.when(F.exists(least, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_min(least))
            open_ = open_.withColumn("need", F.coalesce(need, "floor"))
        else:
            open_ = open_.withColumn("need", F.col("floor"))
        asked = stored(_requests(index, open_, seen, take), f"mined-{label}-asked")
        if asked.isEmpty():
            break
        found = _looked_up(index, asked, most, other_label)
        best = stored(_best(best.unionByName(found), most) if best is not None else found, f"mined-{label}")
        seen, take = seen + take, take * GROWTH
    return best


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, code_words: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, ids divisible by ``every``.

    An anchor's positives are its ``positives`` best other rows of the same label, by integer inner product (ties: the
    smaller id). A positive's negatives are the best ``negatives`` rows of other labels whose score is between ``least``
    and ``most`` per cent of the positive's, both included. All rows are searched: a cell is left out only when its bound
    shows that no row of it can change the answer.

    Rows without an id, a label or a vector, or with a null, NaN or infinite component, take no part, nor do vectors of an
    uncommon length (see ``quantised``). Repeated rows and ids are rows of their own: a copy of an anchor is its positive, and every
    copy of an anchor is an anchor. No rows, or one label only, give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    index = build_index(quantised(rows, id_col, label_col, vector_col, scale), code_words)
    if index is None:
        return empty
    queries = _queries(index, every)
    none = F.lit(None).cast("array<array<bigint>>")
    near = _search(index, queries.withColumn("limits", none), positives, False, "positives")
    if near is None:
        return empty

    # scores are whole numbers, so the window is one of whole numbers too
    ordered = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))).alias("p"))
    low = F.transform("p", lambda x: F.ceil(x["score"].cast("decimal(20,0)") * least / 100).cast("long"))
    high = F.transform("p", lambda x: F.floor(x["score"].cast("decimal(20,0)") * most / 100).cast("long"))
    ordered = stored(ordered.select("q", "p", F.zip_with(low, high, lambda a, b: F.when(a <= b, F.array(a, b)).otherwise(F.array(*map(F.lit, NOTHING)))).alias("limits")), "mined-limits")
    found = _search(index, queries.join(ordered.select("q", "limits"), "q"), negatives, True, "negatives")
    if found is None:
        return empty
    rank = F.row_number().over(Window.partitionBy("q", "slot").orderBy(F.col("score").desc(), "id"))
    pairs = ordered.join(queries.select("q", F.col("id").alias("anchor_id")), "q").select("q", "anchor_id", F.posexplode("p").alias("slot", "x"))
    pairs = pairs.select("q", "anchor_id", F.col("slot").cast("long").alias("slot"), F.col("x.id").alias("positive_id"), F.col("x.score").alias("positive_score"))
    out = found.withColumn("rank", rank).withColumnsRenamed({"score": "negative_score", "id": "negative_id"}).join(pairs, ["q", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
