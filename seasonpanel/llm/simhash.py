"""Near-duplicate groups from SimHash fingerprints, found by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import appended, components, stored

#: Widths of the fingerprint's segments, from the lowest bit.
SEGMENTS = (16, 16, 16, 16)
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over the XXH64 values of all word shingles, repeats included.

    Words are lower-cased in A-Z only and split at ASCII white space. Fewer words than
    ``words``: the whole sequence is one shingle. No word, or null: 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[-n:].tolist()
    first = starts[:n].tolist()
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of hashed shingles, as a signed long; 0 for none. A bit is set if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at : at + BLOCK].astype("<i8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, fp_col: str = "fp") -> DataFrame:
    """``docs`` with each text's fingerprint as a signed long."""

    def prints(batch: pa.RecordBatch) -> list[pa.Array]:
        found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(text_col)), np.uint64, batch.num_rows)
        return [pa.array(found.view(np.int64))]

    return appended(docs, prints, {fp_col: "long"})


def ball_masks(segments: tuple[int, ...] = SEGMENTS, radius: int = 1) -> list[int]:
    """Masks that move a fingerprint inside Hamming balls of ``radius``, segment by segment.

    Radius 1 moves one segment at a time, 64 neighbours and the fingerprint itself. Radius 2
    adds two moves in one segment and one move in each of two segments.
    """
    bits, at = [], 0
    for width in segments:
        bits.append([1 << i for i in range(at, at + width)])
        at += width
    if at != 64:
        raise ValueError("the segments must hold 64 bits")
    flat = [b for segment in bits for b in segment]
    masks = [0] + (flat if radius else []) + [a | b for a, b in combinations(flat, 2)] * (radius > 1)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all pairs within ``bits`` bits.

    Each fingerprint enters the table under every member of its small balls: one segment moved,
    the other segments as they are. Two fingerprints within ``bits`` = 2 * radius bits meet at
    the value halfway between them, and all that meet at a value are within ``bits`` of each
    other. So each is linked to the smallest at that value, after its complete distance is
    verified: no pairs of a bucket are listed, and a bucket has at most one member per mask.
    """
    if bits not in (0, 2, 4):
        raise ValueError("bits must be 0, 2 or 4")
    moves = F.explode(F.array(*[F.lit(m) for m in ball_masks(radius=bits // 2)])).alias("mask")
    table = fps.select("fp", moves).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    met = table.withColumn("least", F.min("fp").over(Window.partitionBy("at"))).where("least <> fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= bits
    return met.where(near).select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def group_labels(rows: DataFrame, id_col: str, fp_col: str = "fp", bits: int = 2) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``rows``."""
    nodes = rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least_id"))
    roots = components(links(nodes.select("fp"), bits), "simhash-links")
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return member.join(least, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; component_id is the smallest id reachable over links.

    Fingerprints that differ in at most ``bits`` bits are linked. Equal fingerprints are one node,
    so copies cost nothing in the search. Empty texts share fingerprint 0 and are one group. Rows
    with a null id take part; component_id is null only if no row of the group has an id. Repeated
    rows stay. Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    rows = stored(with_fingerprint(docs.select(id_col, text_col), text_col, words).select(id_col, "fp"), "simhash")
    return rows.join(group_labels(rows, id_col, bits=bits).drop("root"), "fp").select(id_col, "fp", "component_id")


def simhash_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """One row of each group of :func:`simhash_groups`, with all its columns: the one with the smallest id.

    Of rows that share that id, and of groups without any id, one row stays, the one whose text has
    the smallest hash.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark")
    slim = with_fingerprint(docs.select(id_col, text_col, mark), text_col, words, "_fp")
    rows = stored(slim.select(F.col(id_col).alias("_id"), "_mark", "_fp"), "simhash")
    return kept_rows(docs, rows, group_labels(rows, "_id", "_fp", bits), id_col, mark)


def kept_rows(docs: DataFrame, rows: DataFrame, labels: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The row of ``docs`` that stays of each group: ``rows`` has _id, _mark, _fp; ``labels`` is as in :func:`group_labels`."""
    least = rows.join(labels, rows["_fp"] == labels["fp"]).where(F.col("_id").eqNullSafe(F.col("component_id")))
    winners = stored(least.groupBy("root").agg(F.min(F.struct("_mark", "_id")).alias("w"), F.count(F.lit(1)).alias("n")).select("w._id", "w._mark", "n"), "simhash-kept")
    marked = docs.withColumn("_mark", mark)
    kept = marked.join(winners, marked[id_col].eqNullSafe(winners["_id"]) & (marked["_mark"] == winners["_mark"]), "left_semi")
    if not winners.where("n > 1").isEmpty():  # rows with the same id and text
        order = Window.partitionBy(id_col, "_mark").orderBy("_mark")
        kept = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return kept.select(*docs.columns)
