"""Exact deduplication of a batch against an immutable snapshot, screened by binary-fuse filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, scratch, stored

#: Keys one filter is built for, on average; the number of filters follows the snapshot.
KEYS_PER_FILTER = 200_000
FILTER_SCHEMA = "bucket int, seed long, segment int, segments int, prints binary"


# -- the filter ---------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashed: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three table places per key, in three neighbouring segments of the table."""
    base = ((hashed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    offsets = [hashed & mask, (hashed >> np.uint64(16)) & mask, _mix(hashed, 0x9E3779B9) & mask]
    return np.stack([(base + np.uint64(j)) * np.uint64(segment) + o for j, o in enumerate(offsets)]).astype(np.int64)


def _print_of(hashed: np.ndarray) -> np.ndarray:
    return (_mix(hashed, 0x2545F491) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, prints) of a static filter over distinct 64-bit ``keys``.

    Keys are hashed to three neighbouring segments and peeled in rounds: all places that one key
    alone uses are taken at once. Prints have 16 bits, so about one foreign key in 65,536 passes.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    size = max(16, int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))))
    segment = 1 << int(np.clip(np.log(max(n, 2)) / np.log(3.33) + 2.25, 2, 18))
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 200):
        hashed = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        place = _places(hashed, segment, segments)
        table = (segments + 2) * segment
        count = np.bincount(place.ravel(), minlength=table)
        holds = np.zeros(table, np.int64)
        np.bitwise_xor.at(holds, place.ravel(), np.tile(np.arange(n), 3))
        rounds, left = [], n
        free = np.flatnonzero(count == 1)
        while len(free):
            key, first = np.unique(holds[free], return_index=True)
            rounds.append((key, free[first]))
            left -= len(key)
            touched = place[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(holds, touched, np.tile(key, 3))
            touched = np.unique(touched)
            free = touched[count[touched] == 1]
        if left == 0:
            prints = np.zeros(table, np.uint16)
            wanted = _print_of(hashed)
            for key, at in reversed(rounds):
                p = place[:, key]
                prints[at] = 0
                prints[at] = wanted[key] ^ prints[p[0]] ^ prints[p[1]] ^ prints[p[2]]
            return seed, segment, segments, prints.tobytes()
        if seed % 10 == 0:
            segments += max(1, segments // 10)
    raise ValueError("no filter could be built")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    """True for each key that the filter may hold; never false for one that it holds."""
    hashed = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    table = np.frombuffer(prints, np.uint16)
    p = _places(hashed, segment, segments)
    return (table[p[0]] ^ table[p[1]] ^ table[p[2]]) == _print_of(hashed)


# -- the operator -------------------------------------------------------------------------


def normalised(text_col: str = "text"):
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE_CHARS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, chars) per row: SHA-256 of the normalised text and code points of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.sha2(normalised(text_col).cast("binary"), 256).alias("digest"), F.char_length(text).cast("long").alias("chars"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _key():
    return F.xxhash64(F.lit("fuse"), F.col("digest"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter row per bucket of the snapshot's distinct digests; a table to be kept with it."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = build_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(key[0], seed, segment, segments, prints)], columns=["bucket", "seed", "segment", "segments", "prints"])

    return groups.select(_bucket(buckets).alias("bucket"), _key().alias("key")).groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screened(batch_groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``batch_groups`` with ``maybe``: false only for digests the snapshot surely lacks."""

    def test(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(left), bool)
        for f in right.itertuples():
            maybe |= may_contain(left["key"].to_numpy(np.int64).view(np.uint64), f.seed, f.segment, f.segments, f.prints)
        return left.drop(columns=["bucket", "key"]).assign(maybe=maybe)

    left = batch_groups.withColumns({"bucket": _bucket(buckets), "key": _key()})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch_groups.schema)
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, f"{fields}, maybe boolean")


def _summary(rows: DataFrame, id_col: str) -> DataFrame:
    """One row per digest: size and the row that stays (most code points, then smallest id, null last)."""
    return rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.col("chars")).alias("c"), F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"))).alias("best"),
    )


def exact_dedup(snapshot: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest, in_snapshot) per row of the snapshot and of the batch.

    Texts are equal when identical without ASCII white space. The snapshot's distinct digests are
    frozen into one static filter per bucket. Distinct digests of the batch are screened: those the
    filter rejects are new and grouped among themselves only; positives join the snapshot's groups
    by digest, and their rows are compared with the snapshot's text byte by byte. A row whose bytes
    differ in spite of its digest forms a group of its own digest mark.

    Equal rows: the one with most code points, then the smallest id stays; a null id loses against
    any other, rows that tie in all of this share ``kept``. Null text counts as empty. Copies
    are summed on the map side before the shuffle, so a large group is one row. Other columns are
    ignored; empty tables give no rows.
    """
    sides = [df.select(id_col, text_col) for df in (snapshot, batch)]
    old, new = (stored(digests(df, id_col, text_col), "exact-rows") for df in sides)
    old_groups, new_groups = stored(_summary(old, id_col), "exact-groups"), _summary(new, id_col)
    buckets = old_groups.count() // KEYS_PER_FILTER + 1
    filters = stored(snapshot_filters(old_groups, buckets), "exact-filters")
    seen = stored(screened(new_groups, filters, buckets), "exact-screened")

    # bytes of the snapshot's row against those of every batch row with a digest that passed
    passed = seen.where("maybe").join(old_groups.select("digest", F.col("best.i").alias("old_id")), "digest")
    text = F.col("text_of")
    mine = sides[1].select(F.col(id_col), normalised(text_col).alias("text_of"))
    mine = mine.withColumn("digest", F.sha2(text.cast("binary"), 256)).join(passed.select("digest"), "digest", "left_semi")
    theirs = sides[0].select(F.col(id_col).alias("old_id"), normalised(text_col).alias("old_text"))
    theirs = theirs.withColumn("digest", F.sha2(F.col("old_text").cast("binary"), 256))
    theirs = theirs.join(passed.select("digest", "old_id"), (theirs.digest == passed.digest) & theirs.old_id.eqNullSafe(passed.old_id), "left_semi")
    theirs = theirs.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("old_id"))).where("r = 1").select("digest", "old_text")
    odd = mine.join(theirs, "digest").where("text_of <> old_text").select(id_col, "digest", F.concat_ws("#", "digest", F.xxhash64(text).cast("string")).alias("mark"))
    odd = stored(odd, "exact-odd")
    if not odd.isEmpty():
        apart = new.join(odd, (new[id_col].eqNullSafe(odd[id_col])) & (new.digest == odd.digest), "left")
        new = stored(apart.select(new[id_col], F.coalesce("mark", new.digest).alias("digest"), "chars"), "exact-rows")
        seen = stored(screened(_summary(new, id_col), filters, buckets), "exact-screened")

    hits = seen.where("maybe").select("digest", F.col("n").alias("m"), F.col("best").alias("other"))
    with_old = old_groups.join(hits, "digest", "full").select(
        "digest", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.least("best", "other").alias("best"))
    groups = with_old.unionByName(seen.where("not maybe").select("digest", "n", "best"))
    rows = old.withColumn("in_snapshot", F.lit(True)).unionByName(new.withColumn("in_snapshot", F.lit(False)))
    kept = (F.col("chars") == -F.col("best.c")) & F.col(id_col).eqNullSafe(F.col("best.i"))
    return rows.join(groups, "digest").select(
        id_col, F.col("best.i").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.substring("digest", 1, 64).alias("digest"), "in_snapshot")
