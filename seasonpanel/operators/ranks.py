"""Row numbers and exact order statistics that never sort a whole group in one task.

A window over an unbounded group sorts it in one task. Both helpers here cut
each group into buckets first, number the rows inside a bucket, and add the
counts of the earlier buckets, which are few and bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 16_384
#: Places of the sketch, and pieces a bracket between them is cut into.
GRID = 64
PIECES = 4_096
#: Groups up to which one row per group is broadcast to the rows instead of joined by a shuffle.
BROADCAST_GROUPS = 10_000


def seeded_hash(seed: int | Column, *cols: str | Column) -> Column:
    """Stable 64-bit hash; the same after a retry or a repartition."""
    lead = seed if isinstance(seed, Column) else F.lit(seed)
    return F.xxhash64(lead, *[F.col(c) if isinstance(c, str) else c for c in cols])


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    groups: Sequence[str] = (),
    seed: int | Column = 42,
    rank: str = "hash_rank",
    total: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add a 1-based shuffled rank of each row inside its group.

    ``key`` must be unique inside the group. The bucket is a slice of a uniform
    hash, so buckets are even whatever the keys look like.
    """
    groups = list(groups)
    hashed = df.withColumn("_h", seeded_hash(seed, *key)).withColumn(
        "_b", F.pmod(F.shiftrightunsigned(F.col("_h"), 20), F.lit(buckets)).cast("int")
    )
    sizes = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups,
        "_b",
        F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"),
        *([F.sum("_size").over(Window.partitionBy(*groups)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *key)
    numbered = hashed.withColumn("_rn", F.row_number().over(inside))
    joined = null_safe_join(numbered, offsets, [*groups, "_b"], "inner")
    return joined.withColumn(rank, F.col("_rn") + F.col("_before")).drop("_h", "_b", "_rn", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match; keeps the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    if not cond:
        # no keys: the right side is a global aggregate, hence one row
        return left.join(F.broadcast(renamed), F.lit(True), how)
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys])


def dense_fold(df: DataFrame, unit: str, folds: int, groups: Sequence[str] = (), seed: int | Column = 42) -> DataFrame:
    """Distinct units dealt evenly into ``folds`` folds numbered from 1."""
    units = df.select(*groups, unit).distinct()
    ranked = hash_rank(units, [unit], groups, seed, "_rank", total="_units")
    k = F.least(F.lit(folds), F.col("_units"))
    return ranked.select(*groups, unit, (F.pmod(F.col("_rank") - 1, k) + 1).cast("int").alias("fold"), F.col("_units").alias("units"))


def order_statistics(df: DataFrame, value: str, groups: Sequence[str] = ()) -> "OrderStatistics":
    return OrderStatistics(df, value, list(groups))


class OrderStatistics:
    """Exact values at given ranks, per group.

    A sketch per group brackets each wanted rank by two values some hundredths of the group apart.
    One pass counts the rows below each bracket and keeps the values inside it, equal ones
    collapsed, cut evenly into ``PIECES`` pieces; the counts of the pieces say which one holds the
    rank, and only that piece is sorted. The column itself is neither shuffled nor stored.
    """

    def __init__(self, df: DataFrame, value: str, groups: list[str]):
        self.groups = groups
        self.rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
        real = F.when(~F.isnan("_v"), F.col("_v"))
        probs = [i / GRID for i in range(1, GRID)]
        # one row per group
        self.sketch = cut_lineage(
            self.rows.groupBy(*groups).agg(
                F.count(F.lit(1)).alias("n"), F.count(real).alias("_real"), F.min(real).alias("_min"), F.max(real).alias("_max"),
                F.percentile_approx(real, probs, 100 * GRID).alias("_edges"))
        )
        self.small = self.sketch.count() <= BROADCAST_GROUPS

    def _spread(self, table: DataFrame) -> DataFrame:
        """``table``, with one row per group, for a join; broadcast if its counted rows are few."""
        return F.broadcast(table) if self.small else table

    def at(self, ranks: dict[str, Column]) -> DataFrame:
        """One row per group: its size ``n`` and the value at each 1-based rank.

        A rank is a Column over ``n``.
        """
        rank = lambda name: F.col(f"_rank_{name}")
        wanted = self.sketch.withColumns({f"_rank_{name}": c.cast("long") for name, c in ranks.items()})
        picks = []
        for name in ranks:
            # the grid place of the rank, and two more on either side for the sketch's own error
            place = F.floor(rank(name) * GRID / F.col("_real")).cast("int")
            low = F.when(place - 2 >= 1, F.get("_edges", place - 3)).otherwise(F.col("_min"))
            high = F.when(place + 2 <= GRID - 1, F.get("_edges", place + 1)).otherwise(F.col("_max"))
            picks.append(F.struct(F.lit(name).alias("name"), rank(name).alias("rank"), low.alias("low"), high.alias("high")))
        wanted = wanted.select(*self.groups, "n", F.array(*picks).alias("_picks"))
        # NaN counts as larger than all numbers and stands in a piece of its own
        piece = lambda p: (
            F.when(F.isnan("_v"), PIECES + 1).when(F.col("_v") < p["low"], -1).when(F.col("_v") > p["high"], None)
            .when(p["high"] > p["low"], F.least(F.lit(PIECES), F.floor((F.col("_v") - p["low"]) / (p["high"] - p["low"]) * PIECES))).otherwise(0).cast("int"))
        marks = F.filter(F.transform("_picks", lambda p: F.struct(p["name"].alias("name"), piece(p).alias("piece"))), lambda m: m["piece"].isNotNull())
        placed = null_safe_join(self.rows, self._spread(wanted.drop("n")), self.groups, "inner").select(*self.groups, "_v", F.explode(marks).alias("_m"))
        keys = [*self.groups, "name"]
        cells = placed.groupBy(*self.groups, F.col("_m.name").alias("name"), F.col("_m.piece").alias("piece"), F.when(F.col("_m.piece") >= 0, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*keys).orderBy("piece")
        pieces = cells.groupBy(*keys, "piece").agg(F.sum("_c").alias("_pc")).withColumn("_to", F.sum("_pc").over(upto)).withColumn("_from", F.col("_to") - F.col("_pc"))
        asked = wanted.select(*self.groups, "n", F.explode("_picks").alias("_p")).select(*self.groups, "n", F.col("_p.name").alias("name"), F.col("_p.rank").alias("rank"))
        chosen = null_safe_join(pieces, asked, keys, "inner").filter((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_to")))
        inside = null_safe_join(cells, chosen.select(*keys, "piece", "_from", "rank"), [*keys, "piece"], "inner")
        order = Window.partitionBy(*keys).orderBy("_v")
        found = inside.withColumn("_hi", F.sum("_c").over(order) + F.col("_from")).filter((F.col("rank") <= F.col("_hi")) & (F.col("rank") > F.col("_hi") - F.col("_c")))
        values = found.groupBy(*self.groups).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
        return null_safe_join(self.sketch.select(*self.groups, "n"), values, self.groups, "left")

    def quantiles(self, probs: dict[str, float]) -> DataFrame:
        """Linear-interpolation quantiles, one column per name."""
        ranks: dict[str, Column] = {}
        out: list[Column] = []
        for name, q in probs.items():
            pos = F.lit(q) * (F.col("n") - 1)
            low = F.floor(F.round(pos, 9))
            ranks[f"_{name}_lo"] = low + 1
            ranks[f"_{name}_hi"] = F.least(low + 2, F.col("n"))
            lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
            out.append((lo + (hi - lo) * (pos - low)).alias(name))
        return self.at(ranks).select(*self.groups, "n", *out)


def group_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    return order_statistics(df, value, groups).quantiles(probs)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    The aggregate keeps one row per key and partition before the shuffle, so a
    hot key costs no more than a cold one. ``order`` columns ascend.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, k: int, order: Sequence[Column], groups: Sequence[str] = (), salt: int = 64) -> DataFrame:
    """First ``k`` rows of each group; adds ``rank``. Two rounds: k per salted
    part of the group, then k of those."""
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    part = Window.partitionBy(*groups, "_s").orderBy(*order)
    survivors = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_s")
    whole = Window.partitionBy(*groups).orderBy(*order)
    return survivors.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
