"""Table sinks, the immutable run bundle and the table fingerprint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "errorifexists", order_by: Sequence[Column | str] = ()
) -> None:
    """One table. Rows are rebalanced by the partition columns first: a partition far
    above the advisory size is split over tasks by AQE, small ones share a task. With
    ``order_by`` (columns or sort expressions, also of mixed direction) the files hold the
    rows in that order over the whole table, by a range partitioning."""
    if order_by:
        df = df.orderBy(*order_by)
    elif partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode).partitionBy(*partition_by)
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def write_split(df: DataFrame, path: str, column: str = "target_temporal_granularity") -> None:
    """One partitioned table holds both the combined and the per-value datasets: the
    root reads as the whole, a partition folder as its part."""
    write_table(df, path, [column])


def write_bundle(tables: Mapping[str, DataFrame], manifest: DataFrame, root: str) -> None:
    """A run directory that may not exist yet: an existing one raises before anything is
    written. The manifest is written last and marks a complete run."""
    spark = manifest.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise ValueError(f"run folder {root} exists")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
    manifest.write.mode("errorifexists").json(f"{root}/manifest")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two order-free digests of the whole table."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
    )
