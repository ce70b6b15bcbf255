"""Helpers that the corpus operators share: stored tables, split rules and components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Characters that separate words, as a character class for Java, DuckDB and Python.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Bytes of an Arrow batch that are worked on at once.
SLICE_BYTES = 4 << 20
#: Spark's setting for the bytes of an Arrow batch that goes to Python.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Later jobs read the files instead of repeating the work, on any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table from ``stored``. All that is computed from it must be stored by then."""
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, size: int = SLICE_BYTES) -> None:
    """Lets Spark hand Python at most about ``size`` bytes of rows at once (one row at least).

    By itself Spark fills a batch with up to 64 MB, which each task holds in the JVM and again in
    Python. The setting stays, as rows are computed after the caller has returned; a smaller one is kept.
    """
    spark.conf.set(ARROW_BYTES, str(min(size, _bytes(spark.conf.get(ARROW_BYTES)))))


def _bytes(value: str) -> int:
    """A setting such as 67108864b, 64m or 1kb as a number; Spark takes none from 2 GB on."""
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", value.strip().lower()).groups()
    return int(number) << 10 * " kmg".index(unit or " ")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def below_rate(id_col: str, rate: float, salt: str) -> Column:
    """True for about ``rate`` of all ids, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 30)) < int(rate * (1 << 30))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it can reach.

    Alternating large-star and small-star rounds. A node's smallest neighbour comes from an
    aggregate with partial sums and is joined back, so a node with very many neighbours is
    split like any skewed join. Each round is stored, and the number of rounds grows with the
    logarithm of the longest chain. It ends when every node points to one root that points nowhere,
    which one aggregate over the edges tells; such edges are the result, and need no round at all.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def stars(df: DataFrame) -> bool:
        ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        by = df.select(ends.alias("e")).groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return not by.agg(F.max(F.expr("up + down > 1 and up > 0"))).first()[0]

    edges = stored(ordered(edges), label)
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # an edge for each edge, from the larger to the smaller node; some may be listed twice until the round's end
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, edges = edges, stored(ordered(small.select("e.u", "e.v")), label)
        discarded(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES, at least one row each; nothing for no rows."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def appended(docs: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: dict[str, str]) -> DataFrame:
    """``docs`` with new columns that ``fn`` computes from each Arrow batch.

    A column of ``docs`` with the name of a new one is replaced; the batch that ``fn`` sees has
    all columns of ``docs``. Batches are cut to about SLICE_BYTES, or one row.
    """
    kept = [f for f in docs.schema if f.name not in fields]
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{k}` {v}" for k, v in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                new = fn(batch)
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + new, [f.name for f in kept] + list(fields))

    return docs.mapInArrow(run, shape)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, per_class: int, salt: str) -> tuple[DataFrame, dict]:
    """Labelled rows of ``docs`` with at most about ``per_class`` ids of either class, and the class counts.

    The ids are chosen by hash, the same at each run, from all labelled ids (several labels of an
    id: the largest counts; null labels and ids are ignored). Only the chosen ids, bounded by
    ``per_class``, are broadcast to the scan of the texts.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    counts = {int(r["_label"] > 0): r["n"] for r in marks.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("_label") > 0, below_rate("_id", min(1.0, per_class / max(1, counts.get(1, 0))), salt)).otherwise(below_rate("_id", min(1.0, per_class / max(1, counts.get(0, 0))), salt))
    chosen = marks.where(rate)
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).drop("_id"), counts
