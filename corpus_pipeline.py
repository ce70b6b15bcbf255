"""From raw documents to token shards: toxicity, near-duplicates, contamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All
but the last return the columns of ``docs``, whatever they are called; an empty table stays empty,
and whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonpanel.llm.common import crc_mod, documents, small_batches, stored
from seasonpanel.llm.contamination import contamination
from seasonpanel.llm.mixing import mix_texts
from seasonpanel.llm.nearcopies import near_copies_keep
from seasonpanel.llm.token_output import token_output
from seasonpanel.llm.toxicity import fit_toxicity, score_toxicity


#: Columns that the operators read.
INPUTS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns under names that no operator uses, and the way back to its
    own columns. So a column called ``score`` or ``coverage`` passes every stage as it is.

    Whole texts go through Python in every stage, so it also bounds the session's Arrow batches."""
    small_batches(docs.sparkSession)
    inside = {c: c if c in INPUTS else f"_document_{i}" for i, c in enumerate(docs.columns)}
    there = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in inside.items()])
    return there, lambda out: out.select(*[F.col(name).alias(c) for c, name in inside.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit of their language; a null or empty text stays.

    The model learns from the labelled documents whose id's crc32 by 4 does not leave 2.
    """
    docs, back = apart(docs)
    labels = documents(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    model = fit_toxicity(docs, labels)
    words = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return back(score_toxicity(docs, model).where(~(F.col("toxic") & words)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Links are a Jaccard similarity of 0.8 or more between the five-word shingles of two texts.
    Null and empty texts are one group; of the rows of a group that share its smallest id one stays.
    """
    docs, back = apart(docs)
    return back(near_copies_keep(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered by tiles; a null or empty text stays."""
    docs, back = apart(docs)
    return back(contamination(docs, documents(spark, sf_dir, "benchmark")).where(~F.col("contaminated")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and pass that gives words to it, shard by shard, shuffled.
    A document without a word gives none, so it is not in the mix; repeated rows draw on their own."""
    kind = docs.schema["n_chars"].dataType
    docs, back = apart(docs)
    return back(mix_texts(docs).withColumn("n_chars", F.char_length("text").cast(kind)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, written to shards; the index of the sequences."""
    return token_output(apart(docs)[0])[0]


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A trained classifier, hashed draws and a tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
