"""Mixing, token shards and the pipeline."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_near import brute_keep

from seasonpanel.llm.common import ARROW_BYTES, SLICE_BYTES, small_batches
from seasonpanel.llm.contamination import contamination
from seasonpanel.llm.feistel import permute
from seasonpanel.llm.mixing import Quota, SplittingTree, mix_plan, mix_texts, taken, targets, word_count
from seasonpanel.llm.queries import QUERIES
from seasonpanel.llm.token_output import _encoder, encode, manifest, read_records, token_output, verified, vocabulary
from seasonpanel.llm.toxicity import fit_toxicity, score_toxicity
from seasonpanel.session import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1_000, 4_097])
def test_permutation_is_one_to_one(n):
    assert sorted(permute(np.arange(n), n, 5)) == list(range(n))
    assert n < 60 or (permute(np.arange(n), n, 5) != permute(np.arange(n), n, 6)).any()


def test_permutation_of_a_large_range():
    out = permute(np.arange(200_000), 4 * 10**12, 1)
    assert len(set(out.tolist())) == 200_000 and out.min() >= 0 and 3.9e12 < out.max() < 4e12


def test_targets_share_the_excess():
    got = targets({"b": 100, "a": 10, "c": 100, None: 40})
    # a: 5, b: 2, c: 1, null: 5 again
    assert sum(got.values()) == pytest.approx(375) and got["a"] == 20 and got[None] == 80
    assert got["b"] == pytest.approx(2 * got["c"]) or got["b"] == 200
    assert targets({}) == {} and targets({"x": 0}) == {"x": 0.0}


def test_tree_deals_exact_quotas():
    drawn = np.array([1_000, 37, 0, 503])
    tree = SplittingTree(drawn, 7, 3)
    source = np.repeat(np.arange(4), drawn)
    order = np.concatenate([np.arange(n) for n in drawn])
    shard = tree.shard_of(source, order)
    sizes = np.bincount(shard, minlength=7)
    assert sizes.max() - sizes.min() <= 1
    rows = np.random.default_rng(0).permutation(len(order))[:200]  # any subset walks to the same shards
    assert (SplittingTree(drawn, 7, 3).shard_of(source[rows], order[rows]) == shard[rows]).all()
    share = np.bincount(shard[source == 0], minlength=7) / sizes
    assert abs(share - 1_000 / drawn.sum()).max() < 0.15


def mixed_docs(spark):
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(i * 37 % 900)), ("a", "b", None, "hot")[min(i % 7, 3)]) for i in range(120)]
    rows += [(None, "x y", "b"), (None, None, None), (5, "same", "a"), (5, "same", "a"), (200, "v " * 30_000, "hot")]
    return spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, source string, target int, pieces string")


@pytest.mark.parametrize("part_words", [1 << 20, 3_000])
def test_plan_meets_targets_and_texts_follow_it(spark, monkeypatch, part_words):
    monkeypatch.setattr("seasonpanel.llm.mixing.PART_WORDS", part_words)
    docs = mixed_docs(spark).withColumn("size", word_count("text"))
    plan = mix_plan(docs, block_words=64, shard_words=5_000).withColumn("taken", taken()).toPandas()
    assert len(plan) == docs.count() and (plan.taken <= 2 * plan["size"]).all()
    sums = plan.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.source_size).all() and (abs(sums.taken - sums.target) <= 0.5).all()
    goal = targets({(None if s != s else s): int(n) for s, n in sums["size"].items()})
    assert all(goal[None if s != s else s] == pytest.approx(t) for s, t in sums.target.items())
    again = mix_plan(docs.repartition(7), block_words=64, shard_words=5_000).withColumn("taken", taken()).toPandas()
    assert sorted(zip(plan["size"], plan.taken, plan.doc_id.fillna(-1))) == sorted(zip(again["size"], again.taken, again.doc_id.fillna(-1)))

    mixed = mix_texts(docs, block_words=64, shard_words=5_000)
    assert mixed.columns == docs.columns
    texts = mixed.withColumn("words", word_count("text")).toPandas()
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    assert texts.words.sum() == plan.taken.sum()
    assert any((None if i != i else int(i), t) in whole for i, t in zip(texts.doc_id, texts.text))
    text_of = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    for i, t in zip(texts.doc_id, texts.text):
        if i == i and i != 5:
            left = iter(text_of[int(i)])
            assert all(w in left for w in t.split())  # words of the document, in its order
    assert mix_plan(docs.limit(0)).count() == mix_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size,target", [(100, 250.0 / 2), (100, 200.0), (100, 3.4), (5, 7.0), (64, 64.0), (0, 0.0)])
def test_quota_adds_up(size, target):
    q = Quota(0, size, target, 64)
    assert q.full * size + q.blocks * 64 + q.rest == int(target + 0.5) or size == 0


def test_token_shards_read_back(spark):
    docs = spark.createDataFrame(
        [(i, f"Text number {i}, é <|endoftext|> " * (i % 40), "x") for i in range(150)] + [(None, None, "x"), (3, "", "x"), (None, "z" * 30_000, "x")],
        "doc_id long, text string, slot string").repartition(3)
    index, folder = token_output(docs.select("doc_id", "text", "slot").orderBy("doc_id", "text"), sequence=128, shard_bytes=4_096)
    rows = sorted(verified(spark, index, folder).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and all(r.intact for r in rows)
    layout, encoding = manifest(folder), _encoder(vocabulary())
    assert sum(layout.counts) == len(rows) and len(layout.counts) > 3 and layout.stride == 256
    records = list(read_records(folder))
    assert len(records) == len(rows)
    for at in (0, 1, len(rows) // 2, len(rows) - 1):  # resumed anywhere
        assert (next(read_records(folder, at)) == records[at]).all()
    got = np.bincount(np.concatenate([x[: r.n_tokens] for x, r in zip(records, rows)]), minlength=layout.end_of_text + 1)
    every = [t for r in docs.collect() for t in [*encode(encoding, r.text), layout.end_of_text]]
    assert (got == np.bincount(every, minlength=len(got))).all()
    held = {i for r in rows for i in r.doc_ids}
    assert held == {r.doc_id for r in docs.collect()}
    again, _ = token_output(docs.select("doc_id", "text").orderBy("doc_id", "text"), sequence=128, shard_bytes=4_096, key=9)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in rows)
    assert [r.sha256 for r in sorted(again.collect(), key=lambda r: r.slot)] != [r.sha256 for r in rows]
    none, folder = token_output(docs.limit(0))
    assert none.count() == 0 and list(read_records(folder)) == []


def test_long_texts_are_encoded_whole(monkeypatch):
    encoding = _encoder(vocabulary())
    text = "word été, " * 500
    monkeypatch.setattr("seasonpanel.llm.token_output.CHUNK", 64)
    assert encoding.decode(encode(encoding, text)) == text


def test_pipeline_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, folder = [docs], shared_folder(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stages-{np.random.default_rng().integers(1 << 60)}-{k}"
        stage(spark, steps[-1], SF).write.parquet(path)
        steps.append(spark.read.parquet(path))
        if name != "tokens":
            assert steps[-1].schema == docs.schema
    _, clean, single, free, mixed, index = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    toxic = {r.doc_id for r in score_toxicity(docs, fit_toxicity(docs, labels)).where("toxic").collect()}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert set(ids(docs)) - set(ids(clean)) == toxic
    assert sorted(ids(single), key=repr) == brute_keep([(r.doc_id, r.text) for r in clean.collect()])
    bad = {r.doc_id for r in contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert bad and set(ids(free)) == set(ids(single)) - bad
    words = lambda df: df.select(F.sum(word_count("text"))).first()[0]
    assert words(mixed) == pytest.approx(1.5 * words(free), abs=20) and set(ids(mixed)) <= set(ids(free))
    encoding = _encoder(vocabulary())
    wanted = sum(len(encode(encoding, r.text)) + 1 for r in mixed.collect())
    assert index.agg(F.sum("n_tokens")).first()[0] == wanted
    run = QUERIES["pipeline"](spark, SF)
    assert run.agg(F.sum("n_tokens")).first()[0] == wanted and run.columns == index.columns


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)], docs.schema))
    for source in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, source, SF).collect()


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["score", "Toxic", "label", "coverage", "item_ids", "contaminated", "_mark", "_fp", "_id", "root", "_source", "_start", "_h", "_part", "_size", "_shard", "_place", "pieces", "a b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, SF).collect(), stage(spark, wide, SF).collect()
        assert got and list(got[0].asDict()) == [*docs.columns, *names]
        assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in names), name
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r.doc_id, r.text) for r in plain), key=repr), name
    assert stage(spark, wide.limit(0), SF).columns == wide.columns
    index = corpus_pipeline.tokens(spark, wide.limit(30), SF)
    assert index.columns == corpus_pipeline.tokens(spark, docs.limit(30), SF).columns and index.count()


def _largest_batch(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bound_the_batches_that_python_gets(spark, name, stage):
    docs = spark.range(9_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("two words "), 200).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2_000).alias("n_chars"))
    spark.conf.unset(ARROW_BYTES)
    try:
        assert _largest_batch(docs) > 4 * SLICE_BYTES
        stage(spark, docs.limit(5), SF)
        assert _largest_batch(docs) < 1.1 * SLICE_BYTES
    finally:
        spark.conf.unset(ARROW_BYTES)


@pytest.mark.parametrize("before, after", [("64m", SLICE_BYTES), ("1kb", 1024), ("3000000", 3_000_000), ("1GB", SLICE_BYTES)])
def test_smaller_batches_are_kept(spark, before, after):
    try:
        spark.conf.set(ARROW_BYTES, before)
        small_batches(spark)
        small_batches(spark)
        assert spark.conf.get(ARROW_BYTES).rstrip("b") == str(after)
    finally:
        spark.conf.unset(ARROW_BYTES)
