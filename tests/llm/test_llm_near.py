"""Near copies of the pipeline's stage against all pairs by true Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest

from seasonpanel.llm import nearcopies
from seasonpanel.llm.nearcopies import band_keys, near_copies_keep, shingles

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, root int"


def brute_keep(rows):
    """The smallest id of each group; None for a group without ids."""
    def words(text):
        parts = (text or "").encode().lower().split()
        return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()

    sets, root = [words(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small * 5 >= large * 4 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(least.values(), key=repr)


def family(base, n, changes, first):
    rnd, out = random.Random(n), []
    for k in range(n):
        words = base.split()
        for c in range(changes):
            words[rnd.randrange(len(words))] = f"w{k}x{c}"
        out.append((first + k, " ".join(words)))
    return out


def made(n=300):
    return " ".join(random.Random(9).choices([f"v{i}" for i in range(5_000)], k=n))


def test_stage_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += family(rows[5][1], 40, 1, 10_000_000) + family(made(), 40, 4, 20_000_000)
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, SF).select("doc_id").collect()), key=repr)
    assert got == brute_keep(rows)


@pytest.mark.parametrize("block", [256, 8])
def test_a_chain_in_one_band_is_not_cut(spark, monkeypatch, block):
    """Copies that are near to some of their group only: centres first, then all that is left in cells."""
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", block)
    rows = family(made(), 60, 7, 0) + family(made(), 60, 3, 1_000)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id for r in near_copies_keep(frame).collect()), key=repr) == brute_keep(rows)


def test_odd_rows(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (5, " \n"), (None, "lonely words"), (None, "a b"), (7, "same id"), (7, "same id"), (8, "w " * 40_000), (9, "w w w w w"), (None, None)]
    kept = near_copies_keep(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "score", "root"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == brute_keep(rows)
    assert near_copies_keep(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [40, 300])
def test_cell_links_equal_all_pairs(n):
    """Whole sets: the same components as all pairs; long ones: every true pair is among the open ones."""
    rng = np.random.default_rng(n)
    base, sets = rng.integers(-(1 << 62), 1 << 62, n), []
    for k in range(60):
        own = base.copy()
        change = rng.integers(0, n, int(n * 0.3 * k / 60))
        own[change] = rng.integers(-(1 << 62), 1 << 62, len(change))
        sets.append(np.unique(own))
    size, root = np.array([len(s) for s in sets]), np.arange(60)
    true = {(i, j) for j in range(60) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    sure, open_ = nearcopies._cell_links([s[: nearcopies.SKETCH] for s in sets], size, root, np.ones((60, 60), bool))

    def classes(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    if n == 40:
        assert not open_ and set(sure) <= true and classes(sure) == classes(true)
    else:
        assert not sure and true <= set(open_) and len(open_) < 60 * 59 / 2


def test_bands_hold_similarity_of_four_fifths():
    """The share of pairs that meet, at the lowest similarity that counts, against what the bands promise."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(3_000):
        both, own = rng.integers(-(1 << 62), 1 << 62, 80), rng.integers(-(1 << 62), 1 << 62, 20)
        met += (band_keys(np.concatenate([both, own[:10]])) == band_keys(np.concatenate([both, own[10:]]))).any()
    assert met >= 2_990
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(None)) == 0


def test_simhash_links_texts_without_a_common_band(spark):
    """With bands that find nothing, texts within two bits of SimHash are still linked, if they are similar."""
    rows = family(" ".join(random.Random(3).choices([f"v{i}" for i in range(5_000)], k=8_000)), 12, 1, 0) + [(100, "x"), (101, "x y")]
    prints = {i: nearcopies.simhash(shingles(t)) for i, t in rows}
    close = [(a, b) for a in range(12) for b in range(a) if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2]
    assert len(close) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mark = nearcopies.F.xxhash64("text").alias("_mark")
    told = nearcopies.sketched(docs.select("doc_id", mark, "text"), "text")
    nodes = told.selectExpr("doc_id", "_fp as node", "_size as size", "_sim as sim", "_mark", "array(doc_id) as keys")
    node = {r.doc_id: r.node for r in nodes.collect()}
    root = {r.node: r.root for r in nearcopies.similar_roots(nodes.drop("doc_id"), docs, "text").collect()}
    assert all(root[node[a]] == root[node[b]] for a, b in close)
    assert root.get(node[100]) != root.get(node[101]) or root.get(node[100]) is None
