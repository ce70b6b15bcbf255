"""Phrase collocations against counting every phrase."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck

from seasonpanel.llm import collocations as module
from seasonpanel.llm.collocations import collocations, frequent_phrases
from seasonpanel.llm.phrases import LONG_WORD, read_words
from seasonpanel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, x, "x", 1) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, shard int")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def counted(rows, most=4):
    f, n = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for s in range(len(w) - m + 1):
                    f[lang, tuple(w[s : s + m])] += 1
    return f, n


def brute(rows, support, top):
    f, n = counted(rows)
    long = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    best = {}
    for (lang, w), a in long.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[s : s + len(w)] == w for s in range(len(v))) for (x, v), b in long.items()):
            continue
        cuts = [(int(Fraction(2_000_000 * a, f[lang, w[:k]] + f[lang, w[k:]])), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in best.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def made(n, seed):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "é", "ÄÖ", "日本語", "w" * (LONG_WORD + 3), "x"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\xa0"]) for _ in range(rng.randrange(60))]
        rows.append(("".join(parts) + rng.choice(["", "the cat sat on", "the the the the the"]), rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (None, None), (" \t.", "fr")]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("support, top", [(2, 50), (9, 2000), (40, 3)])
def test_equals_counting_everything(spark, support, top):
    rows = made(150, support)
    rows += rows[:30] * 3
    want = brute(rows, support, top)
    assert want and got(collocations(frame(spark, rows), support=support, top=top)) == want


def test_small_tasks_and_filters_change_nothing(spark, monkeypatch):
    rows = made(200, 5)
    want = brute(rows, 12, 100)
    df = frame(spark, rows).repartition(5)
    for name, value in (("HELD", 50), ("HELD_PHRASES", 7), ("FILTER_BITS", 1 << 9), ("BUCKET_WORDS", 64)):
        monkeypatch.setattr(module, name, value)
        assert got(collocations(df, support=12, top=100, shards=4)) == want
    assert module.Layout.of(1 << 20, 4).bits == 1 << 9


def test_counts_are_exact_and_complete(spark):
    rows = made(200, 8) + [("very long " * 60_000, "en")]
    f, n = counted(rows)
    counts, per_lang = frequent_phrases(frame(spark, rows), support=25)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == {k: v for k, v in f.items() if v >= 25}
    assert {r.lang: r.n for r in per_lang.collect()} == dict(n)


def test_empty_tables(spark):
    assert got(collocations(frame(spark, []))) == []
    assert got(collocations(frame(spark, [(None, None), ("", "en")]))) == []


def test_equal_hashes_of_different_phrases_are_kept_apart():
    words = read_words(pa.array(["a b a c b"]))
    held = module._Phrases()
    one, two = np.zeros(5, np.uint64), np.array([1, 2, 1, 3, 2], np.uint64)
    for _ in range(2):
        held.add(words, 1, np.arange(5), one, two)
    total = Counter()
    for _, texts, counts in held.rows(module.Layout(8, 1 << 16).bucket_edges()):
        for t, c in zip(texts, counts):
            total[t] += c
    assert total == {b"a": 4, b"b": 4, b"c": 2}


@pytest.mark.parametrize("values", [[0], [255, 256], [1 << 40, 3, 0], list(range(300))])
def test_packed_numbers_come_back(values):
    assert module._unpacked(module._packed(np.array(values)), len(values)).tolist() == values


def test_query_matches_sql(spark):
    assert compare(QUERIES["op11_collocations"](spark, SF), duck(SF), ORACLES["op11_collocations"]) == ""


def test_listed_phrases_are_compressed_and_come_back():
    rnd = random.Random(3)
    words = [f"word{k}" for k in range(200)]
    texts = list({" ".join(rnd.choices(words, k=rnd.randrange(1, 5))).encode() for _ in range(4000)} | {b"\xc3\xa9t\xc3\xa9"})
    counts = [rnd.choice([1, 2, 300, 1 << 40]) for _ in texts]
    n, size, phrases, many = module._listed(texts, counts)
    found = dict(zip(*(c.to_pylist() for c in module._unlisted(n, size, phrases, many))))
    assert found == dict(zip(texts, counts)) and len(phrases) < size / 3
