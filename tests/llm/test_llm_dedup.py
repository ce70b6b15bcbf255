"""Exact, SimHash and substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from oracle import compare, duck

from seasonpanel.llm import bwt, common, substrings
from seasonpanel.llm.exact import build_filter, exact_dedup, may_contain
from seasonpanel.llm.queries import ORACLES, QUERIES
from seasonpanel.llm.simhash import fingerprint, simhash_groups, simhash_keep
from seasonpanel.llm.substrings import LENGTH, anchors, anchors_of, dedup_substrings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, fp int, score string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


# -- exact --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5_000, 60_000])
def test_filter_holds_its_keys_and_rejects_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    made = build_filter(np.concatenate([keys, keys[: n // 2]]))
    assert may_contain(keys, *made).all()
    others = rng.integers(0, 1 << 63, 100_000).astype(np.uint64) | np.uint64(1 << 63)
    assert may_contain(others, *made).mean() < 0.001


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\f\r"), []).append((-len(t), i is None, i or 0, i))
    return {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}


def test_exact_dedup_edge_cases(spark):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \n"), (6, "ab "), (7, "ab "), (7, "ab "), (None, "a  b"), (None, "z"), (8, " z"), (9, "x" * 200_000), (10, "x" * 200_000)]
    wanted = brute_exact(rows)
    for cut in (0, 4, 7, len(rows)):
        got = exact_dedup(frame(spark, rows[:cut]), frame(spark, rows[cut:])).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.keep_id, r.group_size) == wanted[r.digest]
        assert {(r.doc_id, r.digest) for r in got if r.kept} == {(k, d) for d, (k, _) in wanted.items()}
    assert exact_dedup(frame(spark, []), frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == ""


# -- SimHash ------------------------------------------------------------------------------


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, fps[k], least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "a b c", "ÉtÉ à la mer x", "a b c a b c a b c", "w " * 40_000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_groups_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = rows[5][1].split()
    for k in range(60):  # a family of near copies that differ in single words
        words = list(base)
        words[k * 7 % len(words)] = f"word{k}"
        rows.append((1_000 + k, " ".join(words)))
    rows += [(None, "lonely words here"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (3_000, ""), (2_999, None)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_groups(frame(spark, rows)).collect()]
    wanted = brute_groups(rows)
    assert sorted(got, key=repr) == wanted
    assert len({c for *_, c in wanted}) < len(rows) - 20
    kept = simhash_keep(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "fp", "score"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for *_, c in wanted if c is not None}) and ids.count(None) == 1
    assert simhash_groups(frame(spark, [])).count() == simhash_keep(frame(spark, [])).count() == 0


def test_components_end_with_stars(spark, monkeypatch):
    """Edges that are stars already need no round; any others give the smallest node that is reached."""
    label, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: label.append(name) or stored(df, name))
    rnd = random.Random(5)
    cases = [[], [(1, 1)], [(2, 1), (1, 3), (9, 8), (2, 1)], [(k, k + 1) for k in range(40)], [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]]
    for case in cases:
        label.clear()
        root = {x: x for u, v in case if u != v for x in (u, v)}
        for _ in root:
            for u, v in case:
                if u != v:
                    root[u] = root[v] = min(root[u], root[v])
        got = [(r.node, r.root) for r in common.components(spark.createDataFrame(case, "u long, v long")).collect()]
        assert sorted(got) == sorted(root.items())
        if len(case) < 5:
            assert len(label) == 1


# -- substrings ---------------------------------------------------------------------------


def test_transforms_and_merge_equal_sorted_suffixes():
    rnd = random.Random(1)

    def naive(strings):
        rows = []
        for i, s in enumerate(strings):
            t = [c + 1 for c in s]
            rows += [(t[p:] + [i - len(strings)], t[p - 1] if p else 0) for p in range(len(s) + 1)]
        return [r[1] for r in sorted(rows, key=lambda r: r[0])]

    for fan_in in (2, 3, 120):
        bwt.FAN_IN = fan_in
        for _ in range(60):
            pieces = [[bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(1, 5))]
            made = [bwt.build(p) for p in pieces]
            every = sum(pieces, [])
            assert [b.tolist() for b in made] == [naive(p) for p in pieces]
            assert bwt.merge(made).tolist() == naive(every)
            values = np.array([rnd.randint(0, 99) for _ in every])
            least, _ = bwt.least_per_window(made, values, 4)
            assert least.tolist() == [min(v for v, t in zip(values, every) if s[i : i + 4] in t) for s in every for i in range(len(s) - 3)]
    bwt.FAN_IN = 120


def test_anchors_cover_every_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3_000).astype(np.uint8)
    start, windows, anchor = anchors(data)
    assert start[0] == 0 and (start[1:] == (start + windows)[:-1]).all() and start[-1] + windows[-1] == len(data) - LENGTH + 1
    monkeypatch.setattr("seasonpanel.llm.substrings.CHUNK", 64)
    monkeypatch.setattr("seasonpanel.llm.substrings._TABLES", [])
    for a, b in zip(anchors(data), (start, windows, anchor)):
        assert (a == b).all()
    assert all(len(x) == 0 for x in anchors(data[: LENGTH - 1]))


def test_short_texts_are_hashed_together(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, n).astype(np.uint8) for n in (0, 49, 700, 0, 50, 51, 3_000, 12, 0, 49, 400, 7, 0)]
    wanted = [(i, *run) for i, t in enumerate(texts) for run in zip(*(x.tolist() for x in anchors(t)))]
    calls, hashed = [], substrings._least
    monkeypatch.setattr(substrings, "_least", lambda part: calls.append(len(part)) or hashed(part))
    assert list(zip(*(x.tolist() for x in anchors_of(texts)))) == wanted
    assert len(calls) == 1
    for few in ([], texts[:1], texts[:2], texts[2:3], [texts[0], texts[2]], [texts[2], texts[0]]):
        assert list(zip(*(x.tolist() for x in anchors_of(few)))) == [(i, *run) for i, t in enumerate(few) for run in zip(*(x.tolist() for x in anchors(t)))]
    assert [ids for ids, _ in substrings._together(enumerate([np.zeros(n, np.uint8) for n in (5, 0, substrings.CHUNK, 0, 9)]))] == [[0, 1], [2, 3], [4]]


def brute_substrings(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, float("inf")), rank(i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [50_000, 3])
def test_substrings_equal_all_windows(spark, monkeypatch, heavy):
    monkeypatch.setattr("seasonpanel.llm.substrings.HEAVY", heavy)
    monkeypatch.setattr("seasonpanel.llm.substrings.SHARD_BYTES", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()][:60]
    passage = rows[3][1][:180]
    rows += [(200 + k, f"{k} {passage} é{k * 7}") for k in range(12)]
    rows += [(300, None), (301, ""), (302, "a" * 49), (303, "a" * 50), (304, "a" * 5_000), (305, "ab" * 700), (None, passage), (None, passage), (306, passage), (306, passage)]
    got = dedup_substrings(frame(spark, rows).repartition(5)).collect()
    found = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=repr)
    assert found == brute_substrings(rows)
    assert dedup_substrings(frame(spark, [])).count() == 0


def test_windows_alone_leave_the_rounds(monkeypatch):
    rnd = random.Random(8)
    strings = [bytes(rnd.choices(b"abcdefgh", k=60)) for _ in range(40)] + [b"x" * 30 + b"same passage of more than twelve bytes" + bytes([k]) * 5 for k in range(65, 70)]
    values, sorted_rows = np.arange(len(strings))[::-1].copy(), []
    argsort = np.argsort
    monkeypatch.setattr(bwt.np, "argsort", lambda a, **kw: (sorted_rows.append(len(a)), argsort(a, **kw))[1])
    least, many = bwt.least_per_window([bwt.build(strings)], values, 12)
    # the last six sorts are rounds over windows of 12 bytes; random ones are alone early
    assert sorted_rows[-1] < sorted_rows[-6] / 3
    at = 0
    for text, n in zip(strings, many):
        for i in range(n):
            assert least[at + i] == min(v for v, other in zip(values, strings) if text[i : i + 12] in other)
        at += n
