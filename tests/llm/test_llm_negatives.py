"""Hard negatives against a search of all rows."""

import numpy as np
import pytest
from oracle import compare, duck

from seasonpanel.llm.negatives import _cells, build_index, hard_negatives, quantised
from seasonpanel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>, score string, q int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, v, "x", 1) for i, x, v in rows], SCHEMA)


def brute(rows, every=50, positives=5, negatives=3):
    rows = [(i, x, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, x, v in rows if i is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    rows = [r for r in rows if len(r[2]) == 6]
    out = []
    for k, (i, x, v) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, y, n) for n, (j, y, w) in enumerate(rows) if n != k)
        for s, j, y, _ in [r for r in scored if r[2] == x][:positives]:
            window = [(-t, o) for t, o, z, _ in scored if z != x and -50 * s <= -100 * t <= -95 * s][:negatives]
            out += [(i, j, n + 1, o, -s, t) for n, (t, o) in enumerate(window)]
    return sorted(out)


def made(n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 6))
    rows = []
    for k in range(n):
        v = centres[rng.integers(7)] + spread * rng.normal(size=6)
        rows.append((k, int(rng.integers(3)), [float(np.float32(c)) for c in v]))
    return rows


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("words", [1, 4, 16])
def test_equals_all_pairs(spark, words):
    rows = made(700, words)
    want = brute(rows)
    assert want and got(hard_negatives(frame(spark, rows), code_words=words)) == want


def test_edge_cases_equal_all_pairs(spark):
    rows = made(300, 3)
    rows += [(0, 1, rows[0][2]), (50, 1, rows[50][2]), (50, 1, rows[50][2])]  # copies of anchors
    rows += [(400 + k, 2, rows[7][2]) for k in range(80)]  # one vector very often, equal scores
    rows += [(None, 1, rows[1][2]), (600, None, rows[1][2]), (650, 1, None), (700, 1, [1.0, None] * 3), (750, 1, [float("nan")] * 6), (800, 1, [float("inf")] * 6), (850, 1, [1.0]), (900, 1, [])]
    rows += [(-50, -1, [0.0] * 6), (-1, -1, [0.0] * 6)]
    assert got(hard_negatives(frame(spark, rows), code_words=4)) == brute(rows)
    assert got(hard_negatives(frame(spark, []))) == []
    assert got(hard_negatives(frame(spark, [(0, 1, [1.0] * 6)]))) == []
    assert got(hard_negatives(frame(spark, [(k, 1, [1.0] * 6) for k in range(60)]))) == []


def test_cells_come_by_bound_and_bounds_hold(spark):
    rows = made(600, 9, 0.05)
    index = build_index(quantised(frame(spark, rows), "vec_id", "label", "embedding"), 8)
    blocks = [(r.cell, np.frombuffer(r.rows, "<i2").reshape(-1, 6)) for r in index.blocks.collect()]
    assert sum(len(b) for _, b in blocks) == 600
    query = blocks[0][1][0].astype(float)
    order = list(_cells(index, query, 0, 1 << 20))
    assert [c for c, _ in order[5:9]] == [c for c, _ in _cells(index, query, 5, 4)]
    assert {c for c, _ in order} == {c for c, _ in blocks}
    assert all(a >= b for (_, a), (_, b) in zip(order, order[1:]))
    bound = dict(order)
    assert all((rows @ query).max() <= bound[cell] for cell, rows in blocks)
    best = max((rows @ query).max() for _, rows in blocks)
    assert sum(b >= best for _, b in order) < len(order) / 2  # so a search can stop early


def test_query_matches_sql(spark):
    assert compare(QUERIES["op13_hard_negatives"](spark, SF), duck(SF), ORACLES["op13_hard_negatives"]) == ""
