"""Chat formatting, language, quality, toxicity and contamination."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seasonpanel.llm.chat import INST, Template, escape, format_chats, locate, loss_text, read_inst, render_inst, unescape
from seasonpanel.llm.contamination import Block, contamination, rolling, tiles, words
from seasonpanel.llm.langid import UNKNOWN, counts, fit_languages, identify
from seasonpanel.llm.quality import fit_quality, score_quality
from seasonpanel.llm.queries import QUERIES
from seasonpanel.llm.tokens import word_ids
from seasonpanel.llm.toxicity import LIMIT, Net, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/s>", "\n", "ok", " ", "é"]), max_size=12).map("".join)


# -- chat ---------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_template_is_reversible_and_located(turns):
    for _, text in turns:
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    turns = [(("user", "assistant")[k % 2] if k % 3 else role, text) for k, (role, text) in enumerate(turns)]
    out, spans, rewritten = locate(INST, turns)
    assert out == render_inst(turns) and read_inst(out) == turns and rewritten is None
    assert [unescape(out[c:d]) for *_, c, d in spans] == [t for _, t in turns]
    assert [(a, b) for _, a, b, *_ in spans] == list(zip([0] + [s[2] for s in spans], [s[2] for s in spans]))


def test_template_that_rewrites_history_is_found():
    def forgetful(turns):  # drops the thoughts of all but the last turn
        return "".join(f"{r}:{t if k == len(turns) - 1 else t.replace('hm', '')};" for k, (r, t) in enumerate(turns))

    out, spans, rewritten = locate(Template(forgetful), [("user", "a"), ("assistant", "hm b"), ("user", "c"), ("user", "d")])
    assert rewritten == 2 and [s[0] for s in spans] == [0, 3] and out == "user:a;assistant: b;user:c;user:d;"
    assert out[spans[1][3] : spans[1][4]] == "d"


def test_format_edge_cases(spark):
    rows = [(1, 2, "assistant", None, "x"), (1, 1, None, "</s>", "x"), (1, 1, None, "</s>", "x"), (None, None, "user", "q", "x"), (2, 0, "assistant", "w" * 100_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in format_chats(turns).collect()}
    assert read_inst(got[1].formatted) == [("", "</s>"), ("", "</s>"), ("assistant", "")] and got[1].n_turns == 3
    assert read_inst(got[None].formatted) == [("user", "q")] and loss_text(got[None].formatted, got[None].spans) == ""
    assert loss_text(got[2].formatted, got[2].spans) == "w" * 100_000
    assert format_chats(turns.limit(0)).count() == 0


# -- hashed words -------------------------------------------------------------------------


def test_word_ids_do_not_depend_on_chunks():
    texts = pa.array(["Hello, World! a_b", None, "", "x " * 300, "!!!", "été d'été", "hello"])

    def flat(chunk, offset=0):
        out = {}
        for row, ids, offsets in word_ids(texts.slice(offset), 1 << 20, True, chunk=chunk):
            for i in range(len(offsets) - 1):
                out[row + i] = ids[offsets[i] : offsets[i + 1]].tolist()
        return [out[k] for k in sorted(out)]

    wide = flat(1 << 20)
    assert wide == flat(16) and wide[2:] == flat(64, 2)
    assert [len(x) for x in wide] == [5, 0, 0, 300, 1, 4, 1] and wide[0][0] == wide[6][0]


# -- models -------------------------------------------------------------------------------


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("name,column,mod,held,least", [("op1_quality", "quality", 5, 0, 0.9), ("op5_toxicity", "toxic", 4, 2, 0.75)])
def test_scores_order_held_out_labels(spark, name, column, mod, held, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == got.doc_id.nunique() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == held for i in got.doc_id]).all()
    seen = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(seen.score.to_numpy(), seen[column].to_numpy()) > least
    again = QUERIES[name](spark, SF).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_calibration_sets_a_limit_by_language(spark):
    rnd = random.Random(3)
    bad = {"en": ["idiot", "scum"], "de": ["loweian", "loweiisch", "loweiung"]}
    rows, marks = [], []
    for i in range(600):
        lang = ("en", "de")[i % 2]
        words = [f"{lang}{rnd.randrange(200)}" for _ in range(30)]
        if i % 5 < 2:
            words[rnd.randrange(30)] = rnd.choice(bad[lang])
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(i % 5 < 2)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = fit_toxicity(docs, labels.where("doc_id % 3 > 0"))
    assert set(model.limits) == {None, "en", "de"} and model.limits[None] == LIMIT
    held = score_toxicity(docs.join(labels, "doc_id").where("doc_id % 3 = 0"), model).toPandas()
    bad_ids = (held.doc_id % 5 < 2).to_numpy()
    assert auc(held.score.to_numpy(), bad_ids) > 0.95 and (held.toxic.to_numpy() == bad_ids).mean() > 0.9


def test_toxicity_score_depends_on_the_text_alone(monkeypatch):
    rng = np.random.default_rng(5)
    net = Net.fresh(rng, 50)
    net.embed[:-1] = rng.normal(0, 1, net.embed[:-1].shape)
    texts = [rng.integers(0, 50, (n, 2)).astype(np.int32) for n in (3, 0, 1, 40, 2, 0, 0, 7, 1, 5)]
    tables = net.tables()

    def scores(rows):
        return net.scores(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(t) for t in rows])]), tables).tolist()

    alone = [scores([t])[0] for t in texts]
    for block in (1 << 16, 4):  # windows of a text in one block and in several
        monkeypatch.setattr("seasonpanel.llm.toxicity.BLOCK", block)
        assert scores(texts) == alone and scores(texts[::-1]) == alone[::-1]


ODD = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "!!! 12", None), (3, "long " * 200_000, "xx"), (4, "你好世界", "en")]


def test_models_on_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(*r, 1.5, "s") for r in ODD], "doc_id long, text string, lang string, score double, toxic string")
    none, label = docs.limit(0), spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (label, label.limit(0)):
        for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
            for base in (docs, none):
                got = score(docs, fit(base, labels)).collect()
                assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
                assert score(none, fit(base, labels)).count() == 0


# -- language -----------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    got = QUERIES["op3_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all() and held.inside.mean() > 0.95


def test_language_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "n") for r in ODD], "doc_id long, text string, lang string, nearest_lang string")
    model = fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r.doc_id, r.text): r for r in identify(docs, model).collect()}
    for key in ((None, None), (1, ""), (2, "!!! 12")):
        assert got[key].nearest_lang == got[key].lang_found == UNKNOWN and got[key].lang_score == 0
    assert got[4, "你好世界"].nearest_lang in model.langs and got[4, "你好世界"].lang_found == UNKNOWN
    assert identify(docs.limit(0), model).count() == 0
    blank = fit_languages(docs.limit(0))
    assert {r.nearest_lang for r in identify(docs, blank).collect()} == {UNKNOWN}
    text = "Some words, and sóme more! " * 40
    whole = counts(text)
    monkeypatch.setattr("seasonpanel.llm.langid.CHUNK", 7)
    assert (counts(text) == whole).all()


# -- contamination ------------------------------------------------------------------------


def slow_tiles(doc, item, shortest):
    free_d, free_i, out = [d >= 0 for d in doc], [True] * len(item), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return sorted(out)
        out.append(best)
        for k in range(best[2]):
            free_d[best[0] + k] = free_i[best[1] + k] = False


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=30), st.lists(st.integers(0, 3), min_size=2, max_size=14), st.integers(2, 4))
def test_tiles_cover_as_much_as_the_slow_search(doc, item, shortest):
    doc, item = np.array(doc, np.int64), np.array(item, np.int64)
    got = tiles(doc, item, shortest)
    slow = slow_tiles(doc, item, shortest)
    assert max((n for *_, n in got), default=0) == max((n for *_, n in slow), default=0)
    for side in (0, 1):
        used = [k for t in got for k in range(t[side], t[side] + t[2])]
        assert len(used) == len(set(used))
    assert all((doc[i : i + n] == item[j : j + n]).all() and n >= shortest for i, j, n in got)
    free_d, free_i = np.array(doc) >= 0, np.ones(len(item), bool)
    for i, j, n in got:
        free_d[i : i + n] = free_i[j : j + n] = False
    left = slow_tiles(np.where(free_d, doc, -1), np.where(free_i, item, -2), shortest)
    assert left == []  # nothing that could still be marked


def test_rolling_hashes_of_equal_windows_are_equal():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 4])
    h = rolling(ids, 3)
    assert h[0] == h[4] and len(set(h.tolist())) == 5 and len(rolling(ids, 9)) == 0


def test_contamination_finds_reordered_passages(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    item, other = " ".join(words[:20]), " ".join(words[20:])
    swapped = "Intro text. " + " ".join(words[10:20]).upper() + "; filler, " + " ".join(words[:10]) + "."
    rows = [(1, item), (2, swapped), (3, " ".join(words[:8])), (4, " ".join(f"{w} x" for w in words)), (5, None), (6, ""), (None, item), (1, item), (7, "x " * 100_000 + other), (8, f"{other} {item}")]
    docs = spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, text string, item_ids string, coverage int")
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "..."), (None, ""), (14, other)], "item_id long, text string")
    wanted = {(1, item): [10], (2, swapped): [10], (None, item): [10], rows[8]: [11, 14], rows[9]: [10, 11, 14]}
    for size in (8 << 20, 60):  # also with the benchmark in many blocks
        monkeypatch.setattr("seasonpanel.llm.contamination.BLOCK_BYTES", size)
        got = contamination(docs, bench).collect()
        assert len(got) == len(rows)
        for r in got:
            assert sorted(r.item_ids) == wanted.get((r.doc_id, r.text), []) and r.contaminated == bool(r.item_ids)
    assert contamination(docs.limit(0), bench).count() == 0
    assert not contamination(docs, bench.limit(0)).where("contaminated").count()
    assert contamination(docs, bench).where((F.col("doc_id") == 3) & (F.col("coverage") == 0.4)).count() == 1


def test_contamination_finds_short_and_unspaced_items(spark):
    han = "我们今天去公园看花"
    bench = spark.createDataFrame([(1, "One two, THREE four"), (2, han), (3, "zebra"), (4, "alpha beta gamma delta epsilon"), (5, None)], "item_id int, text string")
    cases = {
        "so one two three four it is": [1], "one two three x four": [], "two three four one": [], f"前{han}后": [2], han[:6] + "很好": [2], han[:4] + "很好": [],
        "a Zebra!": [3], "zebras": [], "alpha beta gamma delta": [], "x alpha beta gamma delta epsilon": [4], "我": [], "": [], "one two three four " + han: [1, 2],
    }
    got = contamination(spark.createDataFrame([(t,) for t in cases], "text string"), bench).collect()
    assert {r.text: sorted(r.item_ids) for r in got} == cases
    many = Block.of([(1, "one two three four"), (2, "one two")], 5)
    assert many.matches("x one two y", 0.5) == (1.0, [2]) and many.matches(None, 0.5) == (0.0, [])
    assert words("Ab1 我们, ไทย x") == ["ab1", "我", "们", "ไ", "ท", "ย", "x"]


def toxic_rows(spark, n):
    rnd = random.Random(6)
    rows = [(i, " ".join([f"w{rnd.randrange(300)}" for _ in range(8)] + ["scum" if i % 2 else "fine"]), ("en", "de")[i % 3 > 0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def test_toxicity_trains_on_every_labelled_row(spark, monkeypatch):
    docs, labels = toxic_rows(spark, 10_000)
    trained = []
    monkeypatch.setattr("seasonpanel.llm.toxicity._trained", lambda rows, state, n: trained.append((rows.count(), n)))
    fit_toxicity(docs, labels)
    expected = docs.count()
    (rows, n), = trained
    assert rows == n and 0.77 * expected < n < 0.83 * expected


def test_toxicity_parts_are_merged_and_agree_with_reruns(spark, monkeypatch):
    monkeypatch.setattr("seasonpanel.llm.toxicity.PART_ROWS", 150)
    docs, labels = toxic_rows(spark, 900)
    first, again = (fit_toxicity(d, labels).net for d in (docs, docs.repartition(5)))
    assert (first.embed == again.embed).all() and (first.out == again.out).all() and (first.slope, first.shift) == (again.slope, again.shift)
    held = score_toxicity(toxic_rows(spark, 400)[0], fit_toxicity(docs, labels)).toPandas()
    assert auc(held.score.to_numpy(), (held.doc_id % 2).to_numpy()) > 0.95


def test_toxicity_rows_are_small_and_dealt_in_parts(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more labels than a broadcast takes
    docs, labels = toxic_rows(spark, 60)
    seen = []
    monkeypatch.setattr("seasonpanel.llm.toxicity.PART_ROWS", 20)
    monkeypatch.setattr("seasonpanel.llm.toxicity._trained", lambda rows, state, n: seen.append((rows.rdd.getNumPartitions(), rows.select("_y", "_ids", "_h").collect())))
    try:
        fit_toxicity(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    (parts, rows), = seen
    assert parts == 3 and len(rows) > 30
    # nine words of two ids, two bytes each; the hash that holds rows back is of the id and four bytes an id
    assert {len(r["_ids"]) for r in rows} == {36}
    wide = [(r["_h"], np.frombuffer(r["_ids"], "<u2").astype("<i4").tobytes()) for r in rows]
    ids = spark.createDataFrame(wide, "h long, ids binary").crossJoin(docs.select("doc_id")).where(F.xxhash64("doc_id", "ids") == F.col("h"))
    assert ids.select("doc_id").distinct().count() == len(rows) and all(h % 5 for h, _ in wide)


def test_toxicity_sums_parts_before_the_shuffle(spark):
    from seasonpanel.llm.toxicity import _summed

    def run(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([n, 1])], ["at", "n"])

    summed = _summed(spark.range(0, 400, 1, 40), run, "at long, n long", ["at"], 400)
    assert {tuple(r) for r in summed.collect()} == {(1, 400), (2, 40)}
    assert f"Coalesce {spark.sparkContext.defaultParallelism}" in summed._jdf.queryExecution().executedPlan().toString()
