"""Toxicity scores from a convolutional text classifier trained in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled
from .common import appended, sliced
from .tokens import word_ids

BUCKETS = 1 << 16
#: Two word ids of a bucket each, as the training rows keep them.
KEPT_IDS = "<u2" if BUCKETS <= 1 << 16 else "<u4"
#: Each word is the sum of two embeddings: its own and that of its first bytes.
PREFIX = 4
WIDTH = 12
FILTERS = 12
SPANS = (1, 2, 3)
#: Labelled texts, and words, of a part of the training rows, about. A part is trained on in one task.
PART_ROWS, PART_WORDS = 16_384, 4_000_000
EPOCHS = 6
#: One labelled text in so many is held back for the calibration.
HELD = 5
#: Bits of the filter that leaves most unlabelled texts out before anything is shuffled.
SLOTS = 1 << 25
#: Steps of a logit that the calibration tells apart.
STEPS = 256
#: Columns of a row of moves: a bucket's embedding, its squared moves, and the batches that moved it.
MOVES = [f"v{k}" for k in range(WIDTH + 2)]
#: Positions convolved at once.
BLOCK = 1 << 16
#: The decision limit that calibrated scores are made for.
LIMIT = 0.3


@dataclass
class Net:
    """Embeddings (last row: padding), one filter bank per span, and the output layer."""

    embed: np.ndarray
    banks: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    #: score = sigmoid(slope * logit + shift)
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, rng, buckets=BUCKETS):
        embed = rng.normal(0, 0.05, (buckets + 1, WIDTH)).astype(np.float32)
        embed[-1] = 0
        banks = [rng.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
        return cls(embed, banks, [np.zeros(FILTERS, np.float32) for _ in SPANS], rng.normal(0, 0.1, FILTERS * len(SPANS)).astype(np.float32), 0.0)

    def tables(self):
        """Every bucket's contribution to each place of each filter."""
        return [[(self.embed @ bank[k]).astype(np.float32) for k in range(len(bank))] for bank in self.banks]

    def pooled(self, ids: np.ndarray, offsets: np.ndarray, tables) -> np.ndarray:
        """Largest filter responses per text (rows of ``offsets``), over whole texts, in blocks."""
        n, pad = len(offsets) - 1, len(self.embed) - 1
        top = np.full((n, len(SPANS) * FILTERS), -np.inf, np.float32)
        padded, starts = _padded(ids, offsets, pad)
        ends = np.append(starts[1:], len(padded))
        for j, (span, parts) in enumerate(zip(SPANS, tables)):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            for at in range(0, len(padded) - span + 1, BLOCK):
                stop = min(len(padded) - span + 1, at + BLOCK)
                r = np.zeros((stop - at, FILTERS), np.float32)
                for k in range(span):
                    for which in range(2):
                        r += parts[k][padded[at + k : stop + k, which]]
                a, b = np.searchsorted(starts, [at, stop - 1], side="right") - 1
                over = (ends[a : b + 1, None] - np.arange(1, span)).ravel()  # windows that reach into the next text
                r[over[(over >= at) & (over < stop)] - at] = -np.inf
                cut = np.maximum(starts[a : b + 1], at) - at
                top[a : b + 1, cols] = np.maximum(top[a : b + 1, cols], np.maximum.reduceat(r, cut, axis=0))
            top[:, cols] += self.bias[j]
        return np.maximum(top, 0)

    def logits(self, ids, offsets, tables) -> np.ndarray:
        # summed row by row: a matrix product may round a row differently in another batch
        return (self.pooled(ids, offsets, tables) * self.out).sum(axis=1) + self.out_bias

    def scores(self, ids, offsets, tables) -> np.ndarray:
        z = self.slope * self.logits(ids, offsets, tables).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _padded(ids: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by as much padding as in training; :meth:`Net.pooled` leaves out windows across two texts."""
    gap = max(SPANS)
    length = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + gap * np.arange(len(length))
    padded = np.full((int(length.sum()) + gap * len(length), 2), pad, np.int32)
    padded[np.arange(int(length.sum())) + gap * np.repeat(np.arange(len(length)), length)] = ids[offsets[0] : offsets[-1]]
    return padded, starts


@dataclass
class State:
    """The net with what its optimiser remembers: moments of the small arrays, squared moves of each bucket, steps."""

    net: Net
    moment: list[tuple[np.ndarray, np.ndarray]]
    grown: np.ndarray
    step: int = 0

    @classmethod
    def begun(cls, seen: np.ndarray, texts: np.ndarray, seed: int = 7):
        """Embeddings start from the smoothed log odds of each bucket: ``seen`` texts of either class out of ``texts``."""
        net = Net.fresh(np.random.default_rng(seed), seen.shape[1])
        rate = (seen + 1) / (texts[:, None] + 2)
        weight = seen.sum(0) / (seen.sum(0) + 5)
        net.embed[:-1, 0] = np.clip(np.log(rate[1] / rate[0]) * weight, -4, 4)
        for bank in net.banks:
            bank[:, 0, : FILTERS // 2] = np.abs(bank[:, 0, : FILTERS // 2])
            bank[:, 0, FILTERS // 2 :] = -np.abs(bank[:, 0, FILTERS // 2 :])
        return cls(net, [(np.zeros_like(p), np.zeros_like(p)) for p in _dense(net)], np.full(len(net.embed), 1e-3, np.float32))

    def small(self) -> np.ndarray:
        """All numbers but those of the buckets, one after the other."""
        return np.concatenate([*(x.ravel() for p, (m, v) in zip(_dense(self.net), self.moment) for x in (p, m, v)), [self.net.out_bias]]).astype(np.float64)

    def take_small(self, values: np.ndarray) -> None:
        at = 0
        for p, (m, v) in zip(_dense(self.net), self.moment):
            for x in (p, m, v):
                x[...] = values[at : at + x.size].reshape(x.shape)
                at += x.size
        self.net.out_bias = float(values[at])


def _dense(net: Net) -> list[np.ndarray]:
    return [*net.banks, *net.bias, net.out]


def run_epoch(state: State, texts: list[np.ndarray], labels: np.ndarray, epoch: int) -> np.ndarray:
    """One epoch of small batches over ``texts``, in ``state``; how many batches moved each bucket."""
    net, moment, grown, dense = state.net, state.moment, state.grown, _dense(state.net)
    y, pad = labels.astype(np.float32), len(state.net.embed) - 1
    moved = np.zeros(len(net.embed))
    rng = np.random.default_rng([7, epoch])
    rate_now = 0.01 * (1 - epoch / EPOCHS) + 0.001
    for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
        state.step += 1
        step = state.step
        pooled = np.zeros((len(batch), len(SPANS) * FILTERS), np.float32)
        where = np.zeros((len(batch), len(SPANS) * FILTERS), np.int64)
        rows = [np.concatenate([texts[i], np.full((max(SPANS), 2), pad, np.int32)]) for i in batch]
        for d, row in enumerate(rows):
            x = net.embed[row[:, 0]] + net.embed[row[:, 1]]
            for j, (span, bank) in enumerate(zip(SPANS, net.banks)):
                n = len(row) - span + 1
                r = x[:n] @ bank[0]
                for k in range(1, span):
                    r += x[k : n + k] @ bank[k]
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                where[d, cols] = r.argmax(axis=0)
                pooled[d, cols] = r[where[d, cols], np.arange(FILTERS)] + net.bias[j]
        active = np.maximum(pooled, 0)
        p = 1 / (1 + np.exp(-(active @ net.out + net.out_bias)))
        err = (p - y[batch]) / len(batch)
        back = err[:, None] * net.out[None, :] * (pooled > 0)
        grads = [np.zeros_like(b) for b in net.banks] + [back[:, j * FILTERS : (j + 1) * FILTERS].sum(0) for j in range(len(SPANS))]
        grads.append(active.T @ err + 1e-4 * net.out)
        touched, moves = [], []
        for d, row in enumerate(rows):
            for j, span in enumerate(SPANS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                for k in range(span):
                    word = row[where[d, cols] + k]
                    move = net.banks[j][k].T * back[d, cols, None]
                    grads[j][k] += ((net.embed[word[:, 0]] + net.embed[word[:, 1]]) * back[d, cols, None]).T
                    touched += [word[:, 0], word[:, 1]]
                    moves += [move, move]
        for q, g, (m, v) in zip(dense, grads, moment):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.out_bias -= rate_now * float(err.sum()) * 10
        word, move = np.concatenate(touched), np.concatenate(moves)
        order_w = np.argsort(word, kind="stable")
        word, cut = np.unique(word[order_w], return_index=True)
        move = np.add.reduceat(move[order_w], cut, axis=0)
        grown[word] += (move * move).mean(axis=1)
        net.embed[word] -= rate_now * 3 * move / np.sqrt(grown[word])[:, None]
        net.embed[pad] = 0
        moved[word] += 1
    return moved


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of ``y`` on ``z``, with smoothed targets; each line stands for ``n`` texts."""
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -50, 50)))
        e = n * (p - t)
        g = np.array([(e * z).sum(), e.sum()]) + 1e-3 * (w - [1, 0])
        s = n * (p * (1 - p) + 1e-9)
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return max(1e-3, float(w[0])), float(w[1])


# -- on Spark -----------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    net: Net
    #: Score from which a text counts as toxic, by language; None: all other languages and null.
    limits: dict[str | None, float]


def _tokens(texts: pa.Array, buckets: int):
    return word_ids(texts, buckets, fold=True, prefix=PREFIX, chunk=1 << 19)


def _limits(found, grid: np.ndarray) -> dict[str | None, float]:
    """The score limit with the best F1 in each language with at least 20 texts of either class.

    ``found`` has the number n of texts by lang, y and the number k of grid places up to their score.
    Among limits of equal F1 the one nearest LIMIT counts; other languages use LIMIT.
    """
    out: dict[str | None, float] = {None: LIMIT}
    for lang, part in found.groupby("lang", sort=True):
        by = np.zeros((2, len(grid) + 1))
        np.add.at(by, (part.y.to_numpy(int), part.k.to_numpy(int)), part.n.to_numpy(float))
        if by.sum(1).min() < 20:
            continue
        # texts whose score is at least the grid's: all that passed more places than are before it
        hit = by[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        f1 = 2 * hit[1] / (hit.sum(0) + by[1].sum())
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        out[lang] = float(grid[best[np.abs(grid[best] - LIMIT).argmin()]])
    return out


def _texts(batch) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(x, KEPT_IDS).reshape(-1, 2).astype(np.int32) for x in batch.column("_ids").to_pylist()], batch.column("_y").to_numpy(zero_copy_only=False)


def _likely_tokens(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(_id, lang, _ids, _h): word ids of the rows of ``docs`` whose _id may be one of ``marks``, by a bitmap of
    hashed ids (4 MB); the labels then decide. ``_h`` is the XXH64 of the id and the word ids as four bytes each.

    Both steps are one function, so that a task has one Python worker.
    """
    slot = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(SLOTS))
    maps = marks.groupBy(F.bitmap_bucket_number(slot + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits")).collect()
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in maps:
        at = (r["at"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                at = batch.column("_slot").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                if not batch.num_rows:
                    continue
                kept, hashes, seeds = [], [], batch.column("_seed").to_pylist()
                for row, ids, offsets in _tokens(batch.column("_text"), BUCKETS):
                    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]), row):
                        kept.append(ids[a:b].astype(KEPT_IDS).tobytes())
                        hashes.append(xxhash.xxh64_intdigest(ids[a:b].astype("<i4").tobytes(), seeds[k] % (1 << 64)))
                new = [pa.array(kept, pa.binary()), pa.array(np.array(hashes, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("lang"), *new], ["_id", "lang", "_ids", "_h"])

    marked = docs.where("_id is not null").withColumns({"_slot": slot, "_seed": F.xxhash64("_id")})
    return marked.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, lang {docs.schema['lang'].dataType.simpleString()}, _ids binary, _h bigint")


def _summed(rows: DataFrame, run, schema: str, keys: list[str], n_rows: int) -> DataFrame:
    """Sums by ``keys`` of what ``run`` makes of each part of ``rows``.

    A task goes through several parts, one after the other, and adds up before anything is shuffled, so that
    what is shuffled does not grow with the number of parts. Whole numbers or rounded ones (``_moves``): in any order the same.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // PART_ROWS))
    made = rows.mapInArrow(run, schema)
    return made.coalesce(tasks).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in made.columns if c not in keys])


def _counted(rows: DataFrame, buckets: int, n_rows: int) -> np.ndarray:
    """Texts of either class that hold each bucket, over all ``rows``; one line per class and bucket comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for ids, y in zip(*_texts(batch)):
                seen[y][np.unique(ids)] += 1
        y, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[y, bucket])], ["y", "bucket", "n"])

    found = _summed(rows, count, "y int, bucket int, n bigint", ["y", "bucket"], n_rows).toArrow()
    seen = np.zeros((2, buckets))
    seen[found.column("y").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return seen


def _trained(rows: DataFrame, state: State, n_rows: int) -> None:
    """EPOCHS epochs over all ``rows``: each part trains a copy of the net, then the copies are merged.

    Small arrays are averaged by the parts' rows, a bucket's embedding by the batches that moved it, so a
    rare word keeps its whole move. A part hands on only the buckets that it moved. The sums are made by Spark;
    the driver gets one net per epoch.
    """
    spark = rows.sparkSession
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, labels, order = [], [], []
            for batch in batches:
                some, y = _texts(batch)
                texts += some
                labels += y.tolist()
                order += batch.column("_h").to_pylist()
            if not texts:
                return
            by = np.argsort(np.array(order, np.int64), kind="stable")
            own = copy.deepcopy(shared.value)
            moved = run_epoch(own, [texts[i] for i in by], np.array(labels)[by], epoch)
            at = np.flatnonzero(moved[:-1])
            moves = np.column_stack([own.net.embed[at] - shared.value.net.embed[at], own.grown[at] - shared.value.grown[at]])
            yield _moves(at, np.column_stack([moves * moved[at, None], moved[at]]))
            small = np.concatenate([own.small(), [1, own.step]]) * (len(texts) / n_rows)
            small = np.append(small, np.zeros(-len(small) % len(MOVES))).reshape(-1, len(MOVES))
            yield _moves(-1 - np.arange(len(small)), small)

        merged = _summed(rows, run, f"at int, {', '.join(f'{c} double' for c in MOVES)}", ["at"], n_rows).toArrow().sort_by("at")
        at = merged.column("at").to_numpy()
        table = np.column_stack([merged.column(c).to_numpy() for c in MOVES])
        v = table[at < 0][::-1].ravel()[: len(state.small()) + 2]
        state.take_small(v[:-2] / v[-2])
        state.step = round(v[-1] / v[-2])
        at, table = at[at >= 0], table[at >= 0]
        weight = np.maximum(table[:, -1:], 1)
        state.net.embed[at] += (table[:, :WIDTH] / weight).astype(np.float32)
        state.grown[at] += (table[:, WIDTH] / weight[:, 0]).astype(np.float32)
        shared.destroy()


def _moves(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    values = np.rint(values * 2.0**40) / 2.0**40  # so that sums are exact, whatever their order
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *map(pa.array, values.T.copy())], ["at", *MOVES])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 lang_col: str | None = "lang") -> ToxicityModel:
    """Trains on every labelled row (whole texts), in parts of about PART_ROWS that Spark deals by hash.

    One text in HELD is held back for the calibration (Platt scaling). The share of class 1 among all
    labelled ids sets its level, and the language column only the decision limits by language, from all
    labelled rows. Several labels of an id: the largest counts; null labels and ids are ignored. Without
    labels every score is 0.5; with one class only, the clipped share of that class.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = float(np.clip(counts.get(1, 0) / sum(counts.values()) if counts else 0.5, 1e-4, 1 - 1e-4))

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang"))
    n_rows, chars = texts.select("_id", F.length("_text").alias("_chars")).join(marks, "_id").agg(F.count(F.lit(1)), F.sum("_chars")).first()
    parts = max(1, -(-n_rows // PART_ROWS), (chars or 0) // (5 * PART_WORDS))
    # the labels go beside the word ids: a sort-merge join would raise ``parts`` to the session's shuffle partitions
    words = _likely_tokens(texts, marks).withColumn("_y", F.lit(None).cast("int"))
    both = words.unionByName(marks, allowMissingColumns=True).repartition(parts, "_id")
    both = both.withColumn("_y", F.max("_y").over(Window.partitionBy("_id"))).where("_ids is not null and _y is not null")
    rows = both.select("_y", "_ids", "lang", "_h").persist(StorageLevel.DISK_ONLY)
    try:
        held = F.pmod("_h", F.lit(HELD)) == 0
        fit = {r["_y"]: r["n"] for r in rows.where(~held).groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if n_rows < 10 or len(fit) < 2:
            net = Net.fresh(np.random.default_rng(7))
            net.slope, net.shift = 0.0, float(np.log(share / (1 - share)))
            return ToxicityModel(net, {None: LIMIT})
        texts = np.array([fit[0], fit[1]], float)
        state = State.begun(_counted(rows.where(~held), BUCKETS, n_rows), texts)
        _trained(rows.where(~held), state, int(texts.sum()))
        net = state.net
        shared = rows.sparkSession.sparkContext.broadcast(net)
        cache: dict = {}

        def logits(batch: pa.RecordBatch) -> list[pa.Array]:
            if "tables" not in cache:
                cache["tables"] = shared.value.tables()
            some, _ = _texts(batch)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in some])])
            return [pa.array(shared.value.logits(np.concatenate(some), offsets, cache["tables"]).astype(np.float64))]

        # a few numbers a text
        known = settled(appended(rows, logits, {"z": "double"}).select(F.col("_y").alias("y"), "lang", held.alias("held"), "z"))
    finally:
        rows.unpersist()
    steps = known.where("held").groupBy("y", F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), "z")) * STEPS).alias("step")).agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n")).orderBy("y", "step").toPandas()
    net.slope, net.shift = _platt(steps.z.to_numpy(float), steps.y.to_numpy(float), steps.n.to_numpy(float))
    own = texts[1] / texts.sum()
    net.shift += float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    if not lang_col:
        return ToxicityModel(net, {None: LIMIT})
    grid = np.linspace(0.05, 0.95, 91)
    slope, shift = net.slope, net.shift

    def places(batch: pa.RecordBatch) -> list[pa.Array]:
        z = slope * batch.column("z").to_numpy(zero_copy_only=False) + shift
        return [pa.array(np.searchsorted(grid, 1 / (1 + np.exp(-np.clip(z, -50, 50))), "right").astype(np.int32))]

    placed = appended(known.where("lang is not null").select("y", "lang", "z"), places, {"k": "int"})
    enough = placed.groupBy("lang").agg(F.count_if(F.col("y") == 1).alias("one"), F.count_if(F.col("y") == 0).alias("none")).where("one >= 20 and none >= 20")
    return ToxicityModel(net, _limits(placed.join(enough.select("lang"), "lang", "left_semi").groupBy("lang", "y", "k").agg(F.count(F.lit(1)).alias("n")).toPandas(), grid))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``toxic``: the score reaches the limit of the row's language.

    The score depends on the text alone. Null and empty texts have no word and get the score of the
    padding. Columns of these names are replaced; rows, their ids and repetitions stay as they are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.net)
    cache: dict = {}

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        net = shared.value
        tables = cache.get("tables")
        if tables is None:
            tables = cache["tables"] = net.tables()
        out = [net.scores(ids, offsets, tables) for _, ids, offsets in _tokens(batch.column(text_col), BUCKETS)]
        return [pa.array(np.concatenate(out))]

    scored = appended(docs, score, {"score": "double"})
    limit = F.lit(model.limits[None])
    by_lang = {k: v for k, v in model.limits.items() if k is not None}
    if lang_col and by_lang:
        known = F.create_map(*[F.lit(x) for pair in by_lang.items() for x in pair])
        limit = F.coalesce(F.element_at(known, F.col(lang_col)), limit)
    return scored.withColumn("toxic", F.col("score") >= limit)
