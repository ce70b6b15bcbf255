"""Document quality from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, labelled_sample
from .tokens import word_ids

BUCKETS = 1 << 14
DIM = 32
#: Signed entries of each word's index vector.
ENTRIES = 2
#: Words on either side that lend their index vectors.
WINDOW = 2
#: Words of a segment whose mean is compared with the document's.
SEGMENT = 32
#: Bound of the training sample: labelled texts per class.
TRAIN_PER_CLASS = 8_000
HIDDEN = 32
EPOCHS = 30


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of every bucket's sparse random index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, ENTRIES)), rng.choice(np.array([-1, 1]), (BUCKETS, ENTRIES))


def context_sums(ids: np.ndarray, offsets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each bucket (BUCKETS x DIM, whole numbers)."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ids = ids[offsets[0] : offsets[-1]].astype(np.int64)
    total = np.zeros(BUCKETS * DIM)
    for gap in range(1, WINDOW + 1):
        same = text[gap:] == text[:-gap]
        a, b = ids[gap:][same], ids[:-gap][same]
        for word, near in ((a, b), (b, a)):
            for e in range(ENTRIES):
                total += np.bincount(word * DIM + places[near, e], weights=signs[near, e], minlength=BUCKETS * DIM)
    return total.reshape(BUCKETS, DIM)


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length 1, after the mean direction is taken out; unseen words are 0."""
    seen = np.abs(sums).sum(1) > 0
    v = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    if seen.any():
        v = np.where(seen[:, None], v - v[seen].mean(0), 0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean word vector, mean square, and mean, largest and spread of segment lengths.

    A segment of one repeated word has a mean vector of length 1, mixed words a short one. A text
    without words is all 0.
    """
    n = len(offsets) - 1
    length = np.diff(offsets)
    out = np.zeros((n, 2 * DIM + 4), np.float32)
    if offsets[-1] == offsets[0]:
        return out
    v = vectors[ids[offsets[0] : offsets[-1]]]
    text = np.repeat(np.arange(n), length)
    within = np.arange(len(v)) - np.repeat(offsets[:-1] - offsets[0], length)
    start = np.flatnonzero(within % SEGMENT == 0)
    size = np.diff(np.append(start, len(v)))
    part = np.add.reduceat(v, start, axis=0)
    square = np.add.reduceat(v * v, start, axis=0)
    owner = text[start]
    has = np.flatnonzero(length > 0)
    first = np.searchsorted(owner, has)
    count = np.maximum(length[has], 1)[:, None]
    out[has, :DIM] = np.add.reduceat(part, first, axis=0) / count
    out[has, DIM : 2 * DIM] = np.add.reduceat(square, first, axis=0) / count * DIM
    norm = np.linalg.norm(part, axis=1) / np.maximum(size, 8)
    many = np.diff(np.append(first, len(owner)))
    mean = np.add.reduceat(norm, first) / many
    out[has, 2 * DIM] = mean * 4
    out[has, 2 * DIM + 1] = np.maximum.reduceat(norm, first) * 4
    out[has, 2 * DIM + 2] = np.sqrt(np.maximum(np.add.reduceat(norm * norm, first) / many - mean * mean, 0)) * 4
    out[has, 2 * DIM + 3] = np.log1p(length[has]) / 5
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.logits(x).astype(np.float64) + self.shift) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, prior: float, seed: int = 5) -> QualityModel:
    """Two-layer network on pooled vectors; the last fifth of the sample sets the temperature.

    ``shift`` moves the sample's class balance to ``prior``. With one class only, every score is
    the clipped prior.
    """
    rng = np.random.default_rng(seed)
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    centre, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = QualityModel(vectors, centre, scale, layers)
    odds = float(np.log(prior / (1 - prior)))
    if len(y) < 10 or y.min() == y.max():
        model.layers = [w * 0 for w in layers]
        model.shift = odds
        return model
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    z = np.clip((x - centre) / scale, -8, 8)
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in layers]
    step = 0
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            step += 1
            h = np.tanh(z[batch] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3][0], -50, 50)))
            err = (p - y[batch]) / len(batch)
            back = err[:, None] * layers[2] * (1 - h * h)
            grads = [z[batch].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ err + 1e-4 * layers[2], np.array([err.sum()])]
            for w, g, (m, v) in zip(layers, grads, moment):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    share = y[fit].mean()
    logits, target = model.logits(x[held]), y[held]
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.logaddexp(0, np.where(target > 0, -1, 1) * logits / t).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    model.shift = (odds - float(np.log(share / (1 - share)))) * model.temperature
    return model


# -- on Spark -----------------------------------------------------------------------------


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors over every text: BUCKETS x DIM numbers whatever the corpus size.

    Tasks sum the index vectors of neighbours per bucket; the sums of all tasks are added by
    bucket. Whole numbers make the result independent of the order.
    """

    def sums(batches):
        places, signs = index_vectors()
        total = np.zeros((BUCKETS, DIM))
        for batch in batches:
            for _, ids, offsets in word_ids(batch.column(0), BUCKETS, fold=False):
                total += context_sums(ids, offsets, places, signs)
        seen = np.flatnonzero(np.abs(total).sum(1) > 0)
        flat = pa.array(total[seen].astype(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * DIM, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), lists], ["bucket", "sums"])

    parts = docs.select(text_col).mapInArrow(sums, "bucket int, sums array<bigint>")
    added = parts.groupBy("bucket").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)])
    out = np.zeros((BUCKETS, DIM))
    table = added.toPandas()
    if len(table):
        out[table["bucket"].to_numpy(int)] = table.drop(columns="bucket").to_numpy(float)
    return unit_vectors(out)


def _pooled(batch: pa.RecordBatch, text_col: str, vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled(ids, offsets, vectors) for _, ids, offsets in word_ids(batch.column(text_col), BUCKETS, fold=False, chunk=1 << 18)])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                vectors: np.ndarray | None = None, per_class: int = TRAIN_PER_CLASS) -> QualityModel:
    """Word vectors from all texts of ``docs``; the network from a bounded sample of labelled rows.

    ``per_class`` bounds the sample; the share of class 1 among all labelled ids sets the
    calibration. Without labels every score is 0.5.
    """
    vectors = word_vectors(docs, text_col) if vectors is None else vectors
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows, counts = labelled_sample(docs.select(id_col, text_col), labels, id_col, label_col, per_class, "quality")

    def features(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([x.astype("<f4").tobytes() for x in _pooled(batch, text_col, shared.value)], pa.binary())]

    pdf = appended(rows, features, {"_x": "binary"}).select(id_col, "_label", "_x").toPandas().sort_values([id_col, "_x"], kind="stable")
    x = np.array([np.frombuffer(b, "<f4") for b in pdf["_x"]], np.float64).reshape(-1, 2 * DIM + 4)
    y = (pdf["_label"].to_numpy(int) > 0).astype(float)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    return train(x, y, vectors, share)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, calibrated; higher: label 1 likelier), from the text alone.

    Null and empty texts get the score of a text without words. A column named score is replaced;
    rows and repetitions stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(shared.value.scores(_pooled(batch, text_col, shared.value.vectors)))]

    return appended(docs, score, {"score": "double"})
