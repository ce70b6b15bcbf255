"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended

DIM = 1 << 12
GRAMS = (1, 2, 3)
CENTROIDS = 4
#: Bound of the clustering sample: texts per language.
SAMPLE_PER_LANG = 1_500
#: Code points hashed at once.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Share of a language's sample that lies within its centroids' radius.
RADIUS_SHARE = 0.999
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def _codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, every other run as one blank, blanks around."""
    return np.frombuffer((" " + _OTHER.sub(" ", (text or "").lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), "<u4")


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-grams; single blanks and grams of three around a blank are left out."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = (h + codes[k : len(codes) - n + 1 + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    if n != 2:
        h = h[codes[n // 2 : n // 2 + len(h)] != 32]
    return (h % np.uint64(DIM)).astype(np.int64)


def counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    codes = _codes(text)
    total = np.zeros(DIM, np.float32)
    for n in GRAMS:
        for at in range(0, len(codes) - n + 1, CHUNK):
            total += np.bincount(_buckets(codes[at : at + CHUNK + n - 1], n), minlength=DIM)
    return total


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows: log counts times idf; a row without n-grams is 0."""
    x = np.log1p(raw) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, radii) of spherical k-means; the radius is the distance (1 - cosine) that RADIUS_SHARE stay below."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = [x[int(rng.integers(len(x)))]]
    while len(centre) < k:
        gap = np.maximum(1 - np.max(x @ np.array(centre).T, axis=1), 0) ** 2
        centre.append(x[int(rng.choice(len(x), p=gap / gap.sum()))] if gap.sum() > 1e-9 else x[0])
    centre = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].mean(0)
                centre[j] = m / max(np.linalg.norm(m), 1e-9)
    cos = x @ centre.T
    own = np.argmax(cos, axis=1)
    gap = 1 - cos[np.arange(len(x)), own]
    radius = np.quantile(gap, RADIUS_SHARE)
    return centre, np.array([max(radius, np.quantile(gap[own == j], RADIUS_SHARE) if (own == j).any() else 0) for j in range(k)])


@dataclass
class LanguageModel:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    radii: np.ndarray

    def nearest(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, cosine, inside the radius) per row of counts."""
        cos = weighted(raw, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        top = np.clip(cos[np.arange(len(cos)), best], 0, 1)
        return best, top, 1 - top <= self.radii[best]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Document frequencies from all rows with text and language; centroids from a bounded sample per language.

    Tasks count in how many texts each n-gram bucket occurs and Spark adds the DIM counts. The
    clusters of each language come from at most about ``per_lang`` of its texts, chosen by hash,
    one language per group. Without any row the model knows no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, F.col(lang_col).alias("_lang"))

    def frequencies(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += counts(text.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], seen]))], ["bucket", "n"])

    table = rows.select(text_col).mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1)
    df[table["bucket"].to_numpy(int) + 1] = table["n"].to_numpy(float)
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 0.1

    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel(idf, [], np.zeros((0, DIM)), np.zeros(0))
    rate = F.element_at(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, int((1 << 30) * min(1.0, per_lang / n)))]), F.col("_lang"))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) < rate)

    def vectors(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([weighted(counts(t.as_py())[None], idf)[0].astype("<f2").tobytes() for t in batch.column(text_col)], pa.binary())]

    def centres(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "_x"], kind="stable")
        centre, radius = cluster(np.array([np.frombuffer(b, "<f2") for b in pdf["_x"]]).astype(np.float32), CENTROIDS)
        return pd.DataFrame({"_lang": key[0], "centre": [c.astype("<f4").tobytes() for c in centre], "radius": radius.astype(float)})

    found = appended(sample, vectors, {"_x": "binary"}).select(id_col, "_lang", "_x").groupBy("_lang").applyInPandas(centres, "_lang string, centre binary, radius double").toPandas()
    found = found.sort_values(["_lang", "centre"], kind="stable")
    return LanguageModel(idf, found["_lang"].tolist(), np.array([np.frombuffer(c, "<f4") for c in found["centre"]]), found["radius"].to_numpy())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``nearest_lang``, ``lang_score`` (cosine, 0 to 1), ``lang_inside`` and ``lang_found``.

    ``lang_found`` is the nearest centroid's language, or ``und`` beyond that centroid's radius.
    A null text, a text without a letter, or a model without languages: ``und``, score 0, outside.
    Whole texts are read; columns of these names are replaced, rows and repetitions stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        n = batch.num_rows
        lang, score, inside = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        texts = batch.column(text_col)
        for at in range(0, n, 64):
            some = [(i, t) for i in range(at, min(n, at + 64)) if (t := texts[i].as_py()) and _LETTER.search(t)]
            if not some or not m.langs:
                continue
            own = [i for i, _ in some]
            best, score[own], inside[own] = m.nearest(np.array([counts(t) for _, t in some]))
            for i, b in zip(own, best):
                lang[i] = m.langs[b]
        found = [x if ok else UNKNOWN for x, ok in zip(lang, inside)]
        return [pa.array(lang), pa.array(score), pa.array(inside), pa.array(found)]

    return appended(docs, find, {"nearest_lang": "string", "lang_score": "double", "lang_inside": "boolean", "lang_found": "string"})
