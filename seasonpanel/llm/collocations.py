"""Phrase collocations by SON partitioning: complete local mining at lowered support, then exact counts of the union."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sliced, stored
from .phrases import Words, longer, read_words

#: Shards that are mined on their own. The local support is the global one times a shard's part of a language's
#: words, so it stays above 1 only while there are fewer shards than the support.
SHARDS = 10
#: Words of a language and shard that one bucket of phrases is made for.
BUCKET_WORDS = 1 << 23
#: Bits of a shard's filter of locally frequent phrases at most. A full filter lets more phrases
#: through to the exact count and changes no result.
FILTER_BITS = 1 << 25
#: Hashes, or different phrases, that a task holds before it hands on what it has counted.
HELD = 1 << 22
HELD_PHRASES = 1 << 19
HELD_BYTES = 1 << 26


@dataclass(frozen=True)
class Layout:
    """Buckets of hashes and filter bits, both powers of 2 and addressed by a hash's highest bits."""

    buckets: int
    bits: int

    @classmethod
    def of(cls, words: int, shards: int) -> Layout:
        bits = min(FILTER_BITS, max(1 << 16, 1 << (4 * words // shards).bit_length()))
        return cls(min(bits >> 6, max(8, 1 << (words // BUCKET_WORDS).bit_length())), bits)

    def bucket_edges(self) -> np.ndarray:
        """The first hash of every bucket."""
        return np.arange(self.buckets, dtype=np.uint64) << np.uint64(64 - self.buckets.bit_length() + 1)

    def bit(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits.bit_length() + 1)).astype(np.int64)

    def short(self, hashes: np.ndarray) -> np.ndarray:
        """The highest bits, 30 more than name the bucket: what a tally keeps, as a filter takes in too much, never too little."""
        return (hashes >> np.uint64(64 - self._width())).astype(np.int64)

    def short_edges(self) -> np.ndarray:
        return np.arange(self.buckets, dtype=np.int64) << 30

    def bit_of_short(self, shorts: np.ndarray) -> np.ndarray:
        return shorts >> (self._width() - self.bits.bit_length() + 1)

    def _width(self) -> int:
        return self.buckets.bit_length() - 1 + 30


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the lowest first, as many as the largest needs."""
    planes = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _has(filter_: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list[tuple[str, int, int, int]]]]:
    """Words of each slice, a salt per document, and the runs (lang, shard, from, to) of words; documents are ordered by these."""
    for whole in batches:
        for batch in sliced(whole):
            batch = batch.take(pc.sort_indices(batch, [("lang", "ascending"), ("shard", "ascending")]))
            words = read_words(batch.column("text"))
            langs, shards = batch.column("lang").to_pylist(), batch.column("shard").to_numpy()
            salt = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in set(langs)}
            firsts = [at for at in range(len(langs)) if at == 0 or (langs[at], shards[at]) != (langs[at - 1], shards[at - 1])]
            cuts = np.searchsorted(words.doc, firsts + [len(langs)])
            runs = [(langs[d], int(shards[d]), int(a), int(b)) for d, a, b in zip(firsts, cuts, cuts[1:])]
            yield words, np.array([salt[x] for x in langs], np.uint64), runs


def _parted(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """(text, lang, shard): equal texts share a shard, whatever files or tasks they are in."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"))


def _word_counts(parted: DataFrame) -> DataFrame:
    """(lang, shard, n): number of words."""

    def count(batches):
        found = defaultdict(int)
        for _, _, runs in _batches(batches):
            for lang, shard, a, b in runs:
                found[lang, shard] += b - a
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["lang", "shard", "n"])

    return parted.mapInArrow(count, "lang string, shard int, n bigint").groupBy("lang", "shard").agg(F.sum("n").alias("n"))


class _Tally:
    """Counts hashes per key in a task and gives them out sorted, as bytes, bucket by bucket."""

    NAMES = ["shard", "bucket", "size", "lang", "n", "hashes", "counts"]
    SCHEMA = "shard int, bucket int, size int, lang string, n int, hashes binary, counts binary"

    def __init__(self, layout: Layout):
        self.layout, self.held, self.parts = layout, 0, defaultdict(list)

    def add(self, shard: int, size: int, lang: str, hashes: np.ndarray) -> None:
        if len(hashes):
            self.parts[shard, size, lang].append(hashes)
            self.held += len(hashes)

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.held < least:
            return
        for (shard, size, lang), parts in sorted(self.parts.items()):
            found, counts = np.unique(self.layout.short(np.concatenate(parts)), return_counts=True)
            cuts = np.concatenate([np.searchsorted(found, self.layout.short_edges()), [len(found)]])
            rows = [(k, int(b - a), _packed(np.diff(found[a:b], prepend=found[a])), _packed(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            rows = [(k, n, int(found[cuts[k]]).to_bytes(8, "little") + steps, many) for k, n, steps, many in rows]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([size] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                self.NAMES,
            )
        self.parts.clear()
        self.held = 0


def _frequent(tallied: DataFrame, layout: Layout, supports: dict[tuple[int, str], int]) -> dict[int, dict[int, np.ndarray]]:
    """By size and shard, a filter of the hashes whose counts add up to the support of their shard and language.

    A task sums one bucket of one shard. The slices of the filters that come to the driver have a fixed size.
    """
    slice_bits = layout.bits // layout.buckets

    def total(table: pa.Table) -> pa.Table:
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        keys = list(zip(table.column("size").to_pylist(), table.column("lang").to_pylist()))
        rows = defaultdict(list)
        for at, key in enumerate(keys):
            rows[key].append(at)
        slices = defaultdict(lambda: np.zeros(slice_bits, np.uint8))
        for (size, lang), at in rows.items():
            hashes, counts = [], []
            for k in at:
                n, steps, many = (table.column(c)[k].as_py() for c in ("n", "hashes", "counts"))
                hashes.append(np.cumsum(_unpacked(steps[8:], n)) + int.from_bytes(steps[:8], "little"))
                counts.append(_unpacked(many, n))
            hashes, counts = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            keep = np.add.reduceat(counts, first) >= supports[shard, lang]
            slices[size][layout.bit_of_short(hashes[first[keep]]) - bucket * slice_bits] = 1
        made = {size: np.packbits(s, bitorder="little").tobytes() for size, s in slices.items() if s.any()}
        n = len(made)
        return pa.table([pa.array([shard] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(list(made), pa.int32()), pa.array(list(made.values()), pa.binary())], names=["shard", "bucket", "size", "slice"])

    filters: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    step = slice_bits // 8
    for r in tallied.groupBy("shard", "bucket").applyInArrow(total, "shard int, bucket int, size int, slice binary").collect():
        whole = filters[r["size"]].setdefault(r["shard"], np.zeros(layout.bits // 8, np.uint8))
        whole[r["bucket"] * step : (r["bucket"] + 1) * step] = np.frombuffer(r["slice"], np.uint8)
    return filters


def _grams(words: Words, salts: np.ndarray, most: int, which: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes, fits) for n-grams of 1 to ``most`` words; the arrays have one entry per possible first word."""
    single = words.hashes(salts, which)
    found = single
    for size in range(1, most + 1):
        if size > 1:
            found = longer(found, single, size)
        yield size, found, words.spans(size)[: len(found)]


def _mined_locally(parted: DataFrame, size: int, layout: Layout, supports: dict, below: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Filters, one per shard, of the phrases of ``size`` words that are frequent in the shard.

    Both phrases of one word less inside a phrase must be frequent there too (``below``), so all are found.
    """
    shared = parted.sparkSession.sparkContext.broadcast(below)

    def tally(batches):
        counts, below = _Tally(layout), shared.value
        for words, salts, runs in _batches(batches):
            grams = list(_grams(words, salts, size))
            fits, found = grams[-1][2].copy(), grams[-1][1]
            if size > 2:
                bits = layout.bit(grams[-2][1])
                for _, shard, a, b in runs:
                    held = _has(below[shard], bits[a:b]) if shard in below else np.zeros(len(bits[a:b]), bool)
                    part = fits[a:b]
                    part &= held[: len(part)]
                    part[: len(held) - 1] &= held[1 : len(part) + 1]
            for lang, shard, a, b in runs:
                counts.add(shard, size, lang, found[a:b][fits[a:b]])
            yield from counts.flush(HELD)
        yield from counts.flush()

    return _frequent(parted.mapInArrow(tally, _Tally.SCHEMA), layout, supports).get(size, {})


def _counted_globally(parted: DataFrame, layout: Layout, langs: list[str], support: int, union: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Filters, one per size, of the words and candidates whose hashes reach the support over all documents."""
    shared = parted.sparkSession.sparkContext.broadcast(union)

    def tally(batches):
        counts, union = _Tally(layout), shared.value
        for words, salts, runs in _batches(batches):
            for size, found, fits in _grams(words, salts, max(union, default=1)):
                if size > 1:
                    fits = fits & _has(union[size], layout.bit(found)) if size in union else np.zeros(len(found), bool)
                for lang, _, a, b in runs:
                    counts.add(0, size, lang, found[a:b][fits[a:b]])
            yield from counts.flush(HELD)
        yield from counts.flush()

    found = _frequent(parted.mapInArrow(tally, _Tally.SCHEMA), layout, {(0, lang): support for lang in langs})
    return {size: shards[0] for size, shards in found.items()}


class _Phrases:
    """Counts of the different phrases of one language and size in a task; a phrase's words are put together once."""

    def __init__(self):
        self.one, self.two, self.counts = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))
        self.texts: np.ndarray = np.zeros(0, object)
        self.odd: dict[tuple[int, bytes], int] = defaultdict(int)

    def add(self, words: Words, size: int, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> int:
        """Adds the phrases that start at the words ``at`` with their two hashes; the bytes of new phrases."""
        first, n = _distinct(one, two)
        at, one, two = at[first], one[first], two[first]
        place = np.minimum(np.searchsorted(self.one, one), max(0, len(self.one) - 1))
        known = self.one[place] == one if len(self.one) else np.zeros(len(one), bool)
        same = known.copy()
        same[known] = self.two[place[known]] == two[known]
        self.counts[place[same]] += n[same]
        twin = np.concatenate([[False], one[1:] == one[:-1]]) | known & ~same  # another phrase has this hash
        for k in np.flatnonzero(twin & ~same).tolist():
            self.odd[int(one[k]), words.phrase(int(at[k]), size)] += int(n[k])
        new = np.flatnonzero(~known & ~twin)
        texts = np.empty(len(new), object)
        texts[:] = [words.phrase(k, size) for k in at[new].tolist()]
        self.one = np.concatenate([self.one, one[new]])
        order = np.argsort(self.one, kind="stable")
        self.one = self.one[order]
        self.two, self.counts, self.texts = (np.concatenate([old, more])[order] for old, more in ((self.two, two[new]), (self.counts, n[new]), (self.texts, texts)))
        return sum(map(len, texts))

    def rows(self, edges: np.ndarray) -> Iterator[tuple[int, list[bytes], list[int]]]:
        """(bucket, phrases, counts), by the first hash."""
        cuts = np.concatenate([np.searchsorted(self.one, edges), [len(self.one)]])
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield k, self.texts[a:b].tolist(), self.counts[a:b].tolist()
        for (one, text), n in self.odd.items():
            yield int(np.searchsorted(edges, np.uint64(one), "right")) - 1, [text], [n]


def _listed(texts: list[bytes], counts: list[int]) -> tuple[int, int, bytes, bytes]:
    """(number, bytes, phrases, counts): phrases in their order, so that neighbours share their beginnings, compressed.

    No phrase holds a line feed, as it ends a piece.
    """
    order = sorted(range(len(texts)), key=texts.__getitem__)
    joined = b"\n".join([texts[k] for k in order])
    return len(texts), len(joined), pa.compress(joined, codec="zstd", asbytes=True), _packed(np.array(counts, np.int64)[order])


def _unlisted(n: int, size: int, phrases: bytes, counts: bytes) -> tuple[pa.Array, pa.Array]:
    return pa.array(pa.decompress(phrases, size, codec="zstd", asbytes=True).split(b"\n"), pa.binary()), pa.array(_unpacked(counts, n))


def _texts(parted: DataFrame, layout: Layout, filters: dict[int, np.ndarray], support: int) -> DataFrame:
    """(lang, phrase, f): exact counts of the phrases in ``filters`` that reach the support, by their true words.

    A task adds up what it holds and hands on a list per bucket of hashes; the lists of a bucket are added up in one task.
    """
    shared = parted.sparkSession.sparkContext.broadcast(filters)

    def tally(batches):
        filters, most, edges = shared.value, max(shared.value, default=1), layout.bucket_edges()
        found: dict[tuple[str, int], _Phrases] = defaultdict(_Phrases)
        held = 0

        def flush():
            for (lang, _), phrases in found.items():
                rows = [(bucket, *_listed(texts, counts)) for bucket, texts, counts in phrases.rows(edges)]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *columns], ["lang", "bucket", "n", "size", "phrases", "counts"])
            found.clear()

        for words, salts, runs in _batches(batches):
            langs = [(lang, a, [r[3] for r in runs if r[0] == lang][-1]) for k, (lang, _, a, _) in enumerate(runs) if k == 0 or runs[k - 1][0] != lang]
            other = {size: second for size, second, _ in _grams(words, salts, most, 1)}
            for size, one, fits in _grams(words, salts, most):
                if size not in filters:
                    continue
                fits = fits & _has(filters[size], layout.bit(one))
                for lang, a, b in langs:
                    at = a + np.flatnonzero(fits[a:b])
                    held += found[lang, size].add(words, size, at, one[at], other[size][at])
            if held >= HELD_BYTES or sum(len(p.one) for p in found.values()) >= HELD_PHRASES:
                yield from flush()
                held = 0
        yield from flush()

    def total(table: pa.Table) -> pa.Table:
        parts = [_unlisted(*row) for row in zip(*(table.column(c).to_pylist() for c in ("n", "size", "phrases", "counts")))]
        flat = pa.table([pa.chunked_array(c, k) for c, k in zip(zip(*parts), (pa.binary(), pa.int64()))], names=["phrase", "n"]).group_by("phrase").aggregate([("n", "sum")])
        flat = flat.filter(pc.greater_equal(flat.column("n_sum"), support))
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * flat.num_rows, pa.string()), flat.column("phrase"), flat.column("n_sum")], names=["lang", "phrase", "f"])

    listed = parted.mapInArrow(tally, "lang string, bucket int, n int, size bigint, phrases binary, counts binary")
    return listed.groupBy("lang", "bucket").applyInArrow(total, "lang string, phrase binary, f bigint")


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of each different pair of hashes, in the order of ``one``."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two phrases share one hash: order by both
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same])[: len(one)])
    return order[first], np.diff(np.concatenate([first, [len(one)]]))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 30, max_words: int = 4, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, words, f) of all phrases of 1 to ``max_words`` words with f >= ``support``, and (lang, n).

    SON: documents fall into ``shards`` by a hash of the text. Each is mined completely, size by size, at the
    support times its part of the language's words, rounded up; a phrase that is below this everywhere is below
    the support. The union of the local results is counted over all documents, first by hash to leave out
    what cannot reach the support, then by its words. A language's null is ``und``; n counts all words.
    """
    parted = _parted(docs, text_col, lang_col, shards)
    weights = stored(_word_counts(parted), "phrase-weights")
    per_lang = weights.groupBy("lang").agg(F.sum("n").alias("n"))
    share = {(r["shard"], r["lang"]): r["n"] for r in weights.collect()}
    total = {r["lang"]: r["n"] for r in per_lang.collect()}
    supports = {k: max(1, -(-support * n // max(1, total[k[1]]))) for k, n in share.items()}
    layout = Layout.of(sum(total.values()), shards)
    union: dict[int, np.ndarray] = {}
    below: dict[int, np.ndarray] = {}
    for size in range(2, max_words + 1):
        below = _mined_locally(parted, size, layout, supports, below)
        if not below:
            break
        union[size] = np.bitwise_or.reduce(list(below.values()))
    filters = _counted_globally(parted, layout, list(total), support, union)
    counts = _texts(parted, layout, filters, support)
    phrase = F.col("phrase").cast("string")
    counts = counts.select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("words"), "f")
    return stored(counts, "phrase-counts"), per_lang


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 30, max_words: int = 4, cover: int = 80, top: int = 2000, shards: int = SHARDS, salts: int = 64) -> DataFrame:
    """Each language's best phrases of 2 to ``max_words`` words: (lang, rank, phrase, a, l, r, n, score).

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut (ties: the shortest first part), and
    the score is floor(2000000 a / (l + r)). A phrase is left out if a longer frequent one that contains it has at
    least ``cover`` per cent of its count. Order: score, then a, both descending, then phrase by its bytes.

    Null texts are empty, null languages ``und``; equal rows count each. Words are as long as they are; very long
    texts are read whole. An empty table, or texts without frequent phrases, give no rows. Other columns are not read.
    """
    counts, per_lang = frequent_phrases(docs, text_col, lang_col, support, max_words, shards)
    split = F.split("phrase", " ")
    long = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), split.alias("w"))

    def joined(w, start, length):
        return F.array_join(F.slice(w, start, length), " ")

    cuts = long.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    score = F.expr("cast((2000000bd * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    size = F.col("words")
    inner = long.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    inner = inner.select("lang", "a", joined(F.col("w"), F.col("s"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    covered = F.expr(f"100bd * cast(_longer as decimal(20, 0)) >= {cover}bd * cast(a as decimal(20, 0))")
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | ~covered)
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
