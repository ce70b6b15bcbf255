"""Repeated substrings across documents, found by merging shard Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import build, least_per_window
from .common import scratch, stored
from .token_output import _files

#: Bytes of a repeated string, and of the grams among which each one's anchor is chosen.
LENGTH = 50
GRAM = 20
#: Bytes of text per shard, of anchors per counting bucket and of strings per merge bucket, on average.
SHARD_BYTES = 64 << 20
COUNT_BYTES = 64 << 20
MERGE_BYTES = 1 << 19
#: Documents from which an anchor's windows are dealt out one by one instead of together.
HEAVY = 50_000
#: Windows whose anchors are found at once; the arrays stay in a core's cache.
CHUNK = 1 << 16
#: Texts whose anchors are found together.
MOST_TEXTS = 1 << 10
NO_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as far as a chunk needs them."""
    if not _TABLES:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _TABLES.append(np.cumprod(np.full(CHUNK + LENGTH, base, np.uint64)))
    return _TABLES[0], _TABLES[1]


def _least(part: np.ndarray) -> np.ndarray:
    """Of each window of CHUNK + LENGTH - 1 bytes at most: the least hash of its GRAM-byte strings."""
    up, down = _powers()
    reach = LENGTH - GRAM + 1
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down[: len(part)], dtype=np.uint64, out=total[1:])
    least = _mix((total[GRAM:] - total[:-GRAM]) * up[: len(part) - GRAM + 1])
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    return least


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor): runs of neighbouring LENGTH-byte windows with the same anchor.

    A window's anchor is the least hash of its GRAM-byte strings, so equal windows have equal anchors
    wherever they stand, and about 16 neighbours share one. Every window is in exactly one run.
    """
    windows = len(data) - LENGTH + 1
    start, value, last = [], [], None
    for at in range(0, max(windows, 0), CHUNK):
        least = _least(data[at : min(at + CHUNK, windows) + LENGTH - 1])
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        if last is None or least[0] != last:
            change = np.concatenate([[0], change])
        start.append(change + at)
        value.append(least[change])
        last = least[-1]
    if not start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate(start)
    return first, np.diff(np.append(first, windows)), _mix(np.concatenate(value) + np.uint64(1))


def anchors_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, anchor): the runs of :func:`anchors` of each text, in order.

    Several texts have CHUNK bytes together at most and are hashed as one, so that short texts do not
    cost the calls of a text each; a window that reaches into the next text is in no run.
    """
    length = np.array([len(x) for x in texts], np.int64)
    windows = int(length.sum()) - LENGTH + 1
    if len(texts) == 1 or windows < 1:
        start, windows, anchor = anchors(texts[0] if len(texts) == 1 else np.zeros(0, np.uint8))
        return np.zeros(len(start), np.int64), start, windows, anchor
    least = _least(np.concatenate(texts))
    first = np.cumsum(length) - length
    stop = first + np.maximum(length - LENGTH + 1, 0)
    change = np.ones(windows, bool)
    change[1:] = least[1:] != least[:-1]
    for edge in (first, stop):
        change[edge[edge < windows]] = True
    start = np.flatnonzero(change)
    text = np.searchsorted(first, start, "right") - 1
    inside = start < stop[text]
    many = np.diff(np.append(start, windows))[inside]
    start, text = start[inside], text[inside]
    return text, start - first[text], many, _mix(least[start] + np.uint64(1))


def _key(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Counting bucket and 32 further bits of an anchor. Different anchors with one key only cost work."""
    return ((anchor % np.uint64(buckets)) << np.uint64(32)) | (anchor >> np.uint64(32))


def _holds(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _u4(blob) -> np.ndarray:
    return np.frombuffer(blob, np.uint32)


# -- tables by shard ----------------------------------------------------------------------


def _by_shard(df: DataFrame, shards: int, label: str) -> str:
    """Writes ``df`` with one folder per shard, for tasks that read the part of their own shard."""
    path = scratch(df.sparkSession, label)
    df.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    return path


def _of_shard(path: str, shard: int) -> list[dict]:
    files, root = _files(path)
    if files.get_file_info(f"{root}/_SUCCESS").type.name != "File":
        raise FileNotFoundError(f"{path} is not complete")
    folder = f"{root}/shard={shard}"
    if files.get_file_info(folder).type.name != "Directory":
        return []
    found = files.get_file_info(pafs.FileSelector(folder))
    return [row for f in found if f.path.endswith(".parquet") for row in pq.ParquetFile(files.open_input_file(f.path)).read().to_pylist()]


def _repeated(path: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the shard's anchors that occur in several documents, and of the heavy ones."""
    rows = _of_shard(path, shard)
    out = []
    for name in ("kept", "heavy"):
        keys = [(np.uint64(r["bucket"]) << np.uint64(32)) | _u4(r[name]).astype(np.uint64) for r in rows]
        out.append(np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64))
    return out[0], out[1]


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int | None, np.ndarray]]]]:
    """(shard, documents as (id, bytes)) for each run of rows of one shard."""

    def rows():
        for batch in batches:
            for shard, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield shard, doc, np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)

    for shard, own in groupby(rows(), key=lambda r: r[0]):
        yield shard, ((doc, data) for _, doc, data in own)


def _together(docs: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, texts) of neighbouring documents of CHUNK bytes together at most, or of one."""
    ids, texts, size = [], [], 0
    for doc, data in docs:
        if texts and (size + len(data) > CHUNK or len(texts) == MOST_TEXTS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc)
        texts.append(data)
        size += len(data)
    if texts:
        yield ids, texts


def _ranked(ids: list[int | None]) -> list[int]:
    return [NO_ID if i is None else i for i in ids]


def _once_each(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The keys of each text, each once; ``text`` ascends."""
    by = np.argsort(keys, kind="stable")
    text, keys = text[by], keys[by]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[fresh]


# -- the steps ----------------------------------------------------------------------------


def _count_anchors(buckets: int):
    """Per shard and counting bucket: the anchors of its documents, each once, and in how many documents they are."""

    def run(batches):
        for shard, docs in _shards_of(batches):
            found = []
            for _, texts in _together(docs):
                text, _, _, anchor = anchors_of(texts)
                found.append(_once_each(text, _key(anchor, buckets)))
            keys, many = np.unique(np.concatenate(found), return_counts=True)
            cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            rows = []
            for b in range(buckets):
                own, n = keys[cut[b] : cut[b + 1]].astype(np.uint32), many[cut[b] : cut[b + 1]]
                if len(own):
                    rows.append((b, shard, own[n == 1].tobytes(), own[n > 1].tobytes(), n[n > 1].astype(np.uint32).tobytes()))
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "shard", "once", "often", "counts"])

    return run


def _keep_repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one counting bucket: which anchors of each shard occur in two documents anywhere, and which in HEAVY."""
    once = np.concatenate([_u4(b) for b in pdf["once"]])
    often = np.concatenate([_u4(b) for b in pdf["often"]])
    counts = np.concatenate([_u4(b) for b in pdf["counts"]]).astype(np.int64)
    keys, place = np.unique(np.concatenate([once, often]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([np.ones(len(once)), counts]), minlength=len(keys))
    repeated, heavy = keys[total >= 2], keys[total >= HEAVY]
    rows = []
    for r in pdf.itertuples():
        own = np.concatenate([_u4(r.once), _u4(r.often)])
        rows.append((r.shard, r.bucket, np.sort(own[_holds(repeated, own)]).tobytes(), np.sort(own[_holds(heavy, own)]).tobytes()))
    return pd.DataFrame(rows, columns=["shard", "bucket", "kept", "heavy"])


def _strings(texts: list[np.ndarray], buckets: int, kept: np.ndarray, heavy: np.ndarray) -> list[tuple[int, int, bytes, int]]:
    """(text, start, string, bucket hash) of the texts' runs whose anchor is repeated, in their order.

    A heavy anchor's run is given as its single windows, so that no merge bucket has to hold all
    strings around a passage that very many documents share.
    """
    text, start, windows, anchor = anchors_of(texts)
    keys = _key(anchor, buckets)
    own = np.flatnonzero(_holds(kept, keys))
    if not len(own):
        return []
    raw = [x.tobytes() for x in texts]
    apart = _holds(heavy, keys[own])
    out = []
    for t, s, n, a, alone in zip(*(x[own].tolist() for x in (text, start, windows, anchor)), apart.tolist()):
        if alone:
            for i in range(s, s + n):
                w = raw[t][i : i + LENGTH]
                out.append((t, i, w, xxhash.xxh3_64_intdigest(w)))
        else:
            out.append((t, s, raw[t][s : s + n + LENGTH - 1], a >> 7))
    return out


def _shard_transforms(path: str, count_buckets: int, merge_buckets: int):
    """Per shard and merge bucket: the transform of its distinct strings, each with the least id that has it."""

    def run(batches):
        for shard, docs in _shards_of(batches):
            kept, heavy = _repeated(path, shard)
            least: dict[int, dict[bytes, int]] = {}
            for ids, texts in _together(docs):
                ids = _ranked(ids)
                for t, _, string, h in _strings(texts, count_buckets, kept, heavy):
                    own = least.setdefault(h % merge_buckets, {})
                    if own.get(string, NO_ID) >= ids[t]:
                        own[string] = ids[t]
            rows = []
            for bucket, own in least.items():
                strings = list(own)
                marks = b"".join(xxhash.xxh3_128_digest(s) for s in strings)
                made = build(strings).tobytes()
                ids = np.fromiter(own.values(), np.int64).tobytes()
                rows.append((bucket, shard, len(made), _packed(made), _packed(ids), marks))
                if len(rows) == 64:
                    yield _transforms(rows)
                    rows = []
            if rows:
                yield _transforms(rows)

    return run


def _transforms(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "shard", "n", "bwt", "ids", "marks"])


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind)


def _merge_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges a bucket's transforms; per shard the least id of each window of its strings, in runs of equal ids."""
    pdf = pdf.sort_values(["shard", "marks"], kind="stable")
    values = [_unpacked(b, len(m) // 2, np.int64) for b, m in zip(pdf["ids"], pdf["marks"])]  # a mark has 16 bytes, an id 8
    least, many = least_per_window([_unpacked(b, n, np.uint8) for b, n in zip(pdf["bwt"], pdf["n"])], np.concatenate(values), LENGTH)
    first = np.concatenate([[0], np.cumsum(many)])
    change = np.zeros(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    change[first[:-1]] = True
    cut = np.flatnonzero(change)
    runs = np.diff(np.append(cut, len(least))).astype(np.uint32)
    ids = least[cut]
    of_string = np.searchsorted(cut, first)
    rows, at = [], 0
    for r, v in zip(pdf.itertuples(), values):
        lo, hi = of_string[at], of_string[at + len(v)]
        per = np.diff(of_string[at : at + len(v) + 1]).astype(np.uint32)
        rows.append((r.shard, hi - lo, r.marks, _packed(per.tobytes()), _packed(runs[lo:hi].tobytes()), _packed(ids[lo:hi].tobytes())))
        at += len(v)
    return pd.DataFrame(rows, columns=["shard", "n", "marks", "per", "runs", "ids"])


def _removed(docs: list[int], texts: list[np.ndarray], strings: list[tuple], found: dict[bytes, int], first: np.ndarray, runs: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, int]]]:
    """(begin, end) of each text's runs of bytes under windows whose least id is below the document's own."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not strings:
        return out
    k = np.array([found[xxhash.xxh3_128_digest(string)] for _, _, string, _ in strings])
    text = np.array([t for t, *_ in strings])
    # places in all texts, with a byte between two of them, so that no run reaches over it
    length = np.array([len(x) + 1 for x in texts], np.int64)
    base = np.cumsum(length) - length
    begin = np.array([start for _, start, _, _ in strings]) + base[text]
    per = first[k + 1] - first[k]  # one run at least
    head = np.cumsum(per) - per
    own = np.repeat(first[k] - head, per) + np.arange(int(per.sum()))
    length = runs[own].astype(np.int64)
    before = np.cumsum(length) - length
    start = before + np.repeat(begin - before[head], per)
    gone = ids[own] < np.repeat(np.array(docs, np.int64)[text], per)
    start, end = start[gone], (start + length + LENGTH - 1)[gone]
    if len(start):  # both ascend
        apart = np.flatnonzero(start[1:] > end[:-1]) + 1
        start, end = start[np.append(0, apart)], end[np.append(apart - 1, len(end) - 1)]
        text = np.searchsorted(base, start, "right") - 1
        for t, a, b in zip(text.tolist(), (start - base[text]).tolist(), (end - base[text]).tolist()):
            out[t].append((a, b))
    return out


def _without(data: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    raw = data.tobytes()
    return b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)])) if spans else raw


def _remove(path: str, results: str, buckets: int):
    def run(batches):
        for shard, docs in _shards_of(batches):
            kept, heavy = _repeated(path, shard)
            found: dict[bytes, int] = {}
            strings = 0
            per, runs, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for row in _of_shard(results, shard):
                marks = row["marks"]
                for i in range(0, len(marks), 16):  # a shard that two tasks read may list a string twice, with the same ids
                    found[marks[i : i + 16]] = strings
                    strings += 1
                per.append(_unpacked(row["per"], len(marks) // 4, np.uint32))
                runs.append(_unpacked(row["runs"], 4 * row["n"], np.uint32))
                ids.append(_unpacked(row["ids"], 8 * row["n"], np.int64))
            first = np.concatenate([[0], np.cumsum(np.concatenate(per), dtype=np.int64)])
            runs, ids = np.concatenate(runs), np.concatenate(ids)
            rows = []
            size = 0
            for own, texts in _together(docs):
                spans = _removed(_ranked(own), texts, _strings(texts, buckets, kept, heavy), found, first, runs, ids)
                for doc, data, gone in zip(own, texts, spans):
                    rows.append((doc, len(data), gone, _without(data, gone)))
                    size += len(data)
                if size > 1 << 22 or len(rows) > 1 << 14:
                    yield _results(rows)
                    rows, size = [], 0
            if rows:
                yield _results(rows)

    return run


def _results(rows: list[tuple]) -> pa.RecordBatch:
    doc, n_bytes, spans, kept = zip(*rows)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
    flat = np.array([x for own in spans for x in own], np.int64).reshape(-1, 2)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n_bytes, pa.int64()), lists, pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): what is left of each text without strings that a smaller id has too.

    A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id; strings
    never cross documents, and all of them are judged on the input. ``spans`` are the removed byte
    ranges, ``kept`` the other bytes. Ids are whole numbers; a null id counts as larger than any
    other, documents with the same id don't remove from each other. Null text counts as empty, texts
    below LENGTH bytes stay whole, repeated rows give repeated results, an empty table no rows. Other
    columns are ignored.

    1. A slim copy of the table gets a shard number per row. 2. Anchors are counted: which of a
    shard's anchors occur in several documents at all. Only windows with such an anchor can be
    repeated. 3. Each shard builds the transforms of its strings around these anchors, by merge
    bucket: equal windows have equal anchors and so meet in one bucket. 4. Per bucket the shards'
    transforms are merged; the intervals of LENGTH equal characters give each window's least id.
    5. Each shard looks up its strings and removes. A string that occurs often in a shard enters
    its transform once; an anchor in HEAVY documents or more is spread over buckets by window.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slim = slim.coalesce(max(1, -(-size // SHARD_BYTES))).select(F.spark_partition_id().alias("shard"), "id", "text")
    base = stored(slim, "substring-shards")
    count_buckets, merge_buckets = -(-size // COUNT_BYTES) + 1, -(-size // MERGE_BYTES) + 1
    shards = max(1, base.agg(F.max("shard")).first()[0] or 0) + 1

    counted = base.mapInArrow(_count_anchors(count_buckets), "bucket int, shard int, once binary, often binary, counts binary")
    kept = counted.groupBy("bucket").applyInPandas(_keep_repeated, "shard int, bucket int, kept binary, heavy binary")
    kept_path = _by_shard(kept, shards, "substring-anchors")

    transforms = base.mapInArrow(_shard_transforms(kept_path, count_buckets, merge_buckets), "bucket int, shard int, n int, bwt binary, ids binary, marks binary")
    merged = transforms.groupBy("bucket").applyInPandas(_merge_bucket, "shard int, n int, marks binary, per binary, runs binary, ids binary")
    merged_path = _by_shard(merged, shards, "substring-least")

    spans = "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    out = base.mapInArrow(_remove(kept_path, merged_path, count_buckets), spans)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
