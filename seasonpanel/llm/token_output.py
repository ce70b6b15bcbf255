"""Token sequences in training order, in fixed-stride binary shards."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored
from .feistel import permute

#: Where the vocabulary (ranks of a byte-level BPE) is read on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published splitting pattern of that vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE = 2_048
#: Bytes of a shard on average.
SHARD_BYTES = 32 << 20
#: Sequence numbers: input partition * PER_PARTITION + place in it; the permutation runs over all of them.
PARTITIONS, PER_PARTITION = 1_000_000, 4_000_000
#: Characters encoded at once; longer texts are cut at white space.
CHUNK = 1 << 20


@dataclass
class Layout:
    """What a reader needs besides the shards: the manifest."""

    sequence: int
    dtype: str
    end_of_text: int
    key: int
    #: Sequences in each shard, in order.
    counts: list[int]

    @property
    def stride(self) -> int:
        return self.sequence * np.dtype(self.dtype).itemsize

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoding: tiktoken.Encoding, text: str | None) -> list[int]:
    """Token ids of a whole text; texts over CHUNK are encoded in parts that end before a white space.

    Decoding gives the text again in either case; a null text has no token.
    """
    text = text or ""
    if len(text) <= CHUNK:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            end = cut if cut > at else end
        out += encoding.encode_ordinary(text[at:end])
        at = end
    return out


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder.removeprefix("file:")


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def pack(docs: DataFrame, ranks: dict[bytes, int], shards: int, key: int = 0, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, virtual, n_tokens, doc_ids, tokens): packed sequences with their place in the order.

    Each document is followed by the end-of-text id; the stream of an input partition is cut every
    ``sequence`` tokens and its last piece is filled up with that id. A sequence's number goes
    through the keyed permutation to its virtual slot, and equal ranges of virtual slots are the
    shards. ``docs`` must give the same rows in the same order when a task is repeated, as a table does.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    end = max(ranks.values(), default=-1) + 1
    dtype = "<u2" if end < 1 << 16 else "<u4"
    domain = PARTITIONS * PER_PARTITION
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(shared.value)
        number = TaskContext.get().partitionId() * PER_PARTITION
        last = number + PER_PARTITION
        held, ids, room = [], [], sequence
        done: list[tuple[bytes, int, list]] = []
        kinds = None

        def close():
            nonlocal held, ids, room
            row = np.full(sequence, end, dtype)
            tokens = np.concatenate(held)
            row[: len(tokens)] = tokens
            done.append((row.tobytes(), len(tokens), ids))
            held, ids, room = [], [], sequence

        def batch_of() -> pa.RecordBatch:
            nonlocal done, number
            if number + len(done) > last:
                raise ValueError("an input partition has more sequences than PER_PARTITION")
            virtual = permute(np.arange(number, number + len(done)), domain, key)
            number += len(done)
            shard = [int(v) * shards // domain for v in virtual]
            out = pa.RecordBatch.from_arrays([
                pa.array(shard, pa.int32()), pa.array(virtual), pa.array([d[1] for d in done], pa.int32()),
                pa.array([d[2] for d in done], pa.list_(kinds)), pa.array([d[0] for d in done], pa.binary())],
                ["shard", "virtual", "n_tokens", "doc_ids", "tokens"])
            done = []
            return out

        for batch in batches:
            kinds = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*encode(encoding, text.as_py()), end], dtype)
                at = 0
                while at < len(tokens):
                    piece = tokens[at : at + room]
                    held.append(piece)
                    ids.append(doc_id)
                    at += len(piece)
                    room -= len(piece)
                    if not room:
                        close()
                if len(done) >= 256:
                    yield batch_of()
        if held:
            close()
        if done:
            yield batch_of()

    return docs.select(id_col, text_col).mapInArrow(run, f"shard int, virtual long, n_tokens int, doc_ids array<{id_type}>, tokens binary")


def write_shards(packed: DataFrame, shards: int, folder: str) -> DataFrame:
    """Writes each shard as one file of fixed-stride records, in the order of the virtual slots.

    Returns (shard, row, n_tokens, doc_ids, sha256) of each record; the files are written when it is
    run. A task streams its shards to files of its own and moves them into place at their end. A
    repeated task writes the same bytes, so lost executors and second attempts do no harm.
    """
    id_type = packed.schema["doc_ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        shard, row, out, temp = None, 0, None, None

        def finish():
            if out is not None:
                out.close()
                files.move(temp, f"{root}/{shard_name(shard)}")

        for batch in batches:
            rows = []
            for s, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens")):
                if s != shard:
                    finish()
                    shard, row, temp = s, 0, f"{root}/.{shard_name(s)}.{uuid.uuid4().hex}"
                    out = files.open_output_stream(temp)
                data = tokens.as_buffer()
                out.write(data)
                rows.append((row, hashlib.sha256(data).hexdigest()))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array([r[0] for r in rows], pa.int64()), batch.column("n_tokens"), batch.column("doc_ids"), pa.array([r[1] for r in rows], pa.string())],
                ["shard", "row", "n_tokens", "doc_ids", "sha256"])
        finish()

    ranged = packed.repartitionById(shards, "shard").sortWithinPartitions("shard", "virtual")
    return ranged.mapInArrow(run, f"shard int, row long, n_tokens int, doc_ids {id_type}, sha256 string")


def token_output(docs: DataFrame, folder: str | None = None, vocabulary_path: str = VOCABULARY, key: int = 0, sequence: int = SEQUENCE,
                 shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Tokenises ``docs`` to shards and a manifest in ``folder``; returns (index, folder).

    The index has one row per sequence: slot (its place in training order, 0 .. N-1 without gaps),
    shard, row, n_tokens, doc_ids (whose tokens it holds, in order) and sha256 of the record. The
    record of a slot begins at row * stride of its shard; see :func:`read_records`.

    A null or empty text gives its end-of-text id only. Ids are carried, not used: null and repeated
    ids and repeated rows are kept like others. An empty table gives a manifest without shards.
    Other columns are ignored. One line per shard comes to the driver, for the manifest.
    """
    spark = docs.sparkSession
    folder = (folder or scratch(spark, "tokens")).rstrip("/")
    ranks = vocabulary(vocabulary_path)
    end = max(ranks.values(), default=-1) + 1
    dtype = "<u2" if end < 1 << 16 else "<u4"
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(4))).first()[0] or 0
    # about four tenths of the bytes become tokens; only the number of shards rests on this
    shards = int(max(1, size * 0.4 * np.dtype(dtype).itemsize // shard_bytes))
    index = stored(write_shards(pack(docs, ranks, shards, key, sequence, id_col, text_col), shards, folder), "token-index")
    counts = {r["shard"]: r["n"] for r in index.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = Layout(sequence, dtype, end, key, [counts.get(s, 0) for s in range(shards)])
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(asdict(layout)).encode())
    first = spark.createDataFrame([(s, int(n)) for s, n in enumerate(layout.starts[:-1])], "shard int, _first long")
    slot = (F.col("_first") + F.col("row")).alias("slot")
    return index.join(first, "shard").select(slot, "shard", "row", "n_tokens", "doc_ids", "sha256"), folder


def manifest(folder: str) -> Layout:
    files, root = _files(folder)
    with files.open_input_stream(f"{root}/manifest.json") as src:
        return Layout(**json.loads(src.read()))


def read_records(folder: str, slot: int = 0, layout: Layout | None = None) -> Iterator[np.ndarray]:
    """Sequences from ``slot`` on, in training order: one seek, then sequential reads."""
    layout = layout or manifest(folder)
    files, root = _files(folder)
    starts = layout.starts
    shard = int(np.searchsorted(starts, slot, side="right")) - 1
    while shard < len(layout.counts):
        if layout.counts[shard]:
            with files.open_input_file(f"{root}/{shard_name(shard)}") as src:
                src.seek(int(slot - starts[shard]) * layout.stride)
                for _ in range(int(starts[shard + 1] - slot)):
                    yield np.frombuffer(src.read(layout.stride), layout.dtype)
        shard += 1
        slot = int(starts[min(shard, len(starts) - 1)])


def verified(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """``index`` with ``intact``: the shard files, read again one per task, hold the record of that row."""
    layout = manifest(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                sums = []
                with files.open_input_stream(f"{root}/{shard_name(shard)}") as src:
                    while record := src.read(layout.stride):
                        sums.append(hashlib.sha256(record).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int64()), pa.array(sums, pa.string())], ["shard", "row", "_found"])

    names = [(s,) for s, n in enumerate(layout.counts) if n]
    found = spark.createDataFrame(names, "shard int").repartition(max(1, len(names))).mapInArrow(run, "shard int, row long, _found string")
    return index.join(found, ["shard", "row"], "left").withColumn("intact", F.coalesce(F.col("_found") == F.col("sha256"), F.lit(False))).drop("_found")
