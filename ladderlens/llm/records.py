"""Length-delimited binary records of token ids (the TFRecord framing).

A record is its length (8 bytes, little-endian), the length's masked CRC-32C, the data and the data's
masked CRC-32C. The data are the document's id (8 bytes) and its token ids (2 or 4 bytes each). A shard
holds a range of documents in ascending id order and has an index file beside it with each record's
offset, size and tokens, so that a reader can shuffle without scanning.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import documents, shared_dir, staged, text_blocks
from ladderlens.llm.tokens import OWNER, WORDS_AT_ONCE, default_path, encoder

NO_ID = -(1 << 63)
INDEX = np.dtype([("offset", "<u8"), ("size", "<u4"), ("tokens", "<u4")])
FRAME = 16
READ_BYTES = 1 << 22
CHUNK = 512
#: Shards that a task keeps open while it reads out of order.
OPEN_FILES = 64
# Fixed values of the format.
CRC32C_POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


class CorruptRecord(ValueError):
    """A record whose frame or checksums do not hold."""


def _tables() -> tuple[np.ndarray, list[list[int]]]:
    """What a byte contributes to the CRC by its distance to the end, and how CHUNK zero bytes move it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(CRC32C_POLYNOMIAL), one >> 1)
    rows = [one]
    for _ in range(CHUNK - 1):
        rows.append(one[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.array(rows), [rows[CHUNK - 1 - i].tolist() for i in range(4)]


BY_DISTANCE, MOVE = _tables()
ROW = np.arange(CHUNK - 1, -1, -1, dtype=np.int32) * 256  # where each byte's row of the table starts


def masked_crc32c(data: list[bytes]) -> list[int]:
    """Masked CRC-32C of byte strings of at least 4 bytes, most of the work for all of them together."""
    sizes = np.array([len(x) for x in data])
    chunks = -(-sizes // CHUNK)
    flat = np.zeros((int(chunks.sum()), CHUNK), dtype=np.uint8)
    raw, ends = flat.reshape(-1), np.cumsum(chunks) * CHUNK
    for x, n, end in zip(data, sizes.tolist(), ends.tolist()):
        raw[end - n : end] = np.frombuffer(x, dtype=np.uint8)
        raw[end - n : end - n + 4] ^= 255  # the initial value, all ones
    crc = np.empty(len(flat), dtype=np.uint32)
    table = BY_DISTANCE.ravel()
    for low in range(0, len(flat), 64):
        np.bitwise_xor.reduce(table.take(flat[low : low + 64] + ROW), axis=1, out=crc[low : low + 64])
    out, at, parts = [], 0, crc.tolist()
    m0, m1, m2, m3 = MOVE
    for n in chunks.tolist():
        x = 0
        for part in parts[at : at + n]:
            x = m0[x & 255] ^ m1[x >> 8 & 255] ^ m2[x >> 16 & 255] ^ m3[x >> 24] ^ part
        at += n
        x ^= 0xFFFFFFFF
        out.append(((x >> 15 | x << 17) + MASK_DELTA) & 0xFFFFFFFF)
    return out


@lru_cache(1 << 16)
def _length_crc(n: int) -> int:
    return masked_crc32c([n.to_bytes(8, "little")])[0]


def framed(data: list[bytes]) -> list[bytes]:
    return [len(x).to_bytes(8, "little") + _length_crc(len(x)).to_bytes(4, "little") + x + crc.to_bytes(4, "little") for x, crc in zip(data, masked_crc32c(data) if data else ())]


def unframed(raw: bytes, sizes: list[int]) -> list[bytes]:
    """The data of consecutive records of known data sizes, with their frames verified."""
    lengths, data, at = [], [], 0
    marks = []
    for n in sizes:
        lengths.append(raw[at : at + 8])
        data.append(raw[at + 12 : at + 12 + n])
        marks.append((raw[at + 8 : at + 12], raw[at + 12 + n : at + FRAME + n]))
        at += FRAME + n
    if at != len(raw) or any(int.from_bytes(x, "little") != n for x, n in zip(lengths, sizes)):
        raise CorruptRecord("a record's length is not the index's")
    for (a, b), x, y in zip(marks, map(_length_crc, sizes), masked_crc32c(data)):
        if int.from_bytes(a, "little") != x or int.from_bytes(b, "little") != y:
            raise CorruptRecord("a record's checksum is wrong")
    return data


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


def write_records(docs: DataFrame, folder: str, shards: int, path: str) -> DataFrame:
    """Write docs (doc_id, text) as shards in ascending doc_id order; returns (shard, records, tokens, bytes).

    A task writes its shard under a name of its own attempt and then renames it, so a repeated or lost
    attempt leaves no half shard. Null ids come first, equal ids in order of their text's hash; a
    null text counts as empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, base = _store(folder)
        name, records, tokens, offset, out = f"{base}/shard-{shard:06d}", 0, 0, 0, None
        for part, texts in text_blocks(batches, owner=OWNER, size=WORDS_AT_ONCE):
            if out is None:
                store.create_dir(base, recursive=True)
                out, index = store.open_output_stream(f"{name}.records.{attempt}"), store.open_output_stream(f"{name}.index.{attempt}")
            ids = encoder(path).encode(texts)
            numbers = [NO_ID if x is None else x for x in part.column("doc_id").to_pylist()]
            data = [i.to_bytes(8, "little", signed=True) + x.tobytes() for i, x in zip(numbers, ids)]
            out.write(b"".join(framed(data)))
            entries = np.empty(len(data), dtype=INDEX)
            entries["size"], entries["tokens"] = [len(x) for x in data], [len(x) for x in ids]
            ends = np.cumsum(entries["size"].astype(np.int64) + FRAME) + offset
            entries["offset"] = np.concatenate([[offset], ends[:-1]])
            index.write(entries.tobytes())
            records, tokens, offset = records + len(data), tokens + int(entries["tokens"].sum()), int(ends[-1])
        if out is not None:
            out.close(), index.close()
            for kind in ("records", "index"):
                store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, records, tokens, offset)], names=["shard", "records", "tokens", "bytes"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(ordered.mapInArrow(write, "shard long, records long, tokens long, bytes long"), "manifest")


def read_records(manifest: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, offset) from the files: start counts the ids of all
    documents before, from the manifest's totals (one row a shard) and the shard's own index."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], start))
        start += r["tokens"]
    kind = np.dtype("<u4" if wide else "<u2")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{base}/shard-{shard:06d}.index") as f:
                    index = np.frombuffer(f.read(), dtype=INDEX)
                ends = np.cumsum(index["size"].astype(np.int64) + FRAME)
                starts = start + np.cumsum(index["tokens"].astype(np.int64)) - index["tokens"]
                with store.open_input_stream(f"{base}/shard-{shard:06d}.records") as f:
                    low = 0
                    while low < len(index):
                        high = max(low + 1, int(np.searchsorted(ends, index["offset"][low] + READ_BYTES, side="right")))
                        data = unframed(f.read(int(ends[high - 1] - index["offset"][low])), index["size"][low:high].tolist())
                        crc = [zlib.crc32(np.frombuffer(x, dtype=kind, offset=8).astype("<u4").tobytes()) for x in data]
                        ids = [None if (i := int.from_bytes(x[:8], "little", signed=True)) == NO_ID else i for x in data]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts[low:high]), pa.array([(len(x) - 8) // kind.itemsize for x in data], pa.int64()), pa.array(crc, pa.int64()), pa.array([shard] * len(data), pa.int64()), pa.array(index["offset"][low:high].astype(np.int64))], names=names)
                        low = high

    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long")
    table = spark.createDataFrame(rows, "shard long, start long").repartition(len(rows), "shard")
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long")


def index_of(manifest: DataFrame, folder: str) -> DataFrame:
    """(shard, offset, size, tokens) of every record, from the index files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with store.open_input_stream(f"{base}/shard-{shard:06d}.index") as f:
                    index = np.frombuffer(f.read(), dtype=INDEX)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), shard)), *[pa.array(index[x].astype(np.int64)) for x in INDEX.names]], names=["shard", *INDEX.names])

    return manifest.select("shard").mapInArrow(read, "shard long, offset long, size long, tokens long")


def read_shuffled(manifest: DataFrame, folder: str, seed: int, tasks: int, wide: bool = False) -> DataFrame:
    """(task, place, doc_id, ids) in an order that ``seed`` decides: the index entries are dealt to tasks and put in
    order by hash, and each task seeks to its records, wherever they are."""
    order = F.xxhash64(F.lit(seed), "shard", "offset")
    dealt = index_of(manifest, folder).withColumn("order", order).repartition(tasks, "order").sortWithinPartitions("order")
    kind = np.dtype("<u4" if wide else "<u2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), task, place = _store(folder), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, tokens, files = [], [], {}
            for shard, offset, size in zip(*(batch.column(x).to_pylist() for x in ("shard", "offset", "size"))):
                if shard not in files:
                    if len(files) >= OPEN_FILES:
                        files.pop(next(iter(files))).close()
                    files[shard] = store.open_input_file(f"{base}/shard-{shard:06d}.records")
                files[shard].seek(offset)
                data = unframed(files[shard].read(size + FRAME), [size])[0]
                number = int.from_bytes(data[:8], "little", signed=True)
                ids.append(None if number == NO_ID else number)
                tokens.append(np.frombuffer(data, dtype=kind, offset=8).astype(np.int64))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int32()), pa.array(range(place, place + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["task", "place", "doc_id", "ids"])
            place += len(ids)

    return dealt.mapInArrow(read, "task int, place long, doc_id long, ids array<long>")


def op3_token_records(spark, sf_dir):
    docs, path = documents(spark, sf_dir), default_path()
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    manifest = write_records(docs, folder, 2 * docs.rdd.getNumPartitions(), path)
    return read_records(manifest, folder, encoder(path).kind.itemsize == 4)
