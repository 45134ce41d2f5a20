"""Document fingerprints by content-defined chunking.

Normalised chunking (Xia et al., FastCDC, 2016) cuts where a gear hash of the last 16 bytes has
zeros in its top bits: more of them are asked for below the normal size than above it. An edit moves
only the cuts near it, so the set of chunk digests resists shifts; weighting the digests by chunk
length measures how much of one text another contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import BLOCK_BYTES, documents
from ladderlens.llm.hashing import SPARE, xxh64

#: The gear hash covers 16 bytes, so a cut depends on nothing before its own chunk.
MIN_BYTES, NORMAL_BYTES, MAX_BYTES = 16, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 4
GEAR = np.frombuffer(hashlib.shake_256(b"gear table").digest(1024), dtype="<u4").copy()
ENTRY = np.dtype([("digest", ">u8"), ("length", ">u2")])


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts start in ``data``, ascending, and last its length; text i ends at ends[i]."""
    n = len(data)
    if not n:
        return np.array([0])
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    far = np.iinfo(np.int64).max >> 1

    def following(bits: int) -> np.ndarray:
        """The first cut at or after each byte: a cut stands after the byte whose hash asks for it."""
        at = np.full(n + MAX_BYTES + 2, far)
        hit = np.flatnonzero(h < np.uint32(1 << (32 - bits)))
        at[hit + 1] = hit + 1
        return np.minimum.accumulate(at[::-1])[::-1]

    i = np.arange(n)
    strict, loose = following(STRICT_BITS)[i + MIN_BYTES], following(LOOSE_BITS)[i + NORMAL_BYTES]
    end = np.repeat(ends, np.diff(ends, prepend=0))
    following_cut = np.minimum(np.where(strict < i + NORMAL_BYTES, strict, np.minimum(loose, i + MAX_BYTES)), end)
    found, at, step = [], 0, following_cut.item
    while at < n:
        found.append(at)
        at = step(at)
    return np.array([*found, n])


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct chunks, ascending by digest, with their lengths."""
    data = np.frombuffer(b"".join(texts) + bytes(SPARE), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    at = cuts(data[:-SPARE], ends)
    sizes = np.diff(at)
    all_chunks = np.empty(len(sizes), dtype=ENTRY)
    all_chunks["digest"], all_chunks["length"] = xxh64(data, at[:-1], sizes), sizes
    edge = np.searchsorted(at[:-1], np.concatenate([[0], ends]))
    out = []
    for low, high in zip(edge, edge[1:]):
        _, first = np.unique(all_chunks["digest"][low:high].astype(np.uint64), return_index=True)
        out.append(all_chunks[low:high][first])
    return out


def encoded(chunks: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits of digest and 4 of length for each chunk."""
    return chunks.tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=ENTRY)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's distinct chunks, by length, that b has too; two empty sets are alike."""
    if not len(a):
        return float(not len(b))
    shared = np.isin(a["digest"].astype(np.uint64), b["digest"].astype(np.uint64), assume_unique=True)
    return float(a["length"][shared].sum(dtype=np.int64) / a["length"].sum(dtype=np.int64))


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ghost, doc_id, text) such that within a bucket, by descending doc_id, each document is
    followed by the next one of the whole table: buckets are ranges of doc_id, and a bucket also gets a
    ghost copy of the document that follows its last one (after the very last: of the first).

    One shuffle of the texts; what is broadcast has a bound and a row for each bucket, whatever the number of
    documents in it. Equal ids are ordered by their text's hash; null ids come last.
    """
    lowest = -(1 << 63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("ord"))
    bounds = sorted({int(x) for x in keyed.approxQuantile("ord", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    shipped = docs.sparkSession.sparkContext.broadcast(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def own(ord: pd.Series) -> pd.Series:
        """The number of bounds at or below each id."""
        return pd.Series(np.searchsorted(shipped.value, ord.to_numpy(), side="right").astype(np.int32))

    keyed = keyed.withColumn("bucket", own("ord") if bounds else F.lit(0))
    tops = sorted((r["bucket"], r["top"]) for r in keyed.groupBy("bucket").agg(F.max("ord").alias("top")).collect())
    to = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    edges = F.broadcast(docs.sparkSession.createDataFrame(to or [(0, 0)], "ord long, target int"))
    homes = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")))
    ghosts = F.when(F.col("target").isNotNull(), F.array(F.struct(F.col("target").alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.expr("array()"))
    spread = keyed.join(edges, "ord", "left").select("doc_id", "text", "ord", F.explode(F.concat(homes, ghosts)).alias("to"))
    return spread.select("to.bucket", "to.ghost", "doc_id", "text", "ord").repartitionById(max(buckets, 1), F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("ord").desc(), F.xxhash64("text")).drop("ord")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and the share of it that the edited
    text and the next document contain. A null text counts as empty; an empty text has an empty
    fingerprint; a single document is its own next one; an empty table gives an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text), each followed by its next document; the last gives no result."""
        texts = [x for _, x in rows]
        changed = [edited(x, y) for x, y in zip(texts, texts[1:])]
        raw = [x.encode() for x in texts + changed]
        sets = chunk_sets(raw)
        own, other = sets[: len(texts)], sets[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows[:-1]], id_type),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw[len(texts) :]], pa.string()),
                pa.array([encoded(x) for x in own[:-1]], pa.string()),
                pa.array([encoded(x) for x in other], pa.string()),
                pa.array([containment(x, y) for x, y in zip(own, other)], pa.float64()),
                pa.array([containment(x, y) for x, y in zip(own, own[1:])], pa.float64()),
            ],
            names=names,
        )

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now, closed = [], 0, None, False
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for bucket, ghost, i, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text"))):
                    if bucket != now:
                        if len(rows) > 1:
                            yield result(rows)
                        rows, size, now, closed = [], 0, bucket, False
                    if closed or (ghost and not rows):
                        continue  # only the first ghost counts
                    rows.append((i, text))
                    size += len(text)
                    closed = ghost
                    if size > BLOCK_BYTES // 2 and len(rows) > 1:
                        yield result(rows)
                        rows = [] if ghost else rows[-1:]
                        size = sum(len(x) for _, x in rows)
        if len(rows) > 1:
            yield result(rows)

    return neighbours(docs, buckets).mapInArrow(pairs, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_chunk_fingerprints(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return fingerprint_pairs(docs, 2 * docs.rdd.getNumPartitions())
