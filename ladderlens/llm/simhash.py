"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits in four segments of 16 on a ring. If two fingerprints differ in at most
``LIMIT`` = 3 bits, then from some segment on every chain of l consecutive segments differs in at
most l * 3 / 4 bits: none in the first, one in the first two, two in the first three (Qin and Xiao,
Pigeonring, 2018). Candidates are therefore found by keys of 28 bits: a segment, and the next one
with one of its four nibbles left out (one differing bit spoils one nibble). The rest of the chain is
checked before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderlens.llm.common import connected_components, documents, staged, text_blocks
from ladderlens.llm.hashing import SPARE, xxh64

SHINGLE_WORDS = 3
SEED = 42
LIMIT = 3
SEGMENTS, SEGMENT_BITS = 4, 16

#: Each byte's bits, one per byte of a number, most significant bit first in memory.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).copy().view(np.uint64).ravel()


def simhashes(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """A fingerprint for each UTF-8 text: ASCII letters lower-cased, words between ASCII white space,
    shingles of ``words`` words with repeats; a shorter text is one shingle, one without words gives 0."""
    parts = [x.lower().split() for x in texts]
    count = np.array([len(x) for x in parts], dtype=np.int64)
    data = np.frombuffer(b" ".join(b" ".join(x) for x in parts if x) + b" " + bytes(SPARE), dtype=np.uint8)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    ends = np.flatnonzero(data == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = count[full]
    shingles = np.maximum(n - words + 1, 1)
    at = np.concatenate([[0], np.cumsum(shingles)])
    word = np.arange(at[-1]) - np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), shingles)
    last = word + np.repeat(np.minimum(n, words) - 1, shingles)
    h = xxh64(data, begins[word], ends[last] - begins[word], SEED)
    ones = SPREAD[h.byteswap().view(np.uint8).reshape(-1, 8)]
    # sums of at most 255 shingles fit the bytes of a number
    pieces = (shingles + 254) // 255
    piece_at = np.concatenate([[0], np.cumsum(pieces)])
    cut = np.repeat(at[:-1], pieces) + 255 * (np.arange(piece_at[-1]) - np.repeat(piece_at[:-1], pieces))
    sums = np.add.reduceat(ones, cut, axis=0).view(np.uint8).reshape(-1, 64)
    sums = np.add.reduceat(sums, piece_at[:-1], axis=0, dtype=np.int64)
    out[full] = np.packbits(sums * 2 > shingles[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint's 64 bits as a long. A null text counts as empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(simhashes(texts).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).mapInArrow(prints, f"id {kind}, fp long")


def _segment(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: start of the chain, nibble left out, and the 28 bits."""
    keys = []
    for i in range(SEGMENTS):
        for nibble in range(4):
            rest = ((1 << SEGMENT_BITS) - 1) & ~(15 << 4 * nibble)
            keys.append(F.lit((4 * i + nibble) << 32).bitwiseOR(F.shiftleft(_segment(fp, i), SEGMENT_BITS)).bitwiseOR(_segment(fp, i + 1).bitwiseAND(F.lit(rest))))
    return F.array(*keys)


def _chain_holds(a: Column, b: Column, start: Column) -> Column:
    """The chains from segment ``start`` on stay within their proportional budgets."""
    x = a.bitwiseXOR(b)
    found = F.lit(False)
    for i in range(SEGMENTS):
        one, upto = F.bit_count(_segment(x, i)), F.lit(True)
        for length in range(2, SEGMENTS + 1):
            one = one + F.bit_count(_segment(x, i + length - 1))
            upto &= one <= length * LIMIT // SEGMENTS
        found |= (start == i) & upto
    return found


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of at most LIMIT differing bits, enough to connect
    all that belong together: within a key, those near its smallest fingerprint link to that alone,
    and only the others are compared with the rest. A group of near copies thus costs one link a member."""
    distinct = prints.select("fp").distinct()
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    keyed = staged(keyed.join(shared, "key"), "keys")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) > LIMIT
    near = keyed.where(~far & (F.col("fp") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    a, b = keyed.where(far).select("key", F.col("fp").alias("a")), keyed.where("fp != pivot").select("key", F.col("fp").alias("b"))
    start = F.shiftrightunsigned(F.col("key"), 34)
    rest = a.join(b, "key").where((F.col("a") != F.col("b")) & _chain_holds(F.col("a"), F.col("b"), start) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT))
    return near.union(rest.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text): component_id is the smallest
    doc_id among the documents reachable over links of at most LIMIT differing bits.

    Nulls and empty texts have fingerprint 0 and are linked like any other; equal fingerprints are one
    node whatever their number; an empty table gives an empty one; a null doc_id is never a component's name.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    component = connected_components(links(prints))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    joined = least.join(component, least.fp == component.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op5_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
