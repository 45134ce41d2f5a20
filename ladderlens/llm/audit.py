"""Which of five filters removes what, alone and in every order.

One pass over the bytes of each text drives a finite-state transducer by tables: a byte's class and the
state before it (in or out of a word) give the next state and the marks to count: a word opens, a word
closes, a capital, a symbol, a code point. As the state after a byte depends on that byte's class alone,
the tables are looked up for a whole block at a time. The spans of closed words go into an open-addressed
hash table by document; a span that meets a taken slot is compared with the occupant byte by byte, so
equal hashes of different words never merge them.

What a document fails is five bits. All orders, steps and shares follow from the counts of those bits by
part, at most 32 a part, so nothing but these is read for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.llm.common import BLOCK_BYTES, documents, joined, staged, text_blocks
from ladderlens.llm.hashing import SPARE, xxh64

FILTERS = "ABCDE"
#: Limits of the filters.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITAL_PCT = 100, 80, 10
SYMBOLS = b"#$%&*|"
# Classes of bytes, the two states, and marks.
SPACE, CAPITAL, SYMBOL, PLAIN, REST = range(5)
OUT, IN = range(2)
OPENS, CLOSES, CAPITALS, SYMBOLIC, POINT = 1, 2, 4, 8, 16

CLASS = np.full(256, PLAIN, dtype=np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[0x80:0xC0] = REST  # further bytes of a code point
NEXT = np.array([OUT, IN, IN, IN, IN], dtype=np.uint8)
MARKS = np.array([[POINT, POINT | CAPITALS | OPENS, POINT | SYMBOLIC | OPENS, POINT | OPENS, OPENS], [POINT | CLOSES, POINT | CAPITALS, POINT | SYMBOLIC, POINT, 0]], dtype=np.uint8)


def marks_of(data: np.ndarray) -> np.ndarray:
    """The marks of each byte of ``data``, beginning outside a word."""
    kind = CLASS[data]
    state = np.concatenate([np.array([OUT], dtype=np.uint8), NEXT[kind[:-1]]])
    return MARKS[state, kind]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] are equal, for each; data has 8 spare bytes."""
    u8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    equal, left, o = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
    while len(left):
        rest = sizes[left] - o
        cut = np.where(rest >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.clip(rest, 0, 7).astype(np.uint64))) - np.uint64(1))
        ok = ((u8[a[left] + o] ^ u8[b[left] + o]) & cut) == 0
        equal[left[~ok]] = False
        left, o = left[ok & (rest > 8)], o + 8
    return equal


def distinct_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indexes of one span for each different word of each owner, by a verified hash table."""
    n = len(starts)
    bits = max(4, int(2 * n).bit_length())
    table, mask = np.full(1 << bits, -1, dtype=np.int64), np.int64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        mixed = xxh64(data, starts, sizes) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    slot, pending, kept = (mixed >> np.uint64(64 - bits)).astype(np.int64), np.arange(n), np.zeros(n, dtype=bool)
    while len(pending):
        at = slot[pending]
        free = table[at] < 0
        table[at[free]] = pending[free]
        there = table[at]
        kept[pending[there == pending]] = True
        same = (mixed[there] == mixed[pending]) & (owner[there] == owner[pending]) & (sizes[there] == sizes[pending])
        maybe = np.flatnonzero(same)
        same[maybe] = same_bytes(data, starts[there[maybe]], starts[pending[maybe]], sizes[pending[maybe]])
        pending = pending[~same]
        slot[pending] = (slot[pending] + 1) & mask
    return np.flatnonzero(kept)


def _spans(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(marks & OPENS)
    return starts, np.flatnonzero(marks & CLOSES) - starts


def measures(texts: list[bytes]) -> np.ndarray:
    """(words, distinct words, capitals, code points, symbols) of each text, a row each."""
    data, starts = joined(texts, b" ")
    data = np.concatenate([data, np.full(SPARE + 1, 0x20, dtype=np.uint8)])  # a space closes the last word
    marks = marks_of(data)
    first, sizes = _spans(data, marks)
    owner = np.searchsorted(starts, first, side="right") - 1
    out = np.zeros((len(texts), 5), dtype=np.int64)
    out[:, 0] = np.bincount(owner, minlength=len(texts))
    out[:, 1] = np.bincount(owner[distinct_spans(data, first, sizes, owner)], minlength=len(texts))
    for column, mark in ((2, CAPITALS), (3, POINT), (4, SYMBOLIC)):
        out[:, column] = np.add.reduceat((marks & mark) != 0, starts[:-1], dtype=np.int64)
    out[:, 3] -= 1  # the space before it
    out[-1, 3] -= SPARE + 1
    return out


def long_measures(text: bytes, size: int = BLOCK_BYTES) -> np.ndarray:
    """The same of one long text, a slice at a time, cut behind white space; what it holds at once is a slice
    (or the longest word) and the text's different words."""
    data = np.frombuffer(text, dtype=np.uint8)
    total, words, at = np.zeros(5, dtype=np.int64), set(), 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data):
            more = np.flatnonzero(CLASS[data[end : end + size]] == SPACE)
            if len(more):
                end += int(more[0]) + 1
                break
            end = min(end + size, len(data))
        part = np.concatenate([data[at:end], np.full(SPARE + 1, 0x20, dtype=np.uint8)])
        marks = marks_of(part)
        starts, sizes = _spans(part, marks)
        total += [len(starts), 0, *(np.count_nonzero(marks & m) for m in (CAPITALS, POINT, SYMBOLIC))]
        total[3] -= SPARE + 1
        found = distinct_spans(part, starts, sizes, np.zeros(len(starts), dtype=np.int64))
        words.update(part[a : a + n].tobytes() for a, n in zip(starts[found].tolist(), sizes[found].tolist()))
        at = end
    total[1] = len(words)
    return total


def failures(m: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4, 8 of what each row of measures fails: A, B, C, D."""
    words, distinct, capitals, points, symbols = m.T
    return (words < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT_PCT * words) + 4 * (100 * capitals > MOST_CAPITAL_PCT * points) + 8 * (symbols > 0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, the measures and bits A to D of each text, and its digest. Null texts are empty."""
    schema = "doc_id long, part string, digest binary, words long, distinct_words long, capitals long, points long, symbols long, fails int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, owner="audit"):
            m = np.array([long_measures(texts[0])]) if len(texts) == 1 else measures(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), *[pa.array(c) for c in m.T], pa.array(failures(m).astype(np.int32))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(run, schema)


def failed(docs: DataFrame) -> DataFrame:
    """``measured`` with bit 16 of E where a smaller doc_id has an identical text. Rows without a doc_id have no
    smaller one and are smaller than none; repeated rows of one doc_id don't fail for each other."""
    rows = staged(measured(docs), "measured")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").withColumn("fails", F.col("fails") + F.when(late, 16).otherwise(0)).drop("first")


def interactions(rows: DataFrame) -> DataFrame:
    """rows (part, fails, good, toxic) to one row per part, order of the filters and step."""
    counted = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    orders = F.array(*[F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(x)) for x in p]).alias("bits")) for p in permutations(FILTERS)])
    steps = counted.withColumn("o", F.explode(orders)).select("*", "o.filter_order", F.col("o.bits").alias("bits")).select("part", "fails", "n", "good", "toxic", "filter_order", "bits", F.posexplode("bits").alias("at", "bit"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a.bitwiseOR(x))
    fails, met = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(before) != 0
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    share = F.expr(f"{len(list(permutations(FILTERS)))} div greatest(1, bit_count(fails))") * F.col("n")  # the orders in which it comes first
    out = steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step")).agg(
        total(~met & ~fails).alias("kept"), total(~met & fails).alias("removed"), total(met & fails).alias("redundant"), total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(~met & fails, "good").alias("good_lost"), total(~met & fails, "toxic").alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )
    return out


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five filters over whole documents, per lang, for all 120 orders and their steps.

    Null texts are empty (they fail A alone and, but for the smallest doc_id, E); a null lang is the part ''.
    Texts of any length are read in slices. Repeated rows count as often as they come; of several labels of
    one document one with quality (toxic) 1 is enough. No documents, no rows. Other columns are not read.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return interactions(failed(documents(spark, sf_dir)).select("doc_id", "part", "fails").join(labels, "doc_id", "left"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT body, min(doc_id) AS first_id FROM d GROUP BY body),
good AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM d JOIN first USING (body) LEFT JOIN good USING (doc_id)),
letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS met FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
removed AS (SELECT part, filter_order, step, bit, met, fails, good, toxic FROM f, steps)
SELECT part, filter_order, step::INTEGER AS step,
  count_if(fails & met = 0 AND fails & bit = 0)::BIGINT AS kept, count_if(fails & met = 0 AND fails & bit <> 0)::BIGINT AS removed,
  count_if(fails & met <> 0 AND fails & bit <> 0)::BIGINT AS redundant, count_if(fails = bit)::BIGINT AS unique_fails,
  count_if(fails & met = 0 AND fails & bit <> 0 AND good)::BIGINT AS good_lost, count_if(fails & met = 0 AND fails & bit <> 0 AND toxic)::BIGINT AS toxic_lost,
  sum(CASE WHEN fails & bit <> 0 THEN 120 // bit_count(fails) ELSE 0 END)::BIGINT AS shapley
FROM removed GROUP BY part, filter_order, step, bit, met"""
