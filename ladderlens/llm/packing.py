"""Packing token ids into sequences by cutting-stock column generation.

A document's ids are cut into full sequences, a piece of a multiple of UNIT ids and a crumb of fewer
than UNIT. The pieces' lengths are a cutting-stock problem over their histogram: a linear program over
patterns (which lengths share a sequence), whose new columns a knapsack dynamic program prices.
Patterns are rounded down, what is left is placed best fit first, and the slots are dealt to the
documents by their rank within a length. Crumbs, as one stream, fill what the patterns leave open; the
stream's last ids go to sequences whose lengths are powers of two. The solver sees one row per length
class, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.llm.common import documents, staged, text_blocks
from ladderlens.llm.tokens import OWNER, WORDS_AT_ONCE, default_path, encoder

SEQUENCE = 4096
UNIT = 32
CAPACITY = SEQUENCE // UNIT
#: Documents whose ranks one task counts.
DOCS_PER_CHUNK = 16_384
MOST_PIVOTS = 5_000
#: The program is solved to within this share of its lower bound.
TOLERANCE = 1e-3
FULL, CRUMB = -1, -2


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within the capacity, and how often it has each item."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by_size = np.argsort(sizes, kind="stable")
    values, ordered = values[by_size], sizes[by_size]
    fits = np.searchsorted(ordered, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            gain = values[:n] + best[c - ordered[:n]]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], item[c] = gain[i], i
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            pattern[by_size[item[c]]] += 1
            c -= int(ordered[item[c]])
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a small matrix by elimination with row exchanges, without threads."""
    n = len(a)
    m = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        j = i + int(np.abs(m[i:, i]).argmax())
        m[[i, j]] = m[[j, i]]
        m[i] /= m[i, i]
        rest = m[:, i].copy()
        rest[i] = 0
        m -= rest[:, None] * m[i]
    return m[:, n:]


def patterns(demand: dict[int, int], capacity: int = CAPACITY, spare: float = 0) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: copies in each}) that together hold exactly ``demand`` pieces of each length.

    Columns are generated until the linear program is within TOLERANCE of its lower bound, or until its
    patterns leave no more than ``spare`` units open, which something else will fill.
    """
    sizes = np.array(sorted(x for x, n in demand.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(x)] for x in sizes], dtype=np.float64)
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1 / np.diag(columns))
    x, bound = need / np.diag(columns), 0.0
    times = lambda a, b: np.einsum("ij,j->i", a, b)  # noqa: E731  (small, so without threads)
    for pivot in range(MOST_PIVOTS):
        if x.sum() * capacity - sizes @ need <= spare:
            break
        prices = inverse.sum(0)
        value, column = knapsack(prices, sizes, capacity)
        bound = max(bound, float(prices @ need) / max(value, 1))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + TOLERANCE):
            break
        move = times(inverse, column.astype(np.float64))
        ratio = np.where(move > 1e-10, x / np.where(move > 1e-10, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        columns[:, out] = column
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        if pivot % 500 == 499:  # rounding errors do not build up
            inverse = _inverse(columns)
            x = np.maximum(times(inverse, need), 0)
    counted = columns.astype(np.int64)
    whole = np.floor(x + 1e-7).astype(np.int64)
    held = counted @ whole
    while (held > need).any():  # rounding may have taken one too many
        over = int(np.argmax(held - need))
        whole[int(np.argmax((columns[over] > 0) & (whole > 0)))] -= 1
        held = counted @ whole
    found = [(int(n), {int(s): int(a) for s, a in zip(sizes, column) if a}) for n, column in zip(whole, counted.T) if n]
    open_bins: list[tuple[int, dict[int, int]]] = []
    for size, left in sorted(zip(sizes.tolist(), (need.astype(np.int64) - held).tolist()), reverse=True):
        for _ in range(left):
            fit = min((i for i, (room, _) in enumerate(open_bins) if room >= size), key=lambda i: open_bins[i][0], default=None)
            room, pieces = open_bins.pop(fit) if fit is not None else (capacity, {})
            open_bins.append((room - size, pieces | {size: pieces.get(size, 0) + 1}))
    return found + [(1, pieces) for _, pieces in open_bins]


class Layout:
    """Where each rank of a length class, each place of the crumb stream and each full sequence goes."""

    def __init__(self, demand: dict[int, int], crumbs: int):
        slots, holes, sequence, place = {}, [], 0, 0
        taken = dict.fromkeys(demand, 0)
        for n, pieces in patterns(demand, spare=crumbs / UNIT):
            offset = 0
            for size, copies in sorted(pieces.items(), reverse=True):
                slots.setdefault(size, []).append((taken[size], sequence, copies, offset * UNIT))
                taken[size] += n * copies
                offset += size * copies
            if width := SEQUENCE - offset * UNIT:
                holes.append((place, width, sequence, offset * UNIT))
                place += n * width
            sequence += n
        if (rest := crumbs - place) > 0:
            if whole := rest // SEQUENCE:
                holes.append((place, SEQUENCE, sequence, 0))
                sequence, place = sequence + whole, place + whole * SEQUENCE
            for width in (1 << i for i in reversed(range(SEQUENCE.bit_length() - 1))):
                if rest % SEQUENCE & width:
                    holes.append((place, width, sequence, 0))
                    sequence, place = sequence + 1, place + width
        self.slots = {x: np.array(rows, dtype=np.int64) for x, rows in slots.items()}
        self.holes = np.array(holes, dtype=np.int64).reshape(-1, 4)
        self.sequences = sequence

    def slot(self, size: int, rank: int) -> tuple[int, int]:
        """Sequence and offset of the piece with this rank among those of ``size`` units."""
        rows = self.slots[size]
        first, sequence, copies, offset = rows[int(np.searchsorted(rows[:, 0], rank, side="right")) - 1].tolist()
        return sequence + (rank - first) // copies, offset + (rank - first) % copies * size * UNIT

    def pieces(self, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of the parts of ``length`` ids of the crumb stream from ``start`` on."""
        while length:
            first, width, sequence, offset = self.holes[int(np.searchsorted(self.holes[:, 0], start, side="right")) - 1].tolist()
            inside = (start - first) % width
            part = min(length, width - inside)
            yield sequence + (start - first) // width, offset + inside, part
            start, length = start + part, length - part


def measured(docs: DataFrame, path: str) -> DataFrame:
    """One narrow row per document: its number of ids, checksums of its full sequences and of its piece, and the crumb itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, owner=OWNER, size=WORDS_AT_ONCE):
            n, full, size, crc, crumb = [], [], [], [], []
            for ids in encoder(path).encode(texts):
                raw, count = memoryview(ids.astype("<u4").tobytes()), len(ids)
                at = count // SEQUENCE * SEQUENCE
                end = count - count % UNIT
                n.append(count), size.append((end - at) // UNIT), crumb.append(bytes(raw[4 * end :]))
                full.append([zlib.crc32(raw[4 * i : 4 * (i + SEQUENCE)]) for i in range(0, at, SEQUENCE)])
                crc.append(zlib.crc32(raw[4 * at : 4 * end]))
            arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(crumb, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", "full_crcs", "size", "size_crc", "crumb"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, doc_tokens long, full_crcs array<long>, size long, size_crc long, crumb binary")


def pack(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is tokenised once; afterwards only narrow rows move. Ranks and places are counted
    within chunks of documents and moved on by the totals of the chunks before. Null texts count as
    empty (their one id is the end id); repeated rows and equal ids are packed as often as they come, and rows
    that are equal in all that ranks them may change places; a text of any length is cut into as many
    sequences as it needs; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = staged(measured(docs, path), "measured")
    chunks = -(-rows.count() // DOCS_PER_CHUNK) or 1
    rows = rows.withColumn("crumb_ids", F.octet_length("crumb") / 4).withColumn("crumb_ids", F.col("crumb_ids").cast("long"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "doc_tokens", "size_crc"), F.lit(chunks)))
    amounts = rows.select("chunk", F.inline(F.array(F.struct(F.col("size").alias("what"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(FULL).cast("long").alias("what"), F.size("full_crcs").cast("long").alias("n")), F.struct(F.lit(CRUMB).cast("long").alias("what"), F.col("crumb_ids").alias("n")))))
    totals = staged(amounts.groupBy("what", "chunk").agg(F.sum("n").alias("n")), "totals")
    whole = {r["what"]: r["n"] for r in totals.groupBy("what").agg(F.sum("n").alias("n")).collect()}
    layout = Layout({x: n for x, n in whole.items() if x > 0}, whole.get(CRUMB, 0))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("what").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("what", F.coalesce("before", F.lit(0)).alias("before")))).alias("before"))
    order = ("doc_id", "doc_tokens", "size_crc", "crumb")
    running = Window.partitionBy("chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("full_rank", F.coalesce(F.sum(F.size("full_crcs")).over(running), F.lit(0))).withColumn("crumb_at", F.coalesce(F.sum("crumb_ids").over(running), F.lit(0)))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "size").orderBy(*order)) - 1).join(before, "chunk")
    placed = placed.select(
        *("doc_id", "doc_tokens", "full_crcs", "size", "size_crc", "crumb"),
        (F.col("full_rank") + F.col("before")[F.lit(FULL).cast("long")]).alias("full_rank"),
        (F.col("crumb_at") + F.col("before")[F.lit(CRUMB).cast("long")]).alias("crumb_at"),
        (F.col("rank") + F.col("before")[F.col("size")]).alias("rank"),
    )
    shipped = spark.sparkContext.broadcast(layout)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shipped.value
        for batch in batches:
            at, out = [], []
            for row, r in enumerate(batch.to_pylist()):
                start = 0
                for i, crc in enumerate(r["full_crcs"]):
                    out.append((start, SEQUENCE, crc, r["doc_tokens"], layout.sequences + r["full_rank"] + i, 0))
                    start += SEQUENCE
                if r["size"]:
                    out.append((start, r["size"] * UNIT, r["size_crc"], r["doc_tokens"], *layout.slot(r["size"], r["rank"])))
                    start += r["size"] * UNIT
                raw = r["crumb"]
                for sequence, offset, n in layout.pieces(r["crumb_at"], len(raw) // 4):
                    out.append((start, n, zlib.crc32(raw[: 4 * n]), r["doc_tokens"], sequence, offset))
                    raw, start = raw[4 * n :], start + n
                at += [row] * (len(out) - len(at))
            columns = np.array(out, dtype=np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(x) for x in columns]], names=["doc_id", *names])

    return placed.mapInArrow(place, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names))


def op9_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), default_path())
