"""Books kept while their changes stream by in order.

Spark deals changes out by market and time block and sorts them; a task keeps one book at a time and
answers where a sample or an event's end comes up, so the work follows the changes. Each side is a price
ladder cut into short runs of neighbouring prices with their notional summed, so a range of prices costs
the runs that it covers and the levels of two runs at its ends, not every live level. Prices and
quantities are integers here (units of 1e-8), and so all sums are exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices in a run at most.
RUN = 64
UNIT, SCALE = "decimal(18,8)", 10**8
STRUCTURES = ("NORMAL", "LOCKED", "CROSSED", "EMPTY_BID", "EMPTY_ASK", "EMPTY_BOTH")
_EXACT = Context(prec=80)


class Ladder:
    """The levels of one side."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.qty: dict[int, int] = {}
        self.runs: list[list[int]] = []  # prices, ascending within and over the runs
        self.sums: list[int] = []  # notional of each run
        self.heads: list[int] = []  # lowest price of each run

    def put(self, price: int, qty: int) -> int:
        """Set a level, or remove it with quantity 0; returns the quantity that it had."""
        had = self.qty.get(price, 0)
        if qty == had:
            return had
        at = max(0, bisect_right(self.heads, price) - 1)
        if had == 0:
            if not self.runs:
                self.runs, self.sums, self.heads = [[]], [0], [price]
            insort(self.runs[at], price)
            self.heads[at] = self.runs[at][0]
        self.sums[at] += price * (qty - had)
        if qty:
            self.qty[price] = qty
            if len(self.runs[at]) > RUN:
                self._split(at)
        else:
            del self.qty[price]
            self.runs[at].pop(bisect_left(self.runs[at], price))
            if self.runs[at]:
                self.heads[at] = self.runs[at][0]
            else:
                del self.runs[at], self.sums[at], self.heads[at]
        return had

    def _split(self, at: int) -> None:
        prices = self.runs[at]
        low, high = prices[: len(prices) // 2], prices[len(prices) // 2 :]
        upper = sum(p * self.qty[p] for p in high)
        self.runs[at : at + 1], self.sums[at : at + 1], self.heads[at : at + 1] = [low, high], [self.sums[at] - upper, upper], [low[0], high[0]]

    def least(self) -> int | None:
        return self.runs[0][0] if self.runs else None

    def most(self) -> int | None:
        return self.runs[-1][-1] if self.runs else None

    def within(self, low: int, high: int) -> tuple[int, int]:
        """(levels, notional) of prices from low to high, both included."""
        levels = notional = 0
        for at in range(max(0, bisect_right(self.heads, low) - 1), bisect_right(self.heads, high)):
            prices = self.runs[at]
            if low <= prices[0] and prices[-1] <= high:
                levels, notional = levels + len(prices), notional + self.sums[at]
            else:
                inside = prices[bisect_left(prices, low) : bisect_right(prices, high)]
                levels, notional = levels + len(inside), notional + sum(p * self.qty[p] for p in inside)
        return levels, notional


class Book:
    def __init__(self) -> None:
        self.bid, self.ask = Ladder(), Ladder()

    def clear(self) -> None:
        self.bid.clear()
        self.ask.clear()

    def put(self, is_bid: bool, price: int, qty: int) -> int:
        return (self.bid if is_bid else self.ask).put(price, qty)

    def structure(self) -> str:
        b, a = self.bid.most(), self.ask.least()
        if b is None or a is None:
            return STRUCTURES[5 if b is a else 3 if b is None else 4]
        return STRUCTURES[0 if b < a else 1 if b == a else 2]

    def band(self, lower: int, upper: int) -> tuple[int, int, int, int]:
        """(bid, ask, bid levels, ask levels) between the shares (units of 1e-8) off the best prices; bounds are exact."""
        b, a = self.bid.most(), self.ask.least()
        n, bid = self.bid.within(-(-b * (SCALE - upper) // SCALE), b * (SCALE - lower) // SCALE)
        m, ask = self.ask.within(-(-a * (SCALE + lower) // SCALE), a * (SCALE + upper) // SCALE)
        return bid, ask, n, m


def units(c: str | Column) -> Column:
    """An amount of at most 8 decimals in units of 1e-8."""
    return ((F.col(c) if isinstance(c, str) else c).cast(UNIT) * F.lit(SCALE)).cast("long")


def from_units(c: str, kind: str) -> Column:
    return (F.col(c).cast("decimal(19,0)") * F.lit("0.00000001").cast("decimal(9,8)")).cast(kind)


def exact(notional: int) -> Decimal:
    """A notional, which has 16 decimals."""
    return Decimal(notional).scaleb(-16, _EXACT)


TOPS = "market long, slot long, best_bid long, best_ask long, bid_levels long, ask_levels long, bands array<struct<band int, bid decimal(38,16), ask decimal(38,16), bid_levels long, ask_levels long>>"


def sampled_books(rows: DataFrame, bands: list[tuple[int, int, int]]) -> DataFrame:
    """TOPS for every row with what = 2 of rows (market, epoch, block, slot, what, is_bid, price, qty), after all rows
    before it of its market, epoch and block: 0 ends a level, 1 sets one. bands: (band, lower, upper), judged
    only in NORMAL books."""
    names = "market epoch block slot what is_bid price qty".split()
    kind = pa.list_(pa.struct([("band", pa.int32()), ("bid", pa.decimal128(38, 16)), ("ask", pa.decimal128(38, 16)), ("bid_levels", pa.int64()), ("ask_levels", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, Book()
        for batch in batches:
            out: list[tuple] = []
            for market, epoch, block, slot, what, is_bid, price, qty in zip(*(batch.column(c).to_pylist() for c in names)):
                if now != (market, epoch, block):
                    now = (market, epoch, block)
                    book.clear()
                if what < 2:
                    book.put(is_bid, price, qty)
                    continue
                found = []
                if bands and book.structure() == STRUCTURES[0]:
                    for band, lower, upper in bands:
                        bid, ask, n, m = book.band(lower, upper)
                        found.append({"band": band, "bid": exact(bid), "ask": exact(ask), "bid_levels": n, "ask_levels": m})
                out.append((market, slot, book.bid.most(), book.ask.least(), len(book.bid.qty), len(book.ask.qty), found))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], kind)], names=["market", "slot", "best_bid", "best_ask", "bid_levels", "ask_levels", "bands"])

    dealt = rows.select(*names).repartition("market", "epoch", "block").sortWithinPartitions("market", "epoch", "block", "slot", "what")
    return dealt.mapInArrow(run, TOPS)


def carried_levels(changes: DataFrame) -> DataFrame:
    """(market, hour, epoch, side, price, qty): the levels that each hour begins with, where its first changes go on with
    the book of the hour before. changes: applied ones with their epoch."""
    last = changes.groupBy("market", "epoch", "side", "price", "hour").agg(F.max_by("qty", "n").alias("qty"))
    w = Window.partitionBy("market", "epoch", "side", "price").orderBy("hour")
    ends = changes.groupBy("market", "epoch").agg(F.max("hour").alias("end"))
    spans = last.withColumn("next", F.lead("hour").over(w)).where("qty > 0").join(ends, ["market", "epoch"]).withColumn("until", F.coalesce("next", "end"))
    return spans.where("until > hour").select("market", "epoch", "side", "price", "qty", F.explode(F.sequence(F.col("hour") + 1, "until")).alias("hour"))


COUNTS = "market long, hour long, zero_changes long, removed long, " + ", ".join(f"{x.lower()} long" for x in STRUCTURES) + ", bid_levels long, ask_levels long"


def structure_counts(changes: DataFrame) -> DataFrame:
    """Per archive hour with applied events: changes to quantity 0, levels that these removed (a snapshot removes none),
    the number of applied events after which the book was NORMAL, LOCKED, ..., and the levels left after the
    last one. changes: (market, hour, n, epoch, side, price, qty) of applied events; an event whose number is
    its epoch is a snapshot, which begins a new book; ``row_index`` gives their order within an event, if there."""
    place = F.col("row_index") if "row_index" in changes.columns else F.lit(0).cast("long")
    own = changes.select("market", "hour", "n", place.cast("long").alias("place"), "epoch", (F.col("side") == "bid").alias("is_bid"), units("price").alias("price"), units("qty").alias("qty"))
    taken = carried_levels(changes).select("market", "hour", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("place"), "epoch", (F.col("side") == "bid").alias("is_bid"), units("price").alias("price"), units("qty").alias("qty"))
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = event = epoch = None
        book, counts = Book(), dict.fromkeys(("zero_changes", "removed", *STRUCTURES), 0)
        schema = pa.schema([(x.split()[0], pa.int64()) for x in COUNTS.split(", ")])

        def hour() -> Iterator[pa.RecordBatch]:
            if event is not None:
                counts[book.structure()] += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*now, *counts.values(), len(book.bid.qty), len(book.ask.qty))], schema=schema)

        for batch in batches:
            for market, at, n, _, e, is_bid, price, qty in zip(*(batch.column(c).to_pylist() for c in names)):
                if now != (market, at):
                    yield from hour()
                    now, event, epoch, counts = (market, at), None, e, dict.fromkeys(counts, 0)
                    book.clear()
                if n is not None and n != event:
                    if event is not None:
                        counts[book.structure()] += 1
                    event = n
                    if e != epoch:
                        book.clear()
                    epoch = e
                had = book.put(is_bid, price, qty)
                if n is not None and qty == 0:
                    counts["zero_changes"] += 1
                    counts["removed"] += had > 0 and n != e
        yield from hour()

    dealt = own.union(taken).repartition("market", "hour").sortWithinPartitions("market", "hour", F.asc_nulls_first("n"), "place")
    return dealt.mapInArrow(run, COUNTS)
