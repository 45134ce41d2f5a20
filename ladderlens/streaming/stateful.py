"""Stateful streams: book replay with outcomes and samples, and outages, keyed by market, on event time.

State is what the batch operators carry over hours: the levels of the book, its frontier, what it rests on
and the update before; for outages, the seconds that the watermark has not passed and the last one that it
has. Timers on event time tell what no row tells: that a slot went by without an event, and that a silence
has become an outage. Rows that the watermark has passed are dropped by Spark, which counts them
(``live.dropped``); so results follow from the rows and the last watermark, however rows came in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ladderlens.operators.events import dealt
from ladderlens.operators.ladder import Book
from ladderlens.operators.replay import OUTCOMES, STATES

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLES = "market long, slot long, n long, valid boolean, state string, best_bid long, best_ask long, bid_levels long, ask_levels long"
EVENTS = "market long, hour long, n long, outcome string, valid boolean, was_valid boolean, epoch long, state string, issue string"
ALARMS = "market long, gap_start long, gap_end long, status string"
#: What a market's replay remembers besides its levels.
MEMORY = "slot long, n long, hour long, frontier long, rests_on long, valid boolean, kind string, final_id long, signature string, with_id boolean, bare int, following long"


@contextmanager
def keyed_state(spark: SparkSession, partitions: int) -> Iterator[None]:
    """The state store that map and value states need, in ``partitions`` parts, for the streams that start within
    it; there are no more keys than markets, so more parts than these would stay empty."""
    wanted = {STORE: ROCKS, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _held(state) -> tuple | None:
    return state.get() if state.exists() else None


class Replay(StatefulProcessor):
    """Events (market, hour, n, t, kind, final_id, prev_id, signature, complete, changes, see ``packed``) of a market, in
    the order of ``n``, through the states that ``operators.replay`` describes. Stored books come as initial state
    (market, hour, frontier, restored_epoch, side, price, qty): an hour that has one begins with it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "is_bid boolean, price long", "qty long")
        self.memory = handle.getValueState("memory", MEMORY)
        self.stored = handle.getMapState("stored", "hour long", "frontier long, epoch long")
        self.stored_levels = handle.getMapState("stored_levels", "hour long, is_bid boolean, price long", "qty long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        s = initialState
        self.stored.updateValue((s["hour"],), (s["frontier"], s["restored_epoch"]))
        self.stored_levels.updateValue((s["hour"], s["side"] == "bid", s["price"]), (s["qty"],))

    def _begin(self, m: SimpleNamespace, book: Book, hour: int) -> None:
        """A new archive hour: with a stored book, with the book of the hour before, or with none."""
        if self.stored.containsKey((hour,)):
            m.frontier, m.rests_on = self.stored.getValue((hour,))
            m.valid, m.kind = True, None
            book.clear()
            for (at, is_bid, price), (qty,) in self.stored_levels.iterator():
                if at == hour:
                    book.put(is_bid, price, qty)
        elif m.hour is not None and hour != m.hour + 1:
            m.frontier = m.rests_on = m.kind = None
            m.valid = False
            book.clear()
        m.hour, m.with_id, m.bare = hour, False, 0

    def _apply(self, m: SimpleNamespace, book: Book, e: Row) -> tuple[str, str | None]:
        """The outcome of one event, and the issue if it invalidates the book."""
        issue = None
        if e["kind"] == "snapshot":
            m.with_id, m.bare = m.with_id or e["final_id"] is not None, m.bare + (e["final_id"] is None)
            m.valid = bool(e["complete"]) and (e["final_id"] is not None or (m.valid and not m.with_id and m.bare == 1))
            outcome, m.rests_on = OUTCOMES[0 if m.valid else 4], e["n"]
            if not m.valid:
                issue = "frontierless_snapshot" if e["complete"] else "incomplete_snapshot"
            book.clear()
        elif not m.valid:
            outcome = OUTCOMES[2]
        elif m.kind == "update" and e["final_id"] is not None and e["final_id"] == m.final_id == m.frontier and e["signature"] == m.signature:
            outcome = OUTCOMES[3]
        elif e["final_id"] is not None and e["prev_id"] is not None and e["prev_id"] == m.frontier:
            outcome = OUTCOMES[1]
        else:
            outcome, m.valid = OUTCOMES[4], False
            known = e["final_id"] is not None and m.frontier is not None
            issue = "conflicting_replayed_update" if known and e["final_id"] == m.frontier else "update_frontier_regression" if known and e["final_id"] < m.frontier else "update_continuity_mismatch"
            book.clear()
        if outcome in OUTCOMES[:2]:
            for c in e["changes"].split(",") if e["changes"] else ():
                side, price, qty = c.split(":")
                book.put(side == "b", int(price), int(qty))
        if e["final_id"] is not None:
            m.frontier = e["final_id"]
        m.kind, m.final_id, m.signature, m.n = e["kind"], e["final_id"], e["signature"], e["n"]
        return outcome, issue

    def _state(self, m: SimpleNamespace) -> str:
        return STATES[(1 if m.with_id else 2) if m.valid else 3 if m.rests_on is not None else 0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        m, book, before = self._load()
        for e in sorted(rows, key=lambda e: e["n"]):
            yield from self.until(key, m, book, e)
            if e["hour"] != m.hour:
                self._begin(m, book, e["hour"])
            was_valid = m.valid
            outcome, issue = self._apply(m, book, e)
            yield from self.after(key, m, outcome, was_valid, issue)
        self._save(m, book, before)
        yield from self.passed(key, m, book, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        m, book, _ = self._load()
        yield from self.passed(key, m, book, timerValues)

    def _load(self) -> tuple[SimpleNamespace, Book, dict]:
        names = [x.split()[0] for x in MEMORY.split(", ")]
        m = SimpleNamespace(**dict(zip(names, _held(self.memory) or [None] * len(names))))
        m.valid, m.with_id, m.bare = bool(m.valid), bool(m.with_id), m.bare or 0
        book, before = Book(), {k: v[0] for k, v in self.levels.iterator()}
        for (is_bid, price), qty in before.items():
            book.put(is_bid, price, qty)
        return m, book, before

    def _save(self, m: SimpleNamespace, book: Book, before: dict) -> None:
        now = {(b, p): q for b, side in ((True, book.bid), (False, book.ask)) for p, q in side.qty.items()}
        for k in before.keys() - now.keys():
            self.levels.removeKey(k)
        for k, q in now.items():
            if before.get(k) != q:
                self.levels.updateValue(k, (q,))
        self._remember(m)

    def _remember(self, m: SimpleNamespace) -> None:
        self.memory.update(tuple(getattr(m, x.split()[0]) for x in MEMORY.split(", ")))

    def until(self, key, m, book, e) -> Iterator[Row]:
        """Rows due before an event is applied."""
        return iter(())

    def after(self, key, m, outcome, was_valid, issue) -> Iterator[Row]:
        """Rows due when one has been."""
        return iter(())

    def passed(self, key, m, book, timerValues) -> Iterator[Row]:
        """Rows due as the watermark has come so far."""
        return iter(())


class ReplayOutcomes(Replay):
    """A row for each event."""

    def after(self, key, m, outcome, was_valid, issue) -> Iterator[Row]:
        yield Row(market=key[0], hour=m.hour, n=m.n, outcome=outcome, valid=m.valid, was_valid=was_valid, epoch=m.rests_on if m.valid else None, state=self._state(m), issue=issue)


class ReplaySamples(Replay):
    """The book at the end of every slot of ``interval`` seconds from a market's first event on: as soon as an event
    of a later slot comes, or the watermark passes the slot's end (a quiet slot has the state of the one before)."""

    def __init__(self, interval: int):
        self.interval = interval

    def _due(self, key, m, book, before: int) -> Iterator[Row]:
        for slot in range(m.following, before):
            yield Row(market=key[0], slot=slot, n=m.n, valid=m.valid, state=self._state(m), best_bid=book.bid.most(), best_ask=book.ask.least(), bid_levels=len(book.bid.qty), ask_levels=len(book.ask.qty))
        m.following = max(m.following, before)

    def until(self, key, m, book, e) -> Iterator[Row]:
        own = (e["t"] - 1) // self.interval
        if m.following is None:
            m.following = own
        yield from self._due(key, m, book, own)

    def passed(self, key, m, book, timerValues) -> Iterator[Row]:
        if m.following is None:
            return
        yield from self._due(key, m, book, timerValues.getCurrentWatermarkInMs() // 1000 // self.interval)
        self._remember(m)
        self.handle.registerTimer((m.following + 1) * self.interval * 1000)


class Outages(StatefulProcessor):
    """Usable seconds (market, ts) to alarms: 'open' with a null gap_end when the watermark has passed the end of a
    silence longer than the threshold, 'closed' with both ends when a usable second has followed it. Seconds
    wait until the watermark passes them, so they may come in any order within its delay. Initial state
    (market, start): a market whose silence counts from start on, even if nothing ever comes of it."""

    def __init__(self, threshold: int, step: int):
        self.threshold, self.step = threshold, step

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "n int")
        self.last = handle.getValueState("last", "due long, told boolean")  # the first second of a silence, if it is one

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState["start"], False))
        self.handle.registerTimer((initialState["start"] + self.threshold) * 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r["ts"],), (1,))
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs())

    def _drain(self, key, watermark: int) -> Iterator[Row]:
        due, told = _held(self.last) or (None, False)
        seconds = sorted(k[0] for k in self.waiting.keys())
        for ts in [*(x for x in seconds if x * 1000 <= watermark), None]:
            over = due is not None and (ts is None and (due + self.threshold) * 1000 < watermark or ts is not None and ts - due > self.threshold)
            if over and not told:
                yield Row(market=key[0], gap_start=due, gap_end=None, status="open")
                told = True
            if ts is not None:
                if over:
                    yield Row(market=key[0], gap_start=due, gap_end=ts, status="closed")
                due, told = max(ts + self.step, due or ts + self.step), False
                self.waiting.removeKey((ts,))
        if due is not None:
            self.last.update((due, told))
        later = [x for x in seconds if x * 1000 > watermark]
        if later:
            self.handle.registerTimer(later[0] * 1000)
        if due is not None and not told:
            self.handle.registerTimer((due + self.threshold) * 1000 + 1)


def with_changes(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events with their ``changes`` (side, price, qty) as a list and their time as ``at``, as the replay streams take
    them. Their signature and completeness follow from the list (``marked``)."""
    lists = changes.groupBy("market", "n").agg(F.collect_list(F.struct("side", "price", "qty")).alias("changes"))
    return events.join(dealt(lists), ["market", "n"]).withColumn("at", F.timestamp_seconds("t"))


def _any_level(side: str) -> Column:
    return F.exists("changes", lambda c: (c["side"] == side) & (c["qty"] > 0))


def marked(events: DataFrame) -> DataFrame:
    """Events with the digest of their changes and whether both sides have a positive level."""
    text = F.array_join(F.array_sort(F.transform("changes", lambda c: F.concat_ws(":", c["side"], c["price"].cast("string"), c["qty"].cast("string")))), ",")
    return events.withColumns({"signature": F.sha2(text, 256), "complete": _any_level("bid") & _any_level("ask")})


def packed(events: DataFrame) -> DataFrame:
    """Events with their changes as one text each: a worker holds a market's events of a batch to put them in order, and
    a row a change would take some 500 bytes where a text takes 15."""
    text = F.transform("changes", lambda c: F.concat_ws(":", F.when(c["side"] == "bid", "b").otherwise("a"), c["price"].cast("string"), c["qty"].cast("string")))
    return events.withColumn("changes", F.array_join(text, ","))


def _replay(events: DataFrame, processor: Replay, schema: str, stored: DataFrame | None, delay: str) -> DataFrame:
    keyed = packed(marked(events.withWatermark("at", delay))).groupBy("market")
    initial = stored.select("market", "hour", "frontier", "restored_epoch", "side", "price", "qty").groupBy("market") if stored is not None else None
    return keyed.transformWithState(processor, schema, "append", "EventTime", initial)


def replay_outcomes(events: DataFrame, stored: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of events (``with_changes``) to EVENTS, as ``operators.replay.outcomes`` has them."""
    return _replay(events, ReplayOutcomes(), EVENTS, stored, delay)


def book_samples(events: DataFrame, interval: int, stored: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of events (``with_changes``) to SAMPLES."""
    return _replay(events, ReplaySamples(interval), SAMPLES, stored, delay)


def outage_alarms(usable: DataFrame, threshold: int, step: int, expected: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of usable seconds (market, ts) to ALARMS; ``expected`` has (market, start) of markets that must come."""
    keyed = usable.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay).groupBy("market")
    return keyed.transformWithState(Outages(threshold, step), ALARMS, "append", "EventTime", expected.groupBy("market") if expected is not None else None)
