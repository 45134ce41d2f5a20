"""Hand cases and comparisons with plain sequential code."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ladderlens.operators import bars, book, catalog, hours, price, replay, stats, views
from ladderlens.sources import archive


def sequential_replay(events, start=None):
    """Plain state machine over (hour, n, kind, final_id, prev_id, signature, complete); ``start`` is (hour,
    frontier, epoch) of a stored book that the first hour begins with."""
    valid, frontier, epoch, out, last_hour = False, None, None, {}, None
    before, snapshots = None, 0  # the event before; snapshots with and without an id in this hour
    for hour, n, kind, final, prev, sig, complete in events:
        if hour != last_hour:
            snapshots = [0, 0]
            if start and start[0] == hour:
                valid, frontier, epoch, before = True, *start[1:], None
            elif last_hour is not None and hour != last_hour + 1:
                valid, frontier, epoch, before = False, None, None, None
            last_hour = hour
        if kind == "snapshot":
            snapshots[final is None] += 1
            ok = complete and (final is not None or (valid and snapshots == [0, 1]))
            valid, state, epoch = ok, "SNAPSHOT_APPLIED" if ok else "INVALIDATED", n if ok else None
        elif not valid:
            state = "SKIPPED_UNINITIALIZED"
        elif before is not None and before[0] == "update" and final == before[1] == frontier and sig == before[2]:
            state = "DUPLICATE_SKIPPED"
        elif prev == frontier:
            state = "UPDATE_APPLIED"
        else:
            valid, state = False, "INVALIDATED"
        if final is not None:
            frontier = final
        before = (kind, final, sig)
        out[n] = (state, valid, epoch if valid else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_sequential(spark, seed):
    rng = random.Random(seed)
    events, final, hour = [], 0, 0
    for n in range(1, 300):
        hour += rng.random() < 0.08 and 1 + (rng.random() < 0.2)
        kind = "snapshot" if rng.random() < 0.1 else "update"
        if kind == "update" and rng.random() < 0.1 and events and events[-1][2] == "update":
            _, _, _, final_id, prev, sig, _ = events[-1]
            sig += "x" * (rng.random() < 0.3)
        else:
            prev, final = final - (rng.random() < 0.05), final + 1
            final_id, sig = None if kind == "snapshot" and rng.random() < 0.4 else final, f"s{n}"
            final -= final_id is None  # the frontier stays
        events.append((hour, n, kind, final_id, prev, sig, rng.random() < 0.8))
    e = spark.createDataFrame([(0, h, n, n, k, f, p) for h, n, k, f, p, _, _ in events], "market long, hour long, n long, t long, kind string, final_id long, prev_id long")
    marks = spark.createDataFrame([(0, n, sig, c) for _, n, _, _, _, sig, c in events], "market long, n long, signature string, complete boolean")
    for start in (None, (0, 0, -5)):
        stored = spark.createDataFrame([(0, *start)], replay.RESTORED) if start else None
        got = {r["n"]: (r["outcome"], r["valid"], r["epoch"]) for r in replay.outcomes(e, marks, stored).collect()}
        assert got == sequential_replay(events, start)


def test_replay_gap_between_hours_drops_the_book(spark):
    e = spark.createDataFrame([(0, 1, 1, 1, "snapshot", 1, 0), (0, 2, 2, 2, "update", 2, 1), (0, 4, 3, 3, "update", 3, 2)], "market long, hour long, n long, t long, kind string, final_id long, prev_id long")
    marks = spark.createDataFrame([(0, n, str(n), True) for n in (1, 2, 3)], "market long, n long, signature string, complete boolean")
    assert [r["outcome"] for r in replay.outcomes(e, marks).orderBy("n").collect()] == ["SNAPSHOT_APPLIED", "UPDATE_APPLIED", "SKIPPED_UNINITIALIZED"]


def test_depth_bounds_are_exact_and_inclusive(spark):
    """Best ask 100 with 15 percent reaches 115, which doubles put just below; best bid 100 reaches 90."""
    levels = spark.createDataFrame([(0, 1, s, p, 2, 1, None, 1, None) for s, p in (("bid", 90), ("bid", 89), ("bid", 100), ("ask", 101), ("ask", 110), ("ask", 116), ("ask", 117))], "market long, epoch long, side string, price long, qty long, from_n long, to_n long, from_t long, to_t long")
    sampled = spark.createDataFrame([(0, 7, 1, 1, True, "SNAPSHOT")], "market long, slot long, n long, epoch long, valid boolean, state string")
    slot = lambda t: F.col(t) * 0 + 7
    assert book.best_prices(sampled, levels, slot).first()["structure"] == "NORMAL"
    bands = spark.createDataFrame([(0, "0", "0.1"), (1, "0.1", "0.15"), (2, "0", "0")], "band int, lower string, upper string")
    rows = {r["band"]: (int(r["bid"]), int(r["ask"]), r["bid_levels"], r["ask_levels"]) for r in book.depth(sampled, levels, bands, slot).collect()}
    assert rows == {0: (380, 422, 2, 2), 1: (358, 232, 2, 1), 2: (200, 202, 1, 1)}
    edge = book.intervals(bands, spark.createDataFrame([(100, 100)], "best_bid long, best_ask long")).where("band = 1").first()
    assert str(edge["ask_high"]) == "115.0000000000000000"
    with pytest.raises(ValueError):
        book.intervals(spark.createDataFrame([(0, "0.5", "0.2")], "band int, lower string, upper string"), sampled)


def test_boundary_trade_belongs_to_the_new_second(spark):
    t = spark.createDataFrame([("x", 999, 1, 5.0), ("x", 1000, 2, 6.0), ("x", 1000, 3, 7.0)], "symbol string, trade_ms long, ordinal long, price double")
    got = {r["slot"]: (r["open"], r["close"]) for r in price.ohlc(t, 1000).collect()}
    assert got == {0: (5.0, 5.0), 1: (6.0, 7.0)}


def test_conflicting_trade_id(spark):
    t = spark.createDataFrame([("x", "a", 1, 1.0, 1.0, 1), ("x", "a", 1, 2.0, 1.0, 2), ("x", "b", 1, 1.0, 1.0, 3), ("x", "b", 1, 1.0, 1.0, 4)], "symbol string, trade_id string, trade_ms long, price double, qty double, ordinal long")
    assert {r["trade_id"]: (r["copies"], r["conflict"], r["price"]) for r in price.deduplicated(t).collect()} == {"a": (2, True, 1.0), "b": (2, False, 1.0)}


def test_outage_needs_more_than_the_threshold(spark):
    u = spark.createDataFrame([(0, x) for x in (0, 1, 62, 124)], "market long, ts long")
    expected = spark.createDataFrame([(0,), (1,)], "market long")
    got = [(r["market"], r["gap_start"], r["gap_end"]) for r in bars.outages(u, expected, 0, 200, 60).orderBy("market", "gap_start").collect()]
    assert got == [(0, 63, 124), (0, 125, 200), (1, 0, 200)]  # market 1 has no usable second at all


def test_week_starts_on_monday(spark):
    assert spark.range(1).select(bars.floor_to(F.lit(1_704_067_200 + 6 * 86400), 604800)).first()[0] == 1_704_067_200


def test_score_needs_twenty_bars_and_spread(spark):
    few = spark.createDataFrame([(0, i, float(i)) for i in range(19)], "scan int, ts int, v double")
    flat = spark.createDataFrame([(1, i, 5.0) for i in range(30)], "scan int, ts int, v double")
    got = stats.extremeness(few.union(flat), ["scan"], "v", "ts").where("score IS NOT NULL").count()
    assert got == 0


def test_hours_round_trip_and_conflict(spark, tmp_path):
    s = spark.createDataFrame([(0, 5, 1, 2, "VALID"), (0, 6, None, None, "INVALID")], "market long, ts long, bid long, ask long, quality string")
    packed = hours.packed(s, ["market"], 3600, ["bid", "ask"])
    assert sorted(map(tuple, hours.unpacked(packed, ["market"], 3600).select("market", "ts", "bid", "ask", "quality").collect()), key=repr) == sorted(map(tuple, s.collect()), key=repr)
    path = str(tmp_path / "hours")
    assert hours.write_hours(packed, path, ["market", "hour"]) == 1
    assert hours.write_hours(packed, path, ["market", "hour"]) == 0
    assert hours.read_hours(spark, path, 0, 1).count() == 1 and hours.read_hours(spark, path, 1, 9).count() == 0
    plan = hours.read_hours(spark, path, 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan
    with pytest.raises(hours.HourConflict):
        hours.write_hours(packed.withColumn("content_sha256", F.lit("x")), path, ["market", "hour"])


def test_silent_seconds_are_invalid_on_a_grid(spark):
    s = spark.createDataFrame([(0, 5, 1, 2, "VALID"), (1, 5, 3, 4, "VALID"), (0, 6, 1, 2, "VALID")], "market long, ts long, bid long, ask long, quality string")
    grid = spark.range(5, 8).select(F.col("id").alias("ts"))
    got = {r["ts"]: (r["quality"], r["source_count"], r["bid"]) for r in bars.market_sum(s, 2, grid=grid).collect()}
    assert got == {5: ("VALID", 2, 4), 6: ("DEGRADED", 1, 1), 7: ("INVALID", 0, None)}


def test_contract_of_columns(spark, tmp_path):
    good = spark.createDataFrame([], archive.TRADE_SCHEMA + ", extra int")
    assert archive.require(good, archive.TRADE_SCHEMA).columns == [x.split()[0] for x in archive.TRADE_SCHEMA.split(", ")]
    for bad in (good.drop("price"), good.withColumn("price", F.lit(1.0))):
        with pytest.raises(archive.ContractError, match="price"):
            archive.require(bad, archive.TRADE_SCHEMA)
    with pytest.raises(archive.ContractError):
        archive.read_source(spark, str(tmp_path), "candles")


def test_rejected_rows_fail_in_strict_mode(spark):
    t = spark.createDataFrame([("x", "a", 1, "1.5", "1"), ("x", "b", 1, "abc", "1")], "symbol string, trade_id string, trade_ms long, price string, qty string")
    judged = price.judged_trades(t)
    assert price.strict(judged.where("trade_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="rejected row: not_decimal"):
        price.strict(judged).collect()


def test_requests(spark):
    r = spark.createDataFrame([(7_500_000, 9_100_000, 3600), (9_900_000, 9_100_000, 3600), (0, 3_600_000_000, 3600)], "start_us long, end_us long, most_seconds long")
    got = [(x["start"], x["end"], x["problem"]) for x in views.request_slots(r).collect()]
    assert got == [(7, 10, None), (9, 10, "reversed"), (0, 3601, "too_long")]


def test_local_days_follow_the_clock():
    assert catalog.local_day("Europe/Berlin", "2024-03-31") == (1711839600, 1711922400)  # 23 hours
    with pytest.raises(ValueError):
        catalog.local_day("America/Sao_Paulo", "2018-11-04")  # its midnight does not exist
