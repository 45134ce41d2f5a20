"""Stateful streams: outcomes as the state machine has them, alarms that a silence gives, rows that come too late."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_operators import sequential_replay

from ladderlens.streaming import live, stateful

EVENTS = "market long, hour long, n long, t long, kind string, final_id long, prev_id long, changes array<struct<side:string,price:long,qty:long>>"
BOTH = [("bid", 10, 5), ("ask", 12, 5)]


def fed(spark, folder, schema, parts):
    """A stream of rows and what feeds it one part after the other."""
    feeds = [lambda i=i, rows=rows: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in/part={i}") for i, rows in enumerate(parts)]
    return spark.readStream.schema(schema).parquet(f"{folder}/in/part=*"), feeds


def events_of(rows):
    return [(0, h, n, t, k, f, p, c) for h, n, t, k, f, p, c in rows]


def run(spark, folder, rows, build, keys, parts=2, stored=None):
    cut = [rows[len(rows) * i // parts : len(rows) * (i + 1) // parts] for i in range(parts)]
    stream, feeds = fed(spark, folder, EVENTS, [events_of(c) for c in cut])
    with stateful.keyed_state(spark, 2):
        return live.drained(build(stream.withColumn("at", F.timestamp_seconds("t"))), str(folder), keys, "append", feeds).collect()


@pytest.mark.parametrize("seed", range(2))
def test_outcomes_equal_the_state_machine(spark, tmp_path, seed):
    """Duplicates, conflicts, missing hours, incomplete snapshots, null ids and a stored book, over restarts."""
    rng, rows, final, hour = random.Random(seed), [], 0, 0
    for n in range(1, 160):
        hour += rng.random() < 0.08 and 1 + (rng.random() < 0.2)
        kind = "snapshot" if rng.random() < 0.12 else "update"
        changes = BOTH if rng.random() < 0.8 else BOTH[:1]
        changes = [(s, p + n % 2, q + n) for s, p, q in changes]
        if kind == "update" and rng.random() < 0.15 and rows and rows[-1][3] == "update":
            _, _, _, _, final_id, prev, changes = rows[-1]
            if rng.random() < 0.3:
                changes = [(s, p, q + 1) for s, p, q in changes]
        else:
            prev, final = final - (rng.random() < 0.05), final + 1
            final_id = None if kind == "snapshot" and rng.random() < 0.4 else final
            final -= final_id is None
        rows.append((hour, n, n, kind, final_id, prev, changes))
    plain = [(h, n, k, f, p, repr(c), {s for s, _, q in c if q > 0} == {"bid", "ask"}) for h, n, _, k, f, p, c in rows]
    for name, start in (("none", None), ("stored", (0, 0, -5))):
        stored = spark.createDataFrame([(0, *start, s, p, q) for s, p, q in BOTH], "market long, hour long, frontier long, restored_epoch long, side string, price long, qty long") if start else None
        got = run(spark, tmp_path / name, rows, lambda s: stateful.replay_outcomes(s, stored), ["market", "n"], 3)
        assert {r["n"]: (r["outcome"], r["valid"], r["epoch"]) for r in got} == sequential_replay(plain, start)


def test_exact_duplicates_and_null_ids_keep_the_stream_running(spark, tmp_path):
    rows = [(0, 1, 10, "snapshot", 1, None, BOTH), (0, 2, 11, "update", 2, 1, [("bid", 11, 3)]), (0, 3, 12, "update", 2, 1, [("bid", 11, 3)]), (0, 4, 13, "update", 3, 2, [("bid", 11, 0)]), (0, 5, 14, "update", None, None, BOTH), (0, 6, 15, "update", 4, 3, BOTH)]
    got = {r["n"]: (r["outcome"], r["issue"]) for r in run(spark, tmp_path / "a", rows, stateful.replay_outcomes, ["market", "n"])}
    assert got == {1: ("SNAPSHOT_APPLIED", None), 2: ("UPDATE_APPLIED", None), 3: ("DUPLICATE_SKIPPED", None), 4: ("UPDATE_APPLIED", None), 5: ("INVALIDATED", "update_continuity_mismatch"), 6: ("SKIPPED_UNINITIALIZED", None)}
    samples = sorted((r["slot"], r["n"], r["valid"], r["best_bid"], r["ask_levels"]) for r in run(spark, tmp_path / "b", rows, lambda s: stateful.book_samples(s, 1), ["market", "slot"]))
    assert samples == [(9, 1, True, 10, 1), (10, 2, True, 11, 1), (11, 3, True, 11, 1), (12, 4, True, 10, 1), (13, 5, False, None, 0), (14, 6, False, None, 0)]


def test_a_worker_holds_a_text_an_event(spark):
    """What a replay takes of an event is one text, not a row a change; an event without changes has an empty one."""
    events = spark.createDataFrame(events_of([(0, 1, 10, "snapshot", 1, None, [*BOTH, ("bid", 11, 0)]), (0, 2, 11, "update", 2, 1, [])]), EVENTS)
    assert [r["changes"] for r in stateful.packed(stateful.marked(events)).orderBy("n").collect()] == ["b:10:5,a:12:5,b:11:0", ""]


def test_timers_tell_quiet_slots(spark, tmp_path):
    """Market 0 falls silent; market 1 moves the watermark on, and with it market 0's samples, but not past it."""
    rows = [[(0, 0, 1, 5, "snapshot", 1, None, BOTH), (1, 0, 1, 5, "snapshot", 1, None, BOTH)], [(1, 0, 2, 38, "update", 2, 1, [("bid", 11, 1)])]]
    stream, feeds = fed(spark, tmp_path, EVENTS, rows)
    with stateful.keyed_state(spark, 2):
        out = live.drained(stateful.book_samples(stream.withColumn("at", F.timestamp_seconds("t")), 10), str(tmp_path), ["market", "slot"], "append", feeds).collect()
    assert sorted((r["market"], r["slot"], r["best_bid"]) for r in out) == [(m, s, 10) for m in (0, 1) for s in (0, 1, 2)]


def test_an_outage_that_lasts_is_told_once(spark, tmp_path):
    """Threshold 60. Market 0 has seconds 0, 1 and 61 (59 seconds between: none), then 200 (an outage that ended) and nothing
    more, while market 1 goes on to 500; market 2 is expected since 100 and never comes. Rows of a batch are out of order."""
    parts = [[(0, 61), (0, 0), (0, 1), (1, 0)], [(1, t) for t in range(50, 250, 50)] + [(0, 200)], [(1, t) for t in range(250, 501, 50)]]
    stream, feeds = fed(spark, tmp_path, "market long, ts long", parts)
    expected = spark.createDataFrame([(2, 100)], "market long, start long")
    with stateful.keyed_state(spark, 2):
        rows = live.drained(stateful.outage_alarms(stream, 60, 1, expected), str(tmp_path), ["market", "gap_start", "status"], "append", feeds).collect()
    got = sorted((r["market"], r["gap_start"], r["status"], r["gap_end"]) for r in rows)
    assert got == [(0, 62, "closed", 200), (0, 62, "open", None), (0, 201, "open", None), (2, 100, "open", None)]


def test_alarms_don_t_depend_on_batches(spark, tmp_path):
    """The same seconds, late ones within the delay, in one batch and in four."""
    rng = random.Random(3)
    seconds = [(m, t) for m in (0, 1) for t in sorted(rng.sample(range(0, 2000), 40))]
    order = sorted(seconds, key=lambda x: x[1] + rng.random() * 90)
    found = []
    for name, parts in (("one", [order]), ("four", [order[i * 20 : i * 20 + 20] for i in range(4)])):
        stream, feeds = fed(spark, tmp_path / name, "market long, ts long", parts)
        with stateful.keyed_state(spark, 2):
            rows = live.drained(stateful.outage_alarms(stream, 60, 1, delay="100 seconds"), str(tmp_path / name), ["market", "gap_start", "status"], "append", feeds).collect()
        found.append(sorted(map(str, rows)))
    assert found[0] == found[1] and found[0]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    parts = [[(1, 1000), (2, 5000)], [(3, 4099), (4, 4100), (5, 4101), (5, 4101), (6, 9000)], [(7, 5000)]]
    stream, feeds = fed(spark, tmp_path, "id long, s long", parts)
    rows = live.late_rows(stream.select("id", F.timestamp_seconds("s").alias("ts")), str(tmp_path), ["id"], feeds=feeds).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == [(2, 0, 2), (5, 2, 2), (1, 1, 0)]
