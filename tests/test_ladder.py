"""Books kept over streams of changes, and distributed selection, against plain code."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderlens.operators import book, ladder, replay, stats

CHANGES = "market long, hour long, n long, epoch long, side string, price decimal(18,8), qty decimal(18,8)"


@pytest.mark.parametrize("seed", range(3))
def test_ladder_equals_a_dict(seed, monkeypatch):
    monkeypatch.setattr(ladder, "RUN", 4)
    rng, one, plain = random.Random(seed), ladder.Ladder(), {}
    for _ in range(3000):
        p, q = rng.randrange(1, 120), rng.choice((0, 0, 1, 5, 10**12))
        assert one.put(p, q) == plain.get(p, 0)
        plain[p] = q
        if not q:
            del plain[p]
        low, high = rng.randrange(130), rng.randrange(130)
        inside = [x for x in plain if low <= x <= high]
        assert one.within(low, high) == (len(inside), sum(x * plain[x] for x in inside))
        assert (one.least(), one.most()) == (min(plain, default=None), max(plain, default=None))
        assert all(one.runs) and one.heads == [r[0] for r in one.runs] and max(map(len, one.runs), default=0) <= 5


def random_changes(seed, events=120):
    """Applied events of two markets over hours of which some begin with a carried book, one change a price and event."""
    rng, rows = random.Random(seed), []
    for market in (0, 1):
        hour, epoch = 5, None
        for n in range(1, events):
            if rng.random() < 0.1:
                hour += 1
            if epoch is None or rng.random() < 0.05:
                epoch = n
            prices = rng.sample(range(1, 40), 4 if epoch == n else 2)
            rows += [(market, hour, n, epoch, rng.choice(("bid", "ask")), Decimal(p), Decimal(rng.choice((0, 0, 1, 3)))) for p in prices]
    return rows


def plain_books(rows):
    """The book after each event: (market, n) -> (hour, {(side, price): qty}, zero changes, removed)."""
    out, levels, last, zero = {}, {}, None, [0, 0]
    for market, hour, n, epoch, side, price, qty in rows:
        if (market, epoch) != last:
            levels, last = {}, (market, epoch)
        if (market, n) not in out:
            zero = [0, 0]
        had = levels.pop((side, price), 0)
        if qty:
            levels[side, price] = qty
        zero[0] += qty == 0
        zero[1] += qty == 0 and had > 0 and n != epoch
        out[market, n] = (hour, dict(levels), *zero)
    return out


def structure(levels):
    b, a = max((p for s, p in levels if s == "bid"), default=None), min((p for s, p in levels if s == "ask"), default=None)
    return "EMPTY_BOTH" if a is b is None else "EMPTY_BID" if b is None else "EMPTY_ASK" if a is None else "NORMAL" if b < a else "LOCKED" if b == a else "CROSSED"


@pytest.mark.parametrize("seed", range(2))
def test_structure_counts_equal_plain_books(spark, seed):
    rows = random_changes(seed)
    want = {}
    for (market, _), (hour, levels, zero, removed) in plain_books(rows).items():
        c = want.setdefault((market, hour), dict.fromkeys(["zero_changes", "removed", *[x.lower() for x in ladder.STRUCTURES]], 0))
        c["zero_changes"] += zero
        c["removed"] += removed
        c[structure(levels).lower()] += 1
        c["bid_levels"], c["ask_levels"] = (sum(s == side for s, _ in levels) for side in ("bid", "ask"))
    got = {(r["market"], r["hour"]): {k: v for k, v in r.asDict().items() if k not in ("market", "hour")} for r in ladder.structure_counts(spark.createDataFrame(rows, CHANGES)).collect()}
    assert got == want and any(c["crossed"] for c in want.values())


@pytest.mark.parametrize("size", [2, 512])
def test_depth_equals_plain_sums(spark, size, monkeypatch):
    """Samples of swept books at prices with decimals, over blocks that begin in the middle of an epoch."""
    monkeypatch.setattr(book, "SWEPT", size)
    monkeypatch.setattr(ladder, "RUN", 4)
    rows = [(m, h, n, e, s, p + Decimal("0.12345678"), q / 8) for m, h, n, e, s, p, q in random_changes(9)]
    changes = spark.createDataFrame(rows, CHANGES).withColumn("t", F.col("n"))
    books = plain_books(rows)
    sampled = spark.createDataFrame([(m, n // 3, n, next(r[3] for r in rows if r[0] == m and r[2] == n), True, "SNAPSHOT") for m, n in books if n % 3 == 2], "market long, slot long, n long, epoch long, valid boolean, state string")
    slot = lambda t: F.floor(F.col(t) / 3).cast("long")
    shares = [(0, "0", "0.5"), (1, "0.05", "0.3"), (2, "0", "0")]
    bands = spark.createDataFrame(shares, "band int, lower string, upper string")
    want, tops = {}, {}
    for (m, n), (_, levels, _, _) in books.items():
        if n % 3 != 2:
            continue
        b, a = max((p for s, p in levels if s == "bid"), default=None), min((p for s, p in levels if s == "ask"), default=None)
        tops[m, n // 3] = (b, a)
        if structure(levels) == "NORMAL":
            for band, lower, upper in shares:
                lower, upper = Decimal(lower), Decimal(upper)
                bids = [p * q for (s, p), q in levels.items() if s == "bid" and b * (1 - upper) <= p <= b * (1 - lower)]
                asks = [p * q for (s, p), q in levels.items() if s == "ask" and a * (1 + lower) <= p <= a * (1 + upper)]
                want[m, n // 3, band] = (sum(bids, Decimal(0)), sum(asks, Decimal(0)), len(bids), len(asks))
    lives = book.lifetimes(changes)
    got = {(r["market"], r["slot"], r["band"]): (r["bid"], r["ask"], r["bid_levels"], r["ask_levels"]) for r in book.depth(sampled, lives, bands, slot).collect()}
    assert got == want and want
    assert {(r["market"], r["slot"]): (r["best_bid"], r["best_ask"]) for r in book.best_prices(sampled, lives, slot).collect()} == tops


def test_whole_hours_with_carried_and_missing_ones(spark):
    """Hours of 6 with slots of 2: an event at an hour's very start is in its first slot; the hour after a missing one begins empty."""
    e = spark.createDataFrame([(0, 1, 1, 6, "snapshot", 1, 0), (0, 1, 2, 8, "update", 2, 1), (0, 1, 3, 9, "update", 3, 2), (0, 2, 4, 15, "update", 4, 3), (0, 4, 5, 27, "update", 5, 4)], "market long, hour long, n long, t long, kind string, final_id long, prev_id long")
    marks = spark.createDataFrame([(0, n, str(n), True) for n in range(1, 6)], "market long, n long, signature string, complete boolean")
    got = [(r["hour"], r["slot"], r["t_end"], r["n"], r["valid"], r["state"], r["last_id"]) for r in book.hour_samples(replay.outcomes(e, marks), 2, 6).orderBy("hour", "slot").collect()]
    assert got == [
        (1, 0, 8, 2, True, "SNAPSHOT", 2), (1, 1, 10, 3, True, "SNAPSHOT", 3), (1, 2, 12, 3, True, "SNAPSHOT", 3), (2, 0, 14, 3, True, "CARRIED", 3), (2, 1, 16, 4, True, "CARRIED", 4), (2, 2, 18, 4, True, "CARRIED", 4),
        (4, 0, 26, None, False, "UNINITIALIZED", None), (4, 1, 28, 5, False, "UNINITIALIZED", None), (4, 2, 30, 5, False, "UNINITIALIZED", None),
    ]


def test_medians_and_tails_of_buckets(spark):
    """Keys with one, even and odd numbers of values, heavy ties, negative and tiny ones, more distinct values than buckets."""
    rng = random.Random(1)
    groups = {"one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 500, "ties": [rng.choice((1.0, 2.0, 3.0)) for _ in range(1001)], "many": [rng.gauss(0, 1) ** 3 for _ in range(2000)], "tiny": [1e-300 * i for i in range(999)]}
    values = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("many", None), ("none", None)], "k string, v double").repartition(5)
    got = {r["k"]: (r["median"], r["n"]) for r in stats.medians(values, ["k"], "v").collect()}
    assert got == {k: (float(np.median(v)), len(v)) for k, v in groups.items()}
    scale = {r["k"]: (r["mad"], r["scale_kind"]) for r in stats.robust_scale(values, ["k"], "v").collect()}
    for k, v in groups.items():
        assert scale[k][0] == float(np.median(np.abs(np.array(v) - np.median(v))))
    assert scale["same"][1] == "ZERO"
    tails = {(r["k"], r["v"]): (r["lower_tail"], r["upper_tail"]) for r in stats.tail_fractions(values, ["k"], "v").collect()}
    for k in ("two", "ties", "many"):
        for v in set(groups[k]):
            lower, ties = sum(x < v for x in groups[k]), groups[k].count(v)
            others = len(groups[k]) - 1
            assert tails[k, v] == ((lower + (ties - 1) / 2) / others, (len(groups[k]) - lower - ties + (ties - 1) / 2) / others)
