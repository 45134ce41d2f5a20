"""Queries over rebuilt books, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.operators import book as B
from ladderlens.operators import replay as R
from ladderlens.plans.event_queries import LIVES, REPLAY, RICH, replay_sql, replayed, rich
from ladderlens.plans.staging import kept
from ladderlens.sources import stand_in as S

SLOT, PER_HOUR, DAY = 7 * 86400, 4, 86400
BANDS = [(0, "0", "0.25"), (1, "0.25", "0.75"), (2, "0", "0.15"), (3, "0.05", "0.1")]
SIDE_PRICES = [("bid", 2000), ("ask", 2150)]

LIVE = REPLAY + ", vc AS (SELECT c.*, r.epoch FROM changes c JOIN replayed r USING (market, n) WHERE r.valid), " + LIVES
SAMPLES = (
    f""", ls AS (SELECT market, (t - 1) // {SLOT} AS slot, max(n) AS n FROM replayed GROUP BY ALL),
 grid AS (SELECT market, unnest(generate_series(a, b)) AS slot FROM (SELECT market, min(slot) AS a, max(slot) AS b FROM ls GROUP BY market)),
 sampled AS (SELECT g.market, g.slot, (g.slot + 1) * {SLOT} AS t_end, r.n, r.epoch, r.valid, r.state, CASE WHEN r.valid THEN r.known_id END AS last_id FROM grid g ASOF JOIN ls USING (market, slot) JOIN (SELECT *, last_value(final_id IGNORE NULLS) OVER (PARTITION BY market ORDER BY n) AS known_id FROM replayed) r ON r.market = ls.market AND r.n = ls.n),
 meet AS (SELECT s.market, s.slot, l.side, l.price, l.qty FROM sampled s JOIN lives l ON s.market = l.market AND s.epoch = l.epoch AND s.n >= l.from_n AND (l.to_n IS NULL OR s.n < l.to_n) WHERE s.valid),
 tops AS (SELECT market, slot, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels FROM meet GROUP BY ALL),
 st AS (SELECT s.*, best_bid, best_ask, coalesce(bid_levels, 0) AS bid_levels, coalesce(ask_levels, 0) AS ask_levels, CASE WHEN s.valid THEN CASE WHEN best_bid IS NULL AND best_ask IS NULL THEN 'EMPTY_BOTH'
 WHEN best_bid IS NULL THEN 'EMPTY_BID' WHEN best_ask IS NULL THEN 'EMPTY_ASK' WHEN best_bid < best_ask THEN 'NORMAL' WHEN best_bid = best_ask THEN 'LOCKED' ELSE 'CROSSED' END END AS structure FROM sampled s LEFT JOIN tops USING (market, slot)),
 topped AS (SELECT *, CASE WHEN structure = 'NORMAL' THEN 'VALID' ELSE 'INVALID' END AS quality, CASE WHEN NOT valid AND state = 'INVALIDATED' THEN 'replay_invalidated' WHEN NOT valid THEN 'uninitialized' WHEN structure <> 'NORMAL' THEN lower(structure) END AS reason FROM st)"""
)
SAMPLED = LIVE + SAMPLES
FRACTION = "CAST({0} AS DECIMAL(9,8))"
MONEY = "CAST({0} AS DECIMAL(28,8))"
DEPTH = SAMPLED + (
    ", bands(band, lower, upper) AS (VALUES " + ", ".join(f"({b}, {FRACTION.format(x)}, {FRACTION.format(y)})" for b, x, y in BANDS) + "),"
    f""" bounds AS (SELECT market, slot, band, {MONEY.format('best_bid')} * {FRACTION.format('1 - upper')} AS bid_low, {MONEY.format('best_bid')} * {FRACTION.format('1 - lower')} AS bid_high,
 {MONEY.format('best_ask')} * CAST(1 + lower AS DECIMAL(9,8)) AS ask_low, {MONEY.format('best_ask')} * CAST(1 + upper AS DECIMAL(9,8)) AS ask_high FROM topped, bands WHERE structure = 'NORMAL'),
 dep0 AS (SELECT market, slot, band, side = 'bid' AND price BETWEEN bid_low AND bid_high AS is_bid, side = 'ask' AND price BETWEEN ask_low AND ask_high AS is_ask, price * qty AS v FROM meet JOIN bounds USING (market, slot)),
 dep AS (SELECT market, slot, band, coalesce(CAST(sum(v) FILTER (is_bid) AS BIGINT), 0) AS bid, coalesce(CAST(sum(v) FILTER (is_ask) AS BIGINT), 0) AS ask, count(*) FILTER (is_bid) AS bid_levels, count(*) FILTER (is_ask) AS ask_levels FROM dep0 GROUP BY ALL),
 liquid AS (SELECT t.market, t.slot, b.band, t.quality, t.reason, d.bid, d.ask, d.bid + d.ask AS total, d.bid_levels, d.ask_levels, CASE WHEN t.quality = 'VALID' THEN 1 ELSE 0 END AS source_count FROM topped t, bands b LEFT JOIN dep d ON d.market = t.market AND d.slot = t.slot AND d.band = b.band)"""
)
CHECKPOINT = LIVE + """, ends AS (SELECT market, hour, max(n) AS n FROM replayed GROUP BY ALL), vends AS (SELECT e.market, e.hour, e.n, r.epoch, r.final_id FROM ends e JOIN replayed r USING (market, n) WHERE r.valid),
 cp AS (SELECT e.market, e.hour AS through_hour, e.final_id AS last_id, l.side, l.price, l.qty, row_number() OVER (PARTITION BY e.market, e.hour, l.side ORDER BY CASE WHEN l.side = 'bid' THEN -l.price ELSE l.price END) AS place
 FROM vends e JOIN lives l ON e.market = l.market AND e.epoch = l.epoch AND e.n >= l.from_n AND (l.to_n IS NULL OR e.n < l.to_n))"""

#: Chains of hours after every third one that begin with its checkpoint.
RESTORED = CHECKPOINT + f""", good AS (SELECT market, through_hour, max(last_id) AS f0 FROM cp WHERE through_hour % 3 = 0 GROUP BY ALL HAVING bool_or(side = 'bid') AND bool_or(side = 'ask')),
 ev3 AS (SELECT * FROM ev WHERE hour % 3 <> 0), starts AS (SELECT e.market, e.hour, max(f0) AS f0, min(n) - 1 AS e0 FROM ev3 e JOIN good g ON g.market = e.market AND g.through_hour + 1 = e.hour GROUP BY ALL),{replay_sql('ev3', 'marks', 'starts', 'restored')}"""
BOUNDS = ("bid_low", "bid_high", "ask_low", "ask_high")


def _live(spark, d, changes=None):
    changes = changes or kept(S.changes(spark, d))
    r = kept(R.outcomes(R.marked_events(changes)))
    return r, B.valid_changes(changes, r)


def by_slot(t):
    return B.slot_of(t, SLOT)


def by_hour(t):
    return F.expr(f"{t} div {S.HOUR}")


def bands(spark):
    return spark.createDataFrame(BANDS, "band int, lower string, upper string")


def topped(spark, d):
    r, changes = _live(spark, d)
    return B.best_prices(B.samples(r, SLOT), B.lifetimes(changes), by_slot)


def depth(spark, d):
    r, changes = _live(spark, d)
    return B.depth(B.samples(r, SLOT), B.lifetimes(changes), bands(spark), by_slot)


def liquid(spark, d):
    r, changes = _live(spark, d)
    return B.liquidity_hours(kept(B.samples(r, SLOT)), B.lifetimes(changes), bands(spark), by_slot)


def met(spark, d):
    r, changes = _live(spark, d)
    return B.meeting(B.samples(r, SLOT), B.lifetimes(changes), by_slot)


def checkpoints(spark, d, changes=None):
    r, changes = _live(spark, d, changes)
    return B.checkpoints(r, B.lifetimes(changes), by_hour)


def checkpoint_plan(spark, d):
    every = kept(S.changes(spark, d))
    c = checkpoints(spark, d, every).where("through_hour % 3 = 0").select("market", "through_hour").distinct()
    hours = every.select("market", "hour").distinct()
    return B.checkpoint_plan(hours, c, hours.where("hour % 17 <> 0"), 6)


def from_checkpoints(spark, d):
    """Replays of every third hour and the one after it that begin with the checkpoint of the hour before."""
    every = kept(S.changes(spark, d))
    r, changes = _live(spark, d, every)
    stored = B.eligible(kept(B.checkpoints(r, B.lifetimes(changes), by_hour).where("through_hour % 3 = 0")))
    starts, levels = R.restored(r, stored)
    after = changes.where("hour % 3 <> 0").drop("epoch")
    again = R.outcomes(R.marked_events(every.where("hour % 3 <> 0")), restored=starts)
    return again, B.valid_changes(after, again), levels


def continued(spark, d):
    """The books at the ends of hours replayed from a checkpoint."""
    again, changes, levels = from_checkpoints(spark, d)
    every = changes.select("market", "epoch", "side", "price", "qty", "n", "t").unionByName(levels.select("market", "epoch", "side", "price", "qty", "n", "t"))
    return B.checkpoints(again, B.lifetimes(every), by_hour)


QUERIES = {
    "b1_level_lifetimes": (lambda s, d: B.lifetimes(_live(s, d)[1]), f"WITH {LIVE} SELECT market, epoch, side, price, qty, from_n, to_n, from_t, to_t FROM lives"),
    "b4_best_prices": (topped, f"WITH {SAMPLED} SELECT * FROM topped"),
    "b5_price_range": (lambda s, d: B.price_range(met(s, d), 1800, 2400), f"WITH {SAMPLED} SELECT market, slot, side, count(*) AS levels, CAST(sum(qty) AS BIGINT) AS qty FROM meet WHERE price BETWEEN 1800 AND 2400 GROUP BY ALL"),
    "b5_quantity_at_price": (lambda s, d: B.quantity_at(met(s, d), s.createDataFrame(SIDE_PRICES, "side string, price long")), f"WITH {SAMPLED} SELECT market, slot, side, price, qty FROM meet WHERE (side, price) IN (('bid', 2000), ('ask', 2150))"),
    "b6_change_counters": (lambda s, d: B.change_counters(_live(s, d)[1]), f"WITH {LIVE} SELECT market, count(*) AS changes, count(*) FILTER (qty = 0) AS zero_changes, count(*) FILTER (qty = 0 AND before > 0) AS removed FROM (SELECT *, lag(qty) OVER (PARTITION BY market, epoch, side, price ORDER BY n) AS before FROM vc) GROUP BY market"),
    "b7_sampling": (lambda s, d: B.samples(replayed(s, d), SLOT), f"WITH {SAMPLED} SELECT * FROM sampled"),
    "b7_hour_samples": (
        lambda s, d: B.hour_samples(rich(s, d), DAY, S.HOUR),
        f"""WITH {RICH}, r AS (SELECT *, last_value(final_id IGNORE NULLS) OVER (PARTITION BY market ORDER BY n) AS known_id, greatest(0, (t - hour * {S.HOUR} - 1) // {DAY}) AS slot FROM replayed), h AS (SELECT market, hour, max(n) AS last_n FROM r GROUP BY ALL),
 grid AS (SELECT h.market, h.hour, CAST(s AS BIGINT) AS slot, p.last_n FROM h LEFT JOIN h p ON p.market = h.market AND p.hour = h.hour - 1, generate_series(0, {S.HOUR // DAY - 1}) x(s)),
 held AS (SELECT g.market, g.hour, g.slot, max(r.n) AS own, any_value(last_n) AS before FROM grid g LEFT JOIN r ON r.market = g.market AND r.hour = g.hour AND r.slot <= g.slot GROUP BY ALL)
 SELECT a.market, a.hour, a.slot, a.hour * {S.HOUR} + (a.slot + 1) * {DAY} AS t_end, r.n, r.epoch, coalesce(r.valid, false) AS valid, CASE WHEN own IS NULL AND r.valid THEN 'CARRIED' ELSE coalesce(r.state, 'UNINITIALIZED') END AS state, CASE WHEN r.valid THEN known_id END AS last_id FROM held a LEFT JOIN r ON r.market = a.market AND r.n = coalesce(own, before)""",
    ),
    "b10_sample_counts": (lambda s, d: B.sample_counts(topped(s, d), PER_HOUR), f"WITH {SAMPLED} SELECT market, slot // {PER_HOUR} AS hour, count(*) AS slots, count(*) FILTER (quality = 'VALID') AS valid, 0::BIGINT + count(*) FILTER (quality = 'DEGRADED') AS degraded, count(*) FILTER (quality = 'INVALID') AS invalid, count(*) FILTER (quality = 'VALID') = {PER_HOUR} AS fully_valid FROM topped GROUP BY ALL"),
    "b11_depth_intervals": (lambda s, d: B.intervals(bands(s), topped(s, d).where("structure = 'NORMAL'").select("market", "slot", "best_bid", "best_ask")).select("market", "slot", "band", *[F.col(x).cast("string").alias(x) for x in BOUNDS]), f"WITH {DEPTH} SELECT market, slot, band, {', '.join(f'CAST({x} AS VARCHAR) AS {x}' for x in BOUNDS)} FROM bounds"),
    "b12_depth_liquidity": (lambda s, d: depth(s, d).select("market", "slot", "band", *[F.col(x).cast("long").alias(x) for x in ("bid", "ask", "total")], "bid_levels", "ask_levels", F.round("imbalance", 9).alias("imbalance")), f"WITH {DEPTH} SELECT market, slot, band, bid, ask, bid + ask AS total, bid_levels, ask_levels, CASE WHEN bid + ask <> 0 THEN round(CAST(bid - ask AS DOUBLE) / CAST(bid + ask AS DOUBLE), 9) END AS imbalance FROM dep"),
    "b13_liquidity_hours": (lambda s, d: liquid(s, d).select("market", F.expr(f"slot div {PER_HOUR}").alias("hour"), "slot", "band", "quality", "reason", F.col("bid").cast("long").alias("bid"), F.col("ask").cast("long").alias("ask"), "source_count"), f"WITH {DEPTH} SELECT market, slot // {PER_HOUR} AS hour, slot, band, quality, reason, bid, ask, source_count FROM liquid"),
    "b14_quality_summary": (lambda s, d: B.quality_summary(liquid(s, d), ["market", "band"]).withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")), f"WITH {DEPTH}, q AS (SELECT market, band, reason, count(*) AS n, count(*) FILTER (quality = 'VALID') AS v, count(*) FILTER (quality = 'DEGRADED') AS g, count(*) FILTER (quality = 'INVALID') AS i, count(*) FILTER (total = 0) AS z FROM liquid GROUP BY ALL) SELECT market, band, CAST(sum(n) AS BIGINT) AS slots, CAST(sum(v) AS BIGINT) AS valid, CAST(sum(g) AS BIGINT) AS degraded, CAST(sum(i) AS BIGINT) AS invalid, CAST(sum(z) AS BIGINT) AS zero_total, coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason), '') AS reasons FROM q GROUP BY market, band"),
    "k1_checkpoints": (checkpoints, f"WITH {CHECKPOINT} SELECT * FROM cp"),
    "k4_checkpoint_state": (lambda s, d: B.checkpoint_state(checkpoints(s, d)), f"WITH {CHECKPOINT} SELECT market, through_hour, count(*) AS levels, count(*) = count(DISTINCT (side, price)) AS unique_levels, bool_or(side = 'bid') AND bool_or(side = 'ask') AS both_sides, min(qty) > 0 AS positive, count(last_id) > 0 AS has_frontier FROM cp GROUP BY ALL"),
    "k2_eligible_checkpoints": (lambda s, d: B.eligible(checkpoints(s, d)).groupBy("market", "through_hour").agg(F.count("*").alias("levels")), f"WITH {CHECKPOINT} SELECT market, through_hour, count(*) AS levels FROM cp GROUP BY ALL HAVING bool_or(side = 'bid') AND bool_or(side = 'ask') AND min(qty) > 0 AND count(last_id) > 0 AND count(*) = count(DISTINCT (side, price))"),
    "k3_restored_replay": (lambda s, d: from_checkpoints(s, d)[0].drop("issue"), f"WITH {RESTORED} SELECT market, hour, n, t, kind, final_id, prev_id, complete, outcome, valid, was_valid, epoch, state FROM restored"),
    "k6_replay_from_checkpoints": (continued, f"WITH {RESTORED} SELECT market, through_hour, last_id, side, price, qty, place FROM cp WHERE through_hour % 3 <> 0 AND (market, through_hour) IN (SELECT DISTINCT market, hour FROM restored JOIN (SELECT market, hour, max(n) AS n FROM restored GROUP BY ALL) USING (market, hour, n) WHERE valid)"),
    "k5_checkpoint_plan": (
        checkpoint_plan,
        f"""WITH {CHECKPOINT}, h AS (SELECT DISTINCT market, hour FROM ev), c AS (SELECT DISTINCT market, through_hour AS c FROM cp WHERE through_hour % 3 = 0), src AS (SELECT * FROM h WHERE hour % 17 <> 0),
 a AS (SELECT t.market, t.hour, max(c) AS checkpoint FROM h t LEFT JOIN c ON c.market = t.market AND c < t.hour AND c >= t.hour - 6 GROUP BY ALL),
 b AS (SELECT market, hour, unnest(generate_series(hour - 6, hour - 1)) AS h FROM h), g AS (SELECT b.market, b.hour, max(b.h) AS gap FROM b ANTI JOIN src ON src.market = b.market AND src.hour = b.h GROUP BY ALL)
 SELECT market, hour, CASE WHEN ok THEN checkpoint END AS checkpoint, CASE WHEN ok THEN 'found' WHEN gap IS NOT NULL THEN 'source_gap' ELSE 'bound_reached' END AS stop, CASE WHEN ok THEN hour - checkpoint - 1 END AS replay_hours
 FROM (SELECT *, checkpoint IS NOT NULL AND (gap IS NULL OR gap <= checkpoint) AS ok FROM a LEFT JOIN g USING (market, hour))""",
    ),
}
