"""Book state: level lifetimes, sampling, depth liquidity and checkpoints.

A level lives from the change that sets it to the next change of the same price in the same epoch, or
the epoch's end. Best prices and depth come from books that are kept while lifetimes stream by (``ladder``).
Where all levels of a sample are asked for, samples meet lifetimes by an equi-join on (market, block of
samples) with a range condition, so neither side is compared with the whole of the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.operators.events import dealt
from ladderlens.operators.ladder import STRUCTURES, from_units, sampled_books, units

#: Samples per join block, and per block that one task keeps a book for.
BLOCK, SWEPT = 64, 512
#: Bands up to which they are broadcast.
MOST_BANDS = 10_000
MONEY, FRACTION = "decimal(18,8)", "decimal(9,8)"


def valid_changes(changes: DataFrame, replayed: DataFrame) -> DataFrame:
    """Changes of applied events with their epoch; a snapshot starts its own."""
    applied = replayed.where("valid AND outcome IN ('SNAPSHOT_APPLIED', 'UPDATE_APPLIED')").select("market", "n", "epoch")
    return changes.join(dealt(applied), ["market", "n"])


def lifetimes(changes: DataFrame) -> DataFrame:
    """(market, epoch, side, price, qty, from_n, to_n, from_t, to_t): to_n and to_t are null while the level lives on."""
    w = Window.partitionBy("market", "epoch", "side", "price").orderBy("n")
    spans = changes.withColumns({"from_n": F.col("n"), "to_n": F.lead("n").over(w), "from_t": F.col("t"), "to_t": F.lead("t").over(w)})
    return spans.where("qty > 0").select("market", "epoch", "side", "price", "qty", "from_n", "to_n", "from_t", "to_t")


def change_counters(changes: DataFrame) -> DataFrame:
    """Level changes, removals asked for and levels really removed, per market."""
    w = Window.partitionBy("market", "epoch", "side", "price").orderBy("n")
    seen = changes.withColumn("before", F.lag("qty").over(w))
    return seen.groupBy("market").agg(F.count("*").alias("changes"), F.count_if(F.col("qty") == 0).alias("zero_changes"), F.count_if((F.col("qty") == 0) & (F.col("before") > 0)).alias("removed"))


def slot_of(t: str | Column, interval: int) -> Column:
    """The sampling slot of a time: an event at a slot's end belongs to that slot."""
    return F.floor(((F.col(t) if isinstance(t, str) else t) - 1) / interval).cast("long")


GRID = 4096
_LAST = ("n", "epoch", "valid", "state")


def _at_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the last event as ``s``, and the last id that any of its events has as ``id``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*_LAST), "n").alias("s"), F.max_by("final_id", F.when(F.col("final_id").isNotNull(), F.col("n"))).alias("id"))


def samples(replayed: DataFrame, interval: int) -> DataFrame:
    """(market, slot, t_end, n, epoch, valid, state, last_id): the last event at or before each slot's end, on a dense grid
    from each market's first slot to its last; last_id is a valid book's frontier."""
    last = _at_ends(replayed.withColumn("slot", slot_of("t", interval)), ["market", "slot"])
    # groups of slots are dealt out first, so no task lays out a market's whole history
    reach = last.groupBy("market").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    groups = reach.select("market", "a", "b", F.explode(F.expr(f"sequence(a div {GRID}, b div {GRID})")).alias("group")).repartition("market", "group")
    grid = groups.select("market", "group", F.explode(F.sequence(F.greatest("a", F.col("group") * GRID), F.least("b", F.col("group") * GRID + (GRID - 1)))).alias("slot"))
    # an empty slot takes the state of the last one with an event, found within groups of slots and then across them
    filled = grid.join(last.withColumn("group", F.expr(f"slot div {GRID}")), ["market", "group", "slot"], "left")
    inside = Window.partitionBy("market", "group").orderBy("slot")
    ends = filled.groupBy("market", "group").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("slot"))).alias(x) for x in ("s", "id")])
    before = Window.partitionBy("market").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("market", "group", *[F.last(x, ignorenulls=True).over(before).alias(f"carried_{x}") for x in ("s", "id")])
    out = filled.join(carried, ["market", "group"]).select("market", "slot", *[F.coalesce(F.last(x, ignorenulls=True).over(inside), f"carried_{x}").alias(x) for x in ("s", "id")])
    return out.select("market", "slot", ((F.col("slot") + 1) * interval).alias("t_end"), "s.*", F.when(F.col("s.valid"), F.col("id")).alias("last_id"))


def hour_samples(replayed: DataFrame, interval: int, hour: int) -> DataFrame:
    """(market, hour, slot, t_end, n, epoch, valid, state, last_id): every slot of every archive hour that there is. An hour
    begins with the book of the hour right before (CARRIED if it is valid), after a missing hour with none; an
    event belongs to the slot that ends with its time or after, one at the hour's very start to the first."""
    start, per_hour = F.col("hour") * hour, hour // interval
    own = F.greatest(F.lit(0), F.floor((F.col("t") - start - 1) / interval)).cast("long")
    last = _at_ends(replayed.withColumn("slot", own), ["market", "hour", "slot"])
    over = Window.partitionBy("market").orderBy("hour")
    ends = _at_ends(replayed, ["market", "hour"])
    follows = F.lag("hour").over(over) == F.col("hour") - 1
    begins = ends.select("market", "hour", F.when(follows, F.lag("s").over(over)).alias("b"), F.when(follows, F.lag("id").over(over)).alias("b_id"))
    carried = F.struct(F.col("b.n").alias("n"), F.col("b.epoch").alias("epoch"), F.coalesce("b.valid", F.lit(False)).alias("valid"), F.when(F.col("b.valid"), "CARRIED").otherwise(F.coalesce("b.state", F.lit("UNINITIALIZED"))).alias("state"))
    grid = begins.select("market", "hour", carried.alias("b"), "b_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_hour - 1).cast("long"))).alias("slot"))
    inside = Window.partitionBy("market", "hour").orderBy("slot")
    out = grid.join(last, ["market", "hour", "slot"], "left").withColumns({"s": F.coalesce(F.last("s", ignorenulls=True).over(inside), "b"), "id": F.coalesce(F.last("id", ignorenulls=True).over(inside), "b_id")})
    return out.select("market", "hour", "slot", (start + (F.col("slot") + 1) * interval).alias("t_end"), "s.*", F.when(F.col("s.valid"), F.col("id")).alias("last_id"))


def alive(sampled: DataFrame, levels: DataFrame, slot: Callable[[str], Column], size: int) -> DataFrame:
    """Levels with the slots a to b that they live through, in every ``block`` of ``size`` slots between the first and
    last valid sample of their epoch; a level that changes within its slot is in none."""
    reach = sampled.where("valid").groupBy("market", "epoch").agg(F.max("slot").alias("last_slot"), F.min("slot").alias("first_slot"))
    spans = levels.withColumns({"a": slot("from_t"), "b": slot("to_t") - 1}).where("b IS NULL OR b >= a")
    spans = spans.join(reach, ["market", "epoch"]).withColumns({"a": F.greatest("a", "first_slot"), "b": F.least(F.coalesce("b", "last_slot"), "last_slot")}).where("b >= a")
    return spans.select("market", "epoch", "side", "price", "qty", "a", "b", F.explode(F.expr(f"sequence(a div {size}, b div {size})")).alias("block"))


def meeting(sampled: DataFrame, levels: DataFrame, slot: Callable[[str], Column]) -> DataFrame:
    """Valid samples with the levels alive at them; ``slot`` gives the slot of a time column."""
    s = sampled.where("valid").withColumn("block", F.expr(f"slot div {BLOCK}"))
    return s.join(alive(sampled, levels, slot, BLOCK), ["market", "epoch", "block"]).where("slot BETWEEN a AND b").drop("block", "a", "b")


def swept(sampled: DataFrame, levels: DataFrame, slot: Callable[[str], Column], bands: DataFrame | None = None) -> DataFrame:
    """(market, slot, best_bid, best_ask, bid_levels, ask_levels, bands) of every valid sample, from books that are
    kept over blocks of SWEPT slots. Prices and quantities have at most 8 decimals."""
    shares = [(r["band"], r["lower"], r["upper"]) for r in _shares(bands).select("band", units("lower").alias("lower"), units("upper").alias("upper")).toLocalIterator()] if bands is not None else []
    own = ["market", "epoch", "block"]
    move = lambda at, what, qty: F.struct(at.alias("slot"), F.lit(what).alias("what"), qty.alias("qty"))
    begins, ends = move(F.greatest("a", F.col("block") * SWEPT), 1, units("qty")), move(F.col("b") + 1, 0, F.lit(0).cast("long"))
    last = (F.col("b") + 1) < (F.col("block") + 1) * SWEPT  # else the block ends first
    moves = alive(sampled, levels, slot, SWEPT).where("price IS NOT NULL").select(*own, (F.col("side") == "bid").alias("is_bid"), units("price").alias("price"), F.explode(F.when(last, F.array(begins, ends)).otherwise(F.array(begins))).alias("m"))
    moves = moves.select(*own, "m.slot", "m.what", "is_bid", "price", "m.qty")
    none = F.lit(None).cast("long")
    asked = sampled.where("valid").select("market", "epoch", F.expr(f"slot div {SWEPT}").alias("block"), "slot", F.lit(2).alias("what"), F.lit(None).cast("boolean").alias("is_bid"), none.alias("price"), none.alias("qty"))
    kind = levels.schema["price"].dataType.simpleString()
    return sampled_books(moves.union(asked), shares).withColumns({x: from_units(x, kind) for x in ("best_bid", "best_ask")})


def quantity_at(met: DataFrame, prices: DataFrame) -> DataFrame:
    """The quantity at each asked (side, price) of every sample that has it."""
    return met.join(prices, ["side", "price"]).select("market", "slot", "side", "price", "qty")


def price_range(met: DataFrame, low, high) -> DataFrame:
    """Levels and their quantity per sample and side within [low, high]."""
    inside = met.where(F.col("price").between(low, high))
    return inside.groupBy("market", "slot", "side").agg(F.count("*").alias("levels"), F.sum("qty").alias("qty"))


def structure(bid: str = "best_bid", ask: str = "best_ask"):
    b, a = F.col(bid), F.col(ask)
    return F.when(b.isNull() & a.isNull(), "EMPTY_BOTH").when(b.isNull(), "EMPTY_BID").when(a.isNull(), "EMPTY_ASK").when(b < a, "NORMAL").when(b == a, "LOCKED").otherwise("CROSSED")


def best_prices(sampled: DataFrame, levels: DataFrame, slot: Callable[[str], Column]) -> DataFrame:
    """Every sample with its best prices, level counts, structure, quality and reason."""
    return judged(sampled.join(swept(sampled, levels, slot).drop("bands"), ["market", "slot"], "left"))


def judged(topped: DataFrame) -> DataFrame:
    """Samples (valid, state, best_bid, best_ask, bid_levels, ask_levels) with structure, quality and reason:
    only a NORMAL book is VALID, and a book that isn't valid was never there or was invalidated."""
    out = topped.withColumn("structure", F.when(F.col("valid"), structure()))
    reason = F.when(~F.col("valid"), F.when(F.col("state") == "INVALIDATED", "replay_invalidated").otherwise("uninitialized")).when(F.col("structure") != "NORMAL", F.lower("structure"))
    return out.withColumns({"bid_levels": F.coalesce("bid_levels", F.lit(0)), "ask_levels": F.coalesce("ask_levels", F.lit(0)), "quality": F.when(F.col("structure") == "NORMAL", "VALID").otherwise("INVALID"), "reason": reason})


def _shares(bands: DataFrame) -> DataFrame:
    share = bands.select("band", F.col("lower").cast(FRACTION).alias("lower"), F.col("upper").cast(FRACTION).alias("upper"))
    if share.where("NOT coalesce(0 <= lower AND lower <= upper AND upper < 1, false)").count():
        raise ValueError("a band needs 0 <= lower <= upper < 1")
    return share


def intervals(bands: DataFrame, best: DataFrame) -> DataFrame:
    """best (best_bid, best_ask) with every band's (band, lower, upper) price bounds, exact: bids in
    [best (1 - upper), best (1 - lower)], asks in [best (1 + lower), best (1 + upper)], both ends included."""
    share = _shares(bands)
    if bands.count() <= MOST_BANDS:
        share = F.broadcast(share)
    one, bid, ask = F.lit(1).cast(FRACTION), F.col("best_bid").cast(MONEY), F.col("best_ask").cast(MONEY)
    bounds = {"bid_low": bid * (one - F.col("upper")).cast(FRACTION), "bid_high": bid * (one - F.col("lower")).cast(FRACTION), "ask_low": ask * (one + F.col("lower")).cast(FRACTION), "ask_high": ask * (one + F.col("upper")).cast(FRACTION)}
    return best.crossJoin(share).withColumns(bounds).drop("lower", "upper")


def _liquid(tops: DataFrame) -> DataFrame:
    """One row a band of ``tops``, with the total and the imbalance, which is null where there is nothing."""
    total = (F.col("bid") + F.col("ask")).cast("decimal(38,16)")
    return tops.withColumns({"total": total, "imbalance": F.try_divide((F.col("bid") - F.col("ask")).cast("double"), total.cast("double"))})


def depth(sampled: DataFrame, levels: DataFrame, bands: DataFrame, slot: Callable[[str], Column]) -> DataFrame:
    """Liquidity of each valid sample with a NORMAL book in each band: the exact notional of the levels within
    its bounds (see ``intervals``), per side, their numbers, the total and the imbalance."""
    return _liquid(swept(sampled, levels, slot, bands).select("market", "slot", F.inline("bands")))


def liquidity_hours(sampled: DataFrame, levels: DataFrame, bands: DataFrame, slot: Callable[[str], Column]) -> DataFrame:
    """Every sample in every band: values and source_count 1 where the book is NORMAL, else a reason."""
    names = F.array(*[F.lit(r["band"]) for r in bands.select("band").toLocalIterator()])
    none = F.transform(names, lambda b: F.struct(b.alias("band"), *[F.lit(None).cast(t).alias(x) for x, t in (("bid", "decimal(38,16)"), ("ask", "decimal(38,16)"), ("bid_levels", "long"), ("ask_levels", "long"))]))
    tops = judged(sampled.join(swept(sampled, levels, slot, bands), ["market", "slot"], "left"))
    every = tops.select("market", "slot", "quality", "reason", F.inline(F.when(F.col("quality") == "VALID", F.col("bands")).otherwise(none)))
    return _liquid(every).withColumn("source_count", F.when(F.col("quality") == "VALID", 1).otherwise(0))


def sample_counts(topped: DataFrame, per_hour: int) -> DataFrame:
    """Per market and hour of ``per_hour`` slots: slots by quality, and whether all of the hour is valid."""
    hours = topped.groupBy("market", F.expr(f"slot div {per_hour}").alias("hour")).agg(F.count("*").alias("slots"), *[F.count_if(F.col("quality") == x).alias(x.lower()) for x in ("VALID", "DEGRADED", "INVALID")])
    return hours.withColumn("fully_valid", F.col("valid") == per_hour)


def quality_summary(liquid: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: slots by quality, the numbers of each reason as a map, and valid slots without any liquidity."""
    counts = liquid.groupBy(*keys, "reason").agg(F.count("*").alias("slots"), *[F.count_if(F.col("quality") == x).alias(x.lower()) for x in ("VALID", "DEGRADED", "INVALID")], F.count_if(F.col("total") == 0).alias("zero_total"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "slots")))))
    return counts.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("slots", "valid", "degraded", "invalid", "zero_total")], reasons.alias("reasons"))


def checkpoints(replayed: DataFrame, levels: DataFrame, hour: Callable[[str], Column]) -> DataFrame:
    """All levels alive at each valid hour end: bids from the best down, asks from the best up (``place``)."""
    ends = replayed.groupBy("market", "hour").agg(F.max_by(F.struct("n", "epoch", "valid"), "n").alias("s"), F.max_by("final_id", F.when(F.col("final_id").isNotNull(), F.col("n"))).alias("last_id")).selectExpr("market", "hour", "hour AS slot", "s.n", "s.epoch", "s.valid", "last_id")
    alive = meeting(ends, levels, hour)
    key = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return alive.withColumn("place", F.row_number().over(Window.partitionBy("market", "hour", "side").orderBy(key))).select("market", F.col("hour").alias("through_hour"), "last_id", "side", "price", "qty", "place")


def checkpoint_state(stored: DataFrame) -> DataFrame:
    """Integrity and eligibility per checkpoint: unique levels, both sides, positive values."""
    sides = [F.count_if(F.col("side") == x) > 0 for x in ("bid", "ask")]
    unique = F.count("*") == F.count_distinct("side", "price")
    return stored.groupBy("market", "through_hour").agg(F.count("*").alias("levels"), unique.alias("unique_levels"), (sides[0] & sides[1]).alias("both_sides"), (F.min("qty") > 0).alias("positive"), F.first("last_id").isNotNull().alias("has_frontier"))


def eligible(stored: DataFrame) -> DataFrame:
    """Checkpoints that a replay may begin with: intact, both sides there, the frontier known."""
    ok = checkpoint_state(stored).where("unique_levels AND both_sides AND positive AND has_frontier")
    return stored.join(ok.select("market", "through_hour"), ["market", "through_hour"], "left_semi")


def checkpoint_plan(targets: DataFrame, checkpoints: DataFrame, sources: DataFrame, bound: int = 168) -> DataFrame:
    """For each target (market, hour): the nearest checkpoint at most ``bound`` hours back with every hour
    between present in ``sources`` (market, hour), and why the search stopped. The last checkpoint and the
    last gap before an hour are found by a running maximum over one row an hour."""
    marks = targets.select("market", "hour", F.lit(True).alias("target"), F.lit(False).alias("c"), F.lit(False).alias("there"))
    marks = marks.union(checkpoints.select("market", F.col("through_hour"), F.lit(False), F.lit(True), F.lit(False))).union(sources.select("market", "hour", F.lit(False), F.lit(False), F.lit(True)))
    hours = marks.groupBy("market", "hour").agg(*[F.max(x).alias(x) for x in ("target", "c", "there")])
    before = Window.partitionBy("market").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag("hour").over(Window.partitionBy("market").orderBy("hour"))
    # a gap is an hour without a source, listed or not: the hour before one whose predecessor in the list is further back
    hours = hours.withColumn("missing", F.when(~F.col("there"), F.col("hour"))).withColumn("skipped", F.when(previous < F.col("hour") - 1, F.col("hour") - 1))
    hours = hours.withColumns({"checkpoint": F.last(F.when(F.col("c"), F.col("hour")), ignorenulls=True).over(before), "gap": F.greatest(F.last("missing", ignorenulls=True).over(before), F.last("skipped", ignorenulls=True).over(before), "skipped"), "first": F.min("hour").over(Window.partitionBy("market"))})
    plan = hours.where("target").withColumns({"checkpoint": F.when(F.col("checkpoint") >= F.col("hour") - bound, F.col("checkpoint")), "gap": F.coalesce("gap", F.col("first") - 1)})
    plan = plan.withColumn("gap", F.when(F.col("gap") >= F.col("hour") - bound, F.col("gap")))
    found = F.col("checkpoint").isNotNull() & (F.col("gap").isNull() | (F.col("gap") <= F.col("checkpoint")))
    return plan.select("market", "hour", F.when(found, F.col("checkpoint")).alias("checkpoint"), F.when(found, "found").when(F.col("gap").isNotNull(), "source_gap").otherwise("bound_reached").alias("stop"), F.when(found, F.col("hour") - F.col("checkpoint") - 1).alias("replay_hours"))
