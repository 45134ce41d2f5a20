"""Time buckets, bars, market sums, outages and derived bar metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed bar lengths in seconds; weeks begin on Monday.
TIMEFRAMES = {"1s": 1, "5s": 5, "10s": 10, "15s": 15, "30s": 30, "1m": 60, "3m": 180, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800}
MONDAY = 4 * 86400  # 1970-01-05
CHANNELS = {"bid": "bid", "ask": "ask", "total": "bid + ask", "delta": "bid - ask"}


def floor_to(ts: str | Column, seconds: int) -> Column:
    anchor = MONDAY if seconds % 604800 == 0 else 0
    t = F.col(ts) if isinstance(ts, str) else ts
    return (F.floor((t - anchor) / seconds) * seconds + anchor).cast("long")


def market_sum(seconds: DataFrame, expected: int, series: list[str] | None = None, grid: DataFrame | None = None) -> DataFrame:
    """One row per second over markets: sums of the valid ones, VALID if all expected ones contribute,
    DEGRADED if some do, else INVALID; and who contributed what. With a ``grid`` (ts and the series), there
    is a row for each of its seconds, silent ones included, and for no others."""
    ok, keys = F.col("quality") == "VALID", [*(series or []), "ts"]
    parts = F.array_sort(F.collect_list(F.when(ok, F.struct("market", "bid", "ask"))))
    sums = seconds.groupBy(*keys).agg(F.sum(F.when(ok, F.col("bid"))).alias("bid"), F.sum(F.when(ok, F.col("ask"))).alias("ask"), F.count_if(ok).alias("source_count"), parts.alias("contributions"))
    if grid is not None:
        sums = grid.join(sums, keys, "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    quality = F.when(F.col("source_count") >= expected, "VALID").when(F.col("source_count") > 0, "DEGRADED").otherwise("INVALID")
    imbalance = F.round(F.try_divide((F.col("bid") - F.col("ask")).cast("double"), (F.col("bid") + F.col("ask")).cast("double")), 9)
    text = F.coalesce(F.array_join(F.transform("contributions", lambda x: x["market"].cast("string")), ","), F.lit(""))
    return sums.withColumns({"quality": quality, "imbalance": imbalance, "contributors": text})


def uncovered(seconds: DataFrame, expected: DataFrame) -> DataFrame:
    """Markets present but not expected, or expected but absent."""
    have = seconds.select("market").distinct()
    return have.exceptAll(expected).withColumn("problem", F.lit("unexpected")).union(expected.exceptAll(have).withColumn("problem", F.lit("absent")))


def repeated_seconds(seconds: DataFrame, series: list[str]) -> DataFrame:
    return seconds.groupBy(*series, "ts").agg(F.count("*").alias("copies")).where("copies > 1")


def _candle(value: Column, usable: Column, ts: Column) -> Column:
    at, v = F.when(usable, ts), F.when(usable, value)
    return F.struct(F.min_by(v, at).alias("o"), F.max(v).alias("h"), F.min(v).alias("l"), F.max_by(v, at).alias("c"))


def liquidity_bars(seconds: DataFrame, series: list[str], bar: int, step: int = 1) -> DataFrame:
    """Bars that end in the state of their last second: VALID or DEGRADED if that second is usable, else
    INVALID; OHLC of bid, ask, total and delta from usable seconds; coverage, the longest run of unusable
    slots and whether any slot is missing. Slots are ``step`` seconds long."""
    usable = F.col("quality").isin("VALID", "DEGRADED")
    rows = seconds.withColumns({"bar_start": floor_to("ts", bar), "usable": usable})
    before = F.last(F.when(F.col("usable"), F.col("ts")), ignorenulls=True).over(Window.partitionBy(*series, "bar_start").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.when(F.col("usable"), F.expr("ts") - F.coalesce(before, F.col("bar_start") - step) - step))
    channels = [_candle(F.expr(e), F.col("usable"), F.col("ts")).alias(c) for c, e in CHANNELS.items()]
    bars = rows.groupBy(*series, "bar_start").agg(*channels, F.max("gap").alias("gap"), F.max(F.when(F.col("usable"), F.col("ts"))).alias("last_usable"), F.max("ts").alias("last_ts"), F.max_by("quality", "ts").alias("last_quality"), F.count("*").alias("observed"), F.count_if("usable").alias("valid"), F.bool_or(F.col("quality") == "DEGRADED").alias("degraded"))
    end = F.col("bar_start") + bar
    tail = F.coalesce(end - F.col("last_usable") - step, F.lit(bar))
    last = F.when(F.col("last_ts") == end - step, F.col("last_quality"))
    return bars.select(*series, "bar_start", *CHANNELS, F.when(last == "VALID", F.when(F.col("degraded"), "DEGRADED").otherwise("VALID")).when(last == "DEGRADED", "DEGRADED").otherwise("INVALID").alias("quality"), F.lit(bar // step).alias("expected"), "observed", "valid", (F.col("observed") - F.col("valid")).alias("invalid"), (F.lit(bar // step) - F.col("observed")).alias("missing"), (F.greatest(F.coalesce("gap", F.lit(0)), tail) / step).cast("long").alias("longest_gap"), (F.col("observed") < bar // step).alias("discontinuity"), "degraded")


def bar_balance(bars: DataFrame) -> DataFrame:
    """bars with total, delta and imbalance at their ends; the imbalance is null where there is no liquidity."""
    bid, ask = F.col("bid.c").cast("double"), F.col("ask.c").cast("double")
    return bars.withColumns({"end_total": bid + ask, "end_delta": bid - ask, "imbalance": F.try_divide(bid - ask, bid + ask)})


def price_bars(candles: DataFrame, series: list[str], bar: int, ts: str = "ts") -> DataFrame:
    """First open, highest high, lowest low, last close and all trades of the candles; those of another quality
    than VALID, if it is given, only count as seconds."""
    ok = F.col("quality") == "VALID" if "quality" in candles.columns else F.lit(True)
    of = lambda c: F.when(ok, F.col(c))
    return candles.withColumn("bar_start", floor_to(ts, bar)).groupBy(*series, "bar_start").agg(F.min_by(of("open"), of(ts)).alias("open"), F.max(of("high")).alias("high"), F.min(of("low")).alias("low"), F.max_by(of("close"), of(ts)).alias("close"), F.sum(of("trades")).alias("trades"), F.count("*").alias("seconds"), F.count_if(ok).alias("valid"))


def view_bars(seconds: DataFrame, start: int, end: int, bar: int, step: int = 1, price: DataFrame | None = None) -> DataFrame:
    """Every bar of [start, end), clipped at its edges, with OHLC of all channels and of the bid share in
    percent; the share is null for the whole bar if any usable second has no liquidity. ``price`` (ts, open,
    high, low, close), where there is one, adds its own candle and never decides which seconds count."""
    always, inside = F.lit(True), (F.col("ts") >= start) & (F.col("ts") < end)
    rows = seconds.where(inside & F.col("quality").isin("VALID", "DEGRADED")).withColumn("bar_start", floor_to("ts", bar))
    share = F.try_divide(100 * F.col("bid").cast("double"), (F.col("bid") + F.col("ask")).cast("double"))
    sums = rows.groupBy("bar_start").agg(*[_candle(F.expr(e).cast("double"), always, F.col("ts")).alias(c) for c, e in CHANNELS.items()], _candle(share, always, F.col("ts")).alias("share"), F.bool_or(F.expr("bid + ask = 0")).alias("no_share"), F.count("*").alias("valid"))
    spark = seconds.sparkSession
    first = spark.range(1).select(floor_to(F.lit(start), bar).alias("a"), floor_to(F.lit(end - 1), bar).alias("b"))
    grid = first.select(F.explode(F.expr(f"sequence(a, b, {bar}L)")).alias("bar_start"))
    owned = ((F.least(F.col("bar_start") + bar, F.lit(end)) - F.greatest("bar_start", F.lit(start))) / step).cast("long")
    out = grid.join(sums, "bar_start", "left").withColumn("share", F.when(~F.col("no_share"), F.col("share"))).drop("no_share")
    if price is not None:
        of = lambda c: F.col(c).cast("double")
        priced = price.where(inside).groupBy(floor_to("ts", bar).alias("bar_start")).agg(F.struct(F.min_by(of("open"), "ts").alias("o"), F.max(of("high")).alias("h"), F.min(of("low")).alias("l"), F.max_by(of("close"), "ts").alias("c")).alias("price"))
        out = out.join(priced, "bar_start", "left")
    return out.withColumns({"valid": F.coalesce("valid", F.lit(0)), "source_seconds": owned, "midpoint_us": ((F.greatest("bar_start", F.lit(start)) + F.least(F.col("bar_start") + bar, F.lit(end))) * 500_000).cast("long")})


def coarsened(bars: DataFrame, bar: int) -> DataFrame:
    """View bars of a longer, nesting length; equal to building them from the seconds."""
    at = F.col("bar_start")

    def merged(c: str) -> Column:
        seen = F.when(F.col(c).isNotNull(), at)
        return F.struct(F.min_by(F.col(c)["o"], seen).alias("o"), F.max(F.col(c)["h"]).alias("h"), F.min(F.col(c)["l"]).alias("l"), F.max_by(F.col(c)["c"], seen).alias("c"))

    lacking = F.bool_or((F.col("valid") > 0) & F.col("share").isNull())
    price = [merged("price").alias("price")] if "price" in bars.columns else []
    return bars.groupBy(floor_to("bar_start", bar).alias("bar_start")).agg(*[merged(c).alias(c) for c in CHANNELS], F.when(~lacking, merged("share")).alias("share"), *price, F.sum("valid").alias("valid"), F.sum("source_seconds").alias("source_seconds"))


def whole_seconds(summed: DataFrame) -> DataFrame:
    """Seconds that give no warning: usable ones to which all expected markets contribute."""
    return summed.where("quality = 'VALID'")


def outages(usable: DataFrame, expected: DataFrame, start: int, end: int, threshold: int, step: int = 1, keep: int = 5000) -> DataFrame:
    """[gap_start, gap_end) runs without a usable second strictly longer than ``threshold``, from the gaps
    between usable seconds and the range's edges; the first ``keep`` of a series and whether there are more.
    ``expected`` names the series: one without any usable second is out for the whole range."""
    series = expected.columns
    inside = usable.where((F.col("ts") >= start) & (F.col("ts") < end)).select(*series, "ts").withColumn("day", F.expr("ts div 86400"))
    # neighbours within a day; days are joined over one row each
    w = Window.partitionBy(*series, "day").orderBy("ts")
    days = inside.groupBy(*series, "day").agg(F.min("ts").alias("first_ts"))
    over = Window.partitionBy(*series).orderBy("day")
    following = days.select(*series, "day", F.coalesce(F.lead("first_ts").over(over), F.lit(end)).alias("next_first"))
    gaps = inside.join(following, [*series, "day"]).select(*series, (F.col("ts") + step).alias("gap_start"), F.coalesce(F.lead("ts").over(w), "next_first").alias("gap_end"))
    first = days.groupBy(*series).agg(F.min("first_ts").alias("gap_end"))
    edge = expected.distinct().join(first, series, "left").select(*series, F.lit(start).cast("long").alias("gap_start"), F.coalesce("gap_end", F.lit(end)).cast("long").alias("gap_end"))
    long = gaps.union(edge).where(F.col("gap_end") - F.col("gap_start") > threshold)
    ranked = long.withColumns({"number": F.row_number().over(Window.partitionBy(*series).orderBy("gap_start")), "truncated": F.count("*").over(Window.partitionBy(*series)) > keep})
    return ranked.where(F.col("number") <= keep)


def load_counters(seconds: DataFrame, price: DataFrame, corrupt: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Usable, unusable and partial seconds, how many have a price, and the price's status; liquidity never
    depends on price. ``corrupt`` marks price rows whose content is not what was stored, ``failed`` rows that stand
    for a price that could not be read or decoded (they have no value); the first kind that there is, in the
    order corrupt, failed, loaded, missing, is the status."""
    no = F.lit(False)
    bad, lost = (F.coalesce(x, no) if x is not None else no for x in (corrupt, failed))
    both = seconds.join(price.select("ts", bad.alias("bad"), lost.alias("lost"), (~lost).alias("priced")), "ts", "left")
    any_of = lambda c: F.coalesce(F.bool_or(c), no)
    status = F.when(any_of("bad"), "corrupt").when(any_of("lost"), "failed").when(F.count_if("priced") > 0, "loaded").otherwise("missing")
    return both.agg(F.count_if(F.col("quality") != "INVALID").alias("usable"), F.count_if(F.col("quality") == "INVALID").alias("unusable"), F.count_if(F.col("quality") == "DEGRADED").alias("partial"), F.count_if("priced").alias("priced"), F.count_if("lost").alias("failed"), status.alias("price_status"))


def trusted_prices(price: DataFrame, keys: list[str], corrupt: Column) -> DataFrame:
    """Prices of each key before its first corrupt second; none after it is used."""
    first = price.where(corrupt).groupBy(*keys).agg(F.min("ts").alias("bad"))
    return price.join(first, keys, "left").where(F.col("bad").isNull() | (F.col("ts") < F.col("bad"))).drop("bad")


def price_outages(price: DataFrame, keys: list[str], corrupt: Column, start: int, end: int, threshold: int, step: int = 1) -> DataFrame:
    """Outages of the keys' prices; a key with a corrupt second in the range has none, as they can't be told."""
    inside = price.where((F.col("ts") >= start) & (F.col("ts") < end))
    bad = inside.where(corrupt).select(*keys).distinct()
    sound = price.select(*keys).distinct().join(bad, keys, "left_anti")
    return outages(inside.join(sound, keys, "left_semi"), sound, start, end, threshold, step)


def component_coverage(seconds: DataFrame, expected: DataFrame, hour: int, step: int = 1) -> DataFrame:
    """Valid and unusable seconds and the numbers of each reason per expected market and hour, missing hours included."""
    at = F.expr(f"ts div {hour}").alias("hour")
    by_reason = seconds.groupBy("market", at, "reason").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == "VALID").alias("valid"))
    named = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    have = by_reason.groupBy("market", "hour").agg(F.sum("valid").alias("valid"), F.map_from_entries(F.array_sort(F.collect_list(named))).alias("reasons"))
    out = seconds.select(at).distinct().join(expected, how="cross").join(have, ["market", "hour"], "left")
    return out.select("market", "hour", F.coalesce("valid", F.lit(0)).alias("valid"), (F.lit(hour // step) - F.coalesce("valid", F.lit(0))).alias("unusable"), "reasons", F.col("valid").isNull().alias("missing_hour"))


#: Change metrics by name; b, a: this bar's closes, b0, a0: the previous bar's.
CHANGES: dict[str, str] = {
    "total_change": "(b + a) - (b0 + a0)",
    "total_change_pct": "try_divide(100 * ((b + a) - (b0 + a0)), b0 + a0)",
    "delta_change": "(b - a) - (b0 - a0)",
    "imbalance_change": "2 * (try_divide(100 * b, b + a) - try_divide(100 * b0, b0 + a0))",
    "relative_side_change": "100 * (try_divide(b, b0) - try_divide(a, a0))",
}


def metrics(bars: DataFrame, series: list[str] | None = None, group: int = 86400 * 32) -> DataFrame:
    """All selectable metrics of view bars: candles from the bar's own channels, and changes against the
    bar right before where both are valid. Neighbours are found within long groups of bars and over one
    row per group."""
    keys = series or []
    rows = bars.select(*keys, "bar_start", "valid", F.expr("bid.c").alias("b"), F.expr("ask.c").alias("a"), "share", "delta", "total").withColumn("g", F.expr(f"bar_start div {group}"))
    state = F.struct("b", "a", "valid")
    ends = rows.groupBy(*keys, "g").agg(F.max_by(state, "bar_start").alias("e"))
    over = Window.partitionBy(*keys).orderBy("g") if keys else Window.orderBy("g")
    ends = ends.select(*keys, "g", F.lag("e").over(over).alias("carried"))
    previous = F.coalesce(F.lag(state).over(Window.partitionBy(*keys, "g").orderBy("bar_start")), "carried")
    rows = rows.join(ends, [*keys, "g"]).withColumn("p", previous)
    rows = rows.withColumns({"b0": F.when(F.col("p.valid") > 0, F.col("p.b")), "a0": F.when(F.col("p.valid") > 0, F.col("p.a"))})
    signed = {x: F.expr(f"2 * share.{x} - 100") for x in "ohlc"}
    asks = {"o": F.expr("100 - share.o"), "h": F.expr("100 - share.l"), "l": F.expr("100 - share.h"), "c": F.expr("100 - share.c")}
    return rows.select(*keys, "bar_start", *[F.expr(f"{c}.{x}").alias(f"{n}_{x}") for n, c in (("delta", "delta"), ("total", "total"), ("bid_share", "share")) for x in "ohlc"], *[v.alias(f"imbalance_{k}") for k, v in signed.items()], *[v.alias(f"ask_share_{k}") for k, v in asks.items()], *[F.expr(e).alias(n) for n, e in CHANGES.items()])
