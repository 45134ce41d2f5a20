"""Analysis requests: from closed instants to slots, bar lengths and buckets, with the reason where there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderlens.operators.bars import floor_to

#: Bar lengths that a view may have, in seconds.
VIEW_SECONDS = (1, 5, 15, 60, 300, 900, 3600, 14400, 86400)
MOST_BARS = 1200
#: Least and most seconds that a request's duration limit may have.
LIMITS = (3600, 63_072_000)


def request_slots(requests: DataFrame) -> DataFrame:
    """requests (start_us, end_us, most_seconds) with the half-open slots [start, end) of the whole seconds that
    both instants lie in, their number and ``problem``. Reversed instants are told before they are cut to seconds."""
    start, end = F.floor(F.col("start_us") / 1_000_000).cast("long"), F.floor(F.col("end_us") / 1_000_000).cast("long") + 1
    out = requests.withColumns({"start": start, "end": end}).withColumn("slots", F.col("end") - F.col("start"))
    problem = F.when(F.col("end_us") < F.col("start_us"), "reversed").when(~F.col("most_seconds").between(*LIMITS), "bad_limit").when(F.col("slots") > F.col("most_seconds"), "too_long")
    return out.withColumn("problem", problem)


def bar_count(start: Column, end: Column, bar: Column) -> Column:
    """Bars that [start, end) touches."""
    return (F.floor((end - 1) / bar) - F.floor(start / bar) + 1).cast("long")


def view_timeframe(ranges: DataFrame, most_bars: int = MOST_BARS, candidates: tuple[int, ...] = VIEW_SECONDS) -> DataFrame:
    """ranges (start, end, asked) with ``bar``: the asked length if it is one of the candidates and fits, without
    one the finest that fits; the number of bars, and ``problem`` where none does."""
    start, end = F.col("start"), F.col("end")
    fits = lambda x: bar_count(start, end, F.lit(x)) <= most_bars
    finest = F.coalesce(*[F.when(fits(x), F.lit(x)) for x in sorted(candidates)])
    known = F.col("asked").isin(*candidates)
    bar = F.when(F.col("asked").isNull(), finest).when(known & (bar_count(start, end, F.col("asked")) <= most_bars), F.col("asked"))
    problem = F.when(F.col("asked").isNotNull() & ~known, "unsupported").when(F.col("asked").isNotNull() & bar.isNull(), "too_many_bars").when(bar.isNull(), "range_too_long")
    return ranges.withColumns({"bar": bar.cast("long"), "problem": problem}).withColumn("bars", bar_count(start, end, F.col("bar")))


def finest(ranges: DataFrame, most_bars: int = MOST_BARS, candidates: tuple[int, ...] = VIEW_SECONDS) -> DataFrame:
    """ranges (start, end) with ``bar``: the finest length whose bars fit, else the coarsest."""
    count = lambda x: F.ceil((F.col("end") - F.col("start")) / x) <= most_bars
    return ranges.withColumn("bar", F.coalesce(*[F.when(count(x), F.lit(x)) for x in sorted(candidates)], F.lit(max(candidates))).cast("long"))


def snapped(ranges: DataFrame) -> DataFrame:
    """Closed ranges (first, last, bar) outward to whole bars [start, end)."""
    week = F.when(F.col("bar") % 604800 == 0, floor_to(F.col("first"), 604800)).otherwise(F.floor(F.col("first") / F.col("bar")) * F.col("bar"))
    last = F.when(F.col("bar") % 604800 == 0, floor_to(F.col("last"), 604800)).otherwise(F.floor(F.col("last") / F.col("bar")) * F.col("bar"))
    return ranges.withColumns({"start": week.cast("long"), "end": (last + F.col("bar")).cast("long")})


def aligned_buckets(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buckets, rejected) of ranges (start, end, bar): every bucket with its index, and ranges that are empty or
    begin or end within a bucket."""
    anchor = F.when(F.col("bar") % 604800 == 0, F.lit(4 * 86400)).otherwise(F.lit(0))
    problem = F.when(F.col("end") <= F.col("start"), "empty").when((F.col("start") - anchor) % F.col("bar") != 0, "partial_start").when((F.col("end") - anchor) % F.col("bar") != 0, "partial_end")
    marked = ranges.withColumn("problem", problem)
    good = marked.where("problem IS NULL").drop("problem")
    buckets = good.select("*", F.posexplode(F.expr("sequence(start, end - bar, bar)")).alias("index", "bucket_start")).withColumn("bucket_end", F.col("bucket_start") + F.col("bar"))
    return buckets, marked.where("problem IS NOT NULL")


def handed_off(ranges: DataFrame) -> DataFrame:
    """Closed ranges (start, end, most_seconds) of whole seconds, cut to the newest ones within the limit, and whether they were."""
    cut = F.col("end") - F.col("start") + 1 > F.col("most_seconds")
    return ranges.withColumns({"shortened": cut, "start": F.when(cut, F.col("end") - F.col("most_seconds") + 1).otherwise(F.col("start"))})
