"""Robust statistics: median, scale, extremeness score and duration summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAD_TO_SIGMA, MEAN_AD_TO_SIGMA = 0.6744897501960817, 1.2533141373155003
HALF_POINT, LEAST_BARS = 3.5, 20
#: Buckets that the values of a key are dealt out to.
BUCKETS = 64


def _bucketed(values: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values (keys, value, ties) with their bucket, and per bucket how many values it holds, how many are in lower
    ones (``before``) and how many the key has (``total``). Buckets lie between approximate quantiles of a key's
    distinct values, so none holds much more than its share; nothing but bucket rows meets by key alone."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    splits = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 100 * BUCKETS).alias("splits"))
    dealt = counts.join(splits, keys).withColumn("bucket", F.size(F.filter("splits", lambda s: s <= F.col(value)))).drop("splits")
    w = Window.partitionBy(*keys)
    held = dealt.groupBy(*keys, "bucket").agg(F.sum("ties").alias("held"))
    before = F.coalesce(F.sum("held").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt, held.withColumns({"before": before, "total": F.sum("held").over(w)})


def _below(keys: list[str], value: str):
    """How many values of the key are smaller, for rows with ``before`` and ``ties`` of the buckets."""
    w = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("before") + F.coalesce(F.sum("ties").over(w), F.lit(0))


def medians(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n): the exact median by selection. Bucket counts tell which bucket holds it (of an even number
    of values, which hold the middle two), and only those buckets' values are put in order."""
    dealt, held = _bucketed(values, keys, value)
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    there = lambda rank, at, n: (F.col(at) <= rank) & (rank < F.col(at) + F.col(n))
    middle = held.where(there(low, "before", "held") | there(high, "before", "held"))
    ranked = dealt.join(middle, [*keys, "bucket"]).withColumn("below", _below(keys, value))
    halves = [0.5 * F.max(F.when(there(rank, "below", "ties"), F.col(value).cast("double"))) for rank in (low, high)]
    return ranked.groupBy(*keys).agg((halves[0] + halves[1]).alias("median"), F.first("total").alias("n"))


def robust_scale(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: exact median, and its scale: MAD, else the mean absolute deviation, else ZERO."""
    away = values.join(medians(values, keys, value), keys).select(*keys, "median", "n", F.abs(F.col(value) - F.col("median")).alias("d")).where("d IS NOT NULL")
    mean = away.groupBy(*keys, "median", "n").agg(F.avg("d").alias("mean_ad"))
    scales = mean.join(medians(away, keys, "d").select(*keys, F.col("median").alias("mad")), keys).select(*keys, "median", "n", "mad", "mean_ad")
    return scales.withColumn("scale_kind", F.when(F.col("mad") > 0, "MAD").when(F.col("mean_ad") > 0, "MEAN_AD").otherwise("ZERO"))


def tail_fractions(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per distinct value: the share of the other values above and below it, ties counting half; values are counted
    within buckets, and over buckets."""
    dealt, held = _bucketed(values, keys, value)
    ranked = dealt.join(held, [*keys, "bucket"]).withColumn("below", _below(keys, value))
    others = F.col("total") - 1
    half = (F.col("ties") - 1) / 2
    return ranked.select(*keys, value, F.try_divide(F.col("below") + half, others).alias("lower_tail"), F.try_divide(F.col("total") - F.col("below") - F.col("ties") + half, others).alias("upper_tail"))


def extremeness(bars: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Score of 0 to 100 per bar of a scan: how far and how rarely its value lies from the median, on
    either side; none with fewer than LEAST_BARS values or without any spread."""
    scored = bars.join(robust_scale(bars, keys, value), keys, "left").join(tail_fractions(bars, keys, value), [*keys, value], "left")
    d = F.col(value) - F.col("median")
    z = F.when(F.col("scale_kind") == "MAD", MAD_TO_SIGMA * d / F.col("mad")).when(F.col("scale_kind") == "MEAN_AD", d / (MEAN_AD_TO_SIGMA * F.col("mean_ad")))

    def side(z, tail):
        rare = F.greatest(1 - tail, F.lit(0.0))
        return F.when(z > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.sqrt(rare * z / (z + HALF_POINT))))).otherwise(0.0)

    enough = (F.col("n") >= LEAST_BARS) & (F.col("scale_kind") != "ZERO") & F.col(value).isNotNull()
    scored = scored.withColumns({"high": F.when(enough, side(z, F.col("upper_tail"))), "low": F.when(enough, side(-z, F.col("lower_tail")))})
    name = F.when((F.col("high") == 0) & (F.col("low") == 0), None).when(F.col("high") > F.col("low"), "BID_DOMINANT").when(F.col("high") < F.col("low"), "ASK_DOMINANT").when(F.col("high").isNotNull(), "BOTH")
    return scored.select(*keys, order, value, F.greatest("high", "low").alias("score"), name.alias("dominance"))


def duration_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, most, mean, median and 95th percentile (interpolated), to 6 digits."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95"))
