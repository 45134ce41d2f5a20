"""The hour catalog: availability, gaps, planned work, retention and consistency."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_grid(sources: DataFrame, by: str = "instrument") -> DataFrame:
    """Every hour from the first to the last known one, for every instrument."""
    span = sources.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("hour")).crossJoin(sources.select(by).distinct())


def availability(sources: DataFrame, outputs: DataFrame, full: int = 3600) -> DataFrame:
    """Status of each instrument's hour: analyzable, materialized, downloaded, missing or unknown."""
    rows = hour_grid(sources).join(sources, ["instrument", "hour"], "left").join(outputs, ["instrument", "hour"], "left")
    status = F.when(F.col("valid") >= full, "analyzable").when(F.col("valid").isNotNull(), "materialized").when(F.col("status").isin("downloaded", "processed"), "downloaded").when(F.col("status") == "missing", "missing").otherwise("unknown")
    return rows.select("instrument", "hour", status.alias("availability"), F.coalesce("valid", F.lit(0)).cast("long").alias("valid"))


STATES = ("analyzable", "materialized", "downloaded", "missing", "unknown")


def combined(available: DataFrame) -> DataFrame:
    """Status of an hour over all its instruments: the common one, or partial; analyzable only if all are. With
    the numbers of instruments in each state."""
    sets = available.groupBy("hour").agg(F.collect_set("availability").alias("s"), F.count("*").alias("markets"), *[F.count_if(F.col("availability") == x).alias(x) for x in STATES], F.min("valid").alias("least_valid"))
    return sets.select("hour", F.when(F.size("s") == 1, F.col("s")[0]).otherwise("partial").alias("status"), "markets", *STATES, "least_valid")


def json_count(column: str, path: str) -> Column:
    """A count from a JSON summary; 0 if it is absent, no number or negative."""
    value = F.expr(f"try_cast(get_json_object({column}, '{path}') AS BIGINT)")
    return F.when(value >= 0, value).otherwise(0)


def islands(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive hours."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("hour"))
    return hours.withColumn("island", F.col("hour") - number).groupBy(*keys, "island").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("hours")).drop("island")


def newest_window(hours: DataFrame, keys: list[str]) -> DataFrame:
    runs = islands(hours, keys)
    return runs.groupBy(*keys).agg(F.max_by(F.struct("first_hour", "last_hour", "hours"), "last_hour").alias("w")).select(*keys, "w.*")


def local_day(zone: str, day: str) -> tuple[int, int]:
    """UTC seconds [start, end) of whole hours that enclose a civil day of a time zone; a day whose midnight does
    not exist or comes twice is an error."""
    at, ends = ZoneInfo(zone), []
    for date in (datetime.fromisoformat(day), datetime.fromisoformat(day) + timedelta(days=1)):
        first, second = (date.replace(tzinfo=at, fold=x) for x in (0, 1))
        if first.utcoffset() != second.utcoffset() or first.astimezone(timezone.utc).astimezone(at).replace(tzinfo=None) != date:
            raise ValueError(f"{date} is not one time of {zone}")
        ends.append(int(first.timestamp()))
    return ends[0] // 3600 * 3600, -(-ends[1] // 3600) * 3600


def on_local_day(hours: DataFrame, seconds: str, zone: str, day: str) -> DataFrame:
    """Hours whose start (a column of seconds) falls on a civil day of a time zone: a plain range, which scans can skip by."""
    start, end = local_day(zone, day)
    return hours.where((F.col(seconds) >= start) & (F.col(seconds) < end))


def calendar(available: DataFrame, seconds: str, zone: str, day: str, lookback: int) -> DataFrame:
    """Per instrument: its hours on a civil day by state, and the newest run of analyzable hours among those of
    the day and of ``lookback`` hours before. ``seconds`` is the start of each hour."""
    start, end = local_day(zone, day)
    history = available.where((F.col(seconds) >= start - lookback * 3600) & (F.col(seconds) < end))
    today = history.where(F.col(seconds) >= start).groupBy("instrument").agg(F.count("*").alias("hours_of_day"), *[F.count_if(F.col("availability") == x).alias(x) for x in STATES])
    newest = newest_window(history.where("availability = 'analyzable'"), ["instrument"])
    return history.select("instrument").distinct().join(today, "instrument", "left").join(newest, "instrument", "left")


def planned(hours: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Expected sources: every hour for every row of a dimension table."""
    return hours.crossJoin(dimensions)


def targets(plan: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Planned hours to process: downloaded, or processed without a stored output."""
    known = plan.join(sources, ["instrument", "hour"])
    lost = known.where("status = 'processed'").join(outputs.select("instrument", "hour"), ["instrument", "hour"], "left_anti").withColumn("why", F.lit("output_missing"))
    return known.where("status = 'downloaded'").withColumn("why", F.lit("new")).union(lost).select("instrument", "hour", "why")


def in_processing_order(work: DataFrame) -> DataFrame:
    """Books first, then by venue, instrument and hour; ``place`` counts within a kind and venue, so that one
    venue's hours can be dealt to workers in order."""
    book = F.when(F.col("kind") == "orderbook", 0).otherwise(1)
    order = Window.partitionBy("kind", "venue").orderBy("instrument", "hour")
    return work.withColumn("place", F.row_number().over(order)).orderBy(book, "venue", "instrument", "hour")


def newest_release(now: Column, delay: int) -> Column:
    """The newest hour whose source is due by now (seconds)."""
    return F.floor((now - delay) / 3600).cast("long") * 3600 - 3600


def catch_up(sources: DataFrame, expected: int, newest: int, window: int, cursor: int | None = None) -> DataFrame:
    """The newest hour of the window that lacks a source; after a cursor the next older one, wrapping around."""
    complete = sources.where("status != 'missing'").groupBy("hour").agg(F.count_distinct("instrument").alias("have")).where(F.col("have") >= expected)
    grid = sources.sparkSession.range(newest - window + 1, newest + 1).select(F.col("id").alias("hour"))
    order = [F.desc(F.col("hour") < cursor), F.desc("hour")] if cursor is not None else [F.desc("hour")]
    return grid.join(complete, "hour", "left_anti").orderBy(*order).limit(1)


def complete_hours(sources: DataFrame, expected: int) -> DataFrame:
    return sources.where("status != 'missing'").groupBy("hour").agg(F.count_distinct("instrument").alias("have")).where(F.col("have") == expected).select("hour")


def retention(sources: DataFrame, outputs: DataFrame, cutoff: int) -> DataFrame:
    """Per instrument: what may be pruned (processed, stored and older than the cutoff), and what is held back and why."""
    rows = sources.join(outputs, ["instrument", "hour"], "left")
    reason = F.when(F.col("status") != "processed", "not_processed").when(F.col("hour") >= cutoff, "too_new").when(F.col("valid").isNull(), "output_missing").otherwise("prune")
    return rows.groupBy("instrument", reason.alias("decision")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def consistency(sources: DataFrame, books: DataFrame, prices: DataFrame, largest: int) -> DataFrame:
    """(problem, instrument, hour) rows. sources: instrument, hour, kind, status, meta (JSON), bytes; books and
    prices: stored hours (instrument, hour). Processed sources whose metadata have no digest or whose output is
    missing, outputs without a processed source, books without prices and the reverse, and oversized files."""
    key, processed = ["instrument", "hour"], sources.where("status = 'processed'")
    found = [processed.where(~F.coalesce(F.expr("try_parse_json(meta)").isNotNull() & F.get_json_object("meta", "$.content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(*key, F.lit("malformed_metadata").alias("problem"))]
    for kind, stored in (("orderbook", books), ("trades", prices)):
        mine, there = processed.where(F.col("kind") == kind).select(*key).distinct(), stored.select(*key).distinct()
        found.append(mine.join(there, key, "left_anti").withColumn("problem", F.lit(f"{kind}_output_missing")))
        found.append(there.join(mine, key, "left_anti").withColumn("problem", F.lit(f"{kind}_orphan_output")))
    found.append(books.select(*key).distinct().join(prices.select(*key), key, "left_anti").withColumn("problem", F.lit("book_without_price")))
    found.append(prices.select(*key).distinct().join(books.select(*key), key, "left_anti").withColumn("problem", F.lit("price_without_book")))
    found.append(sources.where(F.col("bytes") > largest).select(*key, F.lit("oversized").alias("problem")))
    return reduce(DataFrame.union, found)


def checkpoint_inventory(stored: DataFrame, state: DataFrame, expected: DataFrame, most_levels: int) -> DataFrame:
    """(market, through_hour, problem): checkpoints that no hour expects, hours without one, those whose book
    is not intact, and those of more than ``most_levels`` levels."""
    key = ["market", "through_hour"]
    have = stored.select(*key).distinct()
    intact = F.col("unique_levels") & F.col("both_sides") & F.col("positive") & F.col("has_frontier")
    found = [have.join(expected, key, "left_anti").withColumn("problem", F.lit("orphan")), expected.join(have, key, "left_anti").withColumn("problem", F.lit("missing"))]
    found.append(state.where(~intact).select(*key, F.lit("invalid").alias("problem")))
    found.append(state.where(F.col("levels") > most_levels).select(*key, F.lit("oversized").alias("problem")))
    return reduce(DataFrame.union, found)


def newest_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` newest runs that have ended (a top-k report), with their seconds."""
    ended = runs.where("ended IS NOT NULL").orderBy(F.desc("started"), F.desc("run_id")).limit(keep)
    return ended.withColumn("seconds", F.greatest(F.lit(0.0), (F.col("ended") - F.col("started")).cast("double")))


def inventory(tables: dict[str, DataFrame], counted: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(what, value, n): rows of each table, and rows by each value of a column."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(f"rows of {name}").alias("what"), F.lit("").alias("value"), "n") for name, df in tables.items()]
    rows += [df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "value", "n") for name, (df, c) in counted.items()]
    return reduce(DataFrame.union, rows)


def retained_sample(rows: DataFrame, section: str, order: list[str], keep: int) -> DataFrame:
    """The first rows of each section and how many were left out."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*order)))
    counts = rows.groupBy(section).agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("omitted"))
    return ranked.where(F.col("place") <= keep).join(counts, section)


def stale(rows: DataFrame, anchor: list[str], now: int, limit: int) -> DataFrame:
    """Rows whose first known anchor time is older than the limit."""
    at = F.coalesce(*anchor)
    return rows.where(at.isNotNull() & (F.lit(now) - at > limit)).withColumn("age", F.lit(now) - at)


def preferred(presets: DataFrame, base: str, created: str, name: str) -> DataFrame:
    return presets.groupBy(base).agg(F.max_by(name, created).alias(name))
