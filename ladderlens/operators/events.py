"""Event assembly, sequence checks and contract diagnostics over archive rows.

Windows are partitioned by market and archive hour; what crosses hours goes over one row per hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARCHIVE = ("market", "hour")


def in_archive(*order: str):
    return Window.partitionBy(*ARCHIVE).orderBy(*order)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of which there is one an event or more, for a join: both sides are dealt out by its keys. Left to sizes, such rows
    of a kept table go whole through the driver, as files are many times smaller than the rows that they hold."""
    return rows.hint("merge")


def group_events(rows: DataFrame, key: list[str], order: str = "row_index") -> DataFrame:
    """Number the runs of consecutive rows with equal keys (nulls are equal) as ``event_seq``."""
    w = in_archive(order)
    now, before = F.struct(*key), F.lag(F.struct(*key)).over(w)
    return rows.withColumn("new_event", (F.lag(order).over(w).isNull() | ~now.eqNullSafe(before)).cast("long")).withColumn("event_seq", F.sum("new_event").over(w)).drop("new_event")


def assembled(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per event: its key, rows, sides and changes in file order."""
    return group_events(rows, key).groupBy(*ARCHIVE, "event_seq", *key).agg(F.count("*").alias("n_rows"), F.count_if(F.col("side") == "bid").alias("bid_rows"), F.count_if(F.col("side") == "ask").alias("ask_rows"), F.array_sort(F.collect_list(F.struct("row_index", "side", "price", "qty"))).alias("changes"))


def duplicate_levels(rows: DataFrame, event: list[str]) -> DataFrame:
    return rows.groupBy(*event, "side", "price").agg(F.count("*").alias("copies")).where("copies > 1")


def oversized_events(rows: DataFrame, event: list[str], limit: int = 1_000_000) -> DataFrame:
    return rows.groupBy(*event).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > limit)


def with_previous(events: DataFrame, *columns: str, order: str = "n") -> DataFrame:
    """``previous_<column>`` of the event before: within the hour, or the last one of the adjacent hour before."""
    w = in_archive(order)
    last = events.groupBy(*ARCHIVE).agg(*[F.max_by(c, order).alias(f"last_{c}") for c in columns])
    over_hours = Window.partitionBy("market").orderBy("hour")
    last = last.select(*ARCHIVE, *[F.when(F.lag("hour").over(over_hours) == F.col("hour") - 1, F.lag(f"last_{c}").over(over_hours)).alias(f"carried_{c}") for c in columns])
    first = F.lag(order).over(w).isNull()
    joined = events.join(last, list(ARCHIVE))
    return joined.select(*events.columns, *[F.when(first, F.col(f"carried_{c}")).otherwise(F.lag(c).over(w)).alias(f"previous_{c}") for c in columns])


def clock_regressions(rows: DataFrame, keys: list[str], clocks: list[str], order: str, repeated: str | None = None) -> DataFrame:
    """Per key (an archive): rows whose clocks run back against the row before, each clock for itself, and
    adjacent rows that repeat an id."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = {f"{c}_regressions": F.col(c) < F.lag(c).over(w) for c in clocks} | ({"adjacent_duplicates": F.col(repeated) == F.lag(repeated).over(w)} if repeated else {})
    return rows.select(*keys, *[x.alias(n) for n, x in seen.items()]).groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_if(n).alias(n) for n in seen])


def continuity(events: DataFrame) -> DataFrame:
    """Adjacent updates within an hour whose predecessor is not the frontier before; a snapshot resets the chain."""
    w = in_archive("n")
    before = F.when(F.lag("kind").over(w) == "update", F.lag("final_id").over(w))
    checked = (F.col("kind") == "update") & before.isNotNull()
    return events.withColumns({"checked": checked, "mismatch": checked & (F.col("prev_id") != before), "frontier_regression": F.coalesce(F.col("final_id") < F.lag("final_id").over(w), F.lit(False))})


def read_report(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Per archive hour: rows, events by kind, clocks and continuity."""
    counted = rows.groupBy(*ARCHIVE).agg(F.count("*").alias("n_rows"))
    about = continuity(events).groupBy(*ARCHIVE).agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "update").alias("updates"), F.count_if(F.col("kind") == "snapshot").alias("snapshots"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if("checked").alias("checked"), F.count_if("mismatch").alias("mismatches"), F.count_if("frontier_regression").alias("regressions"))
    return counted.join(about, list(ARCHIVE))


def first_issues(events: DataFrame, keep: int = 100) -> DataFrame:
    issues = continuity(events).where("mismatch")
    return issues.withColumn("issue", F.row_number().over(in_archive("n"))).where(F.col("issue") <= keep).select(*ARCHIVE, "n", "prev_id", "issue")


def relation(now: str, before: str):
    """How an id relates to the one before."""
    d = F.col(now) - F.col(before)
    return F.when(d.isNull(), "uncheckable").when(d < 0, "regression").when(d == 0, "equal").when(d == 1, "increment_by_one").otherwise("forward_gap")


def update_relations(events: DataFrame) -> DataFrame:
    """Counts of id relations between neighbouring updates."""
    pairs = with_previous(events, "kind", "final_id").where("kind = 'update' AND previous_kind = 'update'")
    return pairs.groupBy("market", relation("final_id", "previous_final_id").alias("final_relation"), relation("prev_id", "previous_final_id").alias("predecessor_relation")).agg(F.count("*").alias("n"))


def snapshot_relations(events: DataFrame) -> DataFrame:
    """Relations between a snapshot and the update right after it."""
    pairs = with_previous(events, "kind", "final_id").where("kind = 'update' AND previous_kind = 'snapshot'")
    return pairs.groupBy("market", relation("prev_id", "previous_final_id").alias("predecessor_relation")).agg(F.count("*").alias("n"))


def hour_boundaries(events: DataFrame) -> DataFrame:
    """The last event of an hour against the first event and first update of the next."""
    ends = events.groupBy(*ARCHIVE).agg(F.max_by("final_id", "n").alias("last_id"), F.min_by("prev_id", "n").alias("first_prev"), F.min_by(F.when(F.col("kind") == "update", F.col("prev_id")), F.when(F.col("kind") == "update", F.col("n"))).alias("first_update_prev"))
    following = ends.select("market", (F.col("hour") - 1).alias("hour"), F.col("first_prev").alias("next_prev"), F.col("first_update_prev").alias("next_update_prev"))
    return ends.select(*ARCHIVE, "last_id").join(following, list(ARCHIVE)).withColumns({"event_relation": relation("next_prev", "last_id"), "update_relation": relation("next_update_prev", "last_id")})


def presence_patterns(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Counts of which columns are present together."""
    return rows.groupBy(*by, F.concat(*[F.when(F.col(c).isNull(), "-").otherwise("+") for c in columns]).alias("pattern")).agg(F.count("*").alias("n"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, share) in one pass."""
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["total"], columns, "column_name", "nulls").select("column_name", "nulls", F.round(F.try_divide(100.0 * F.col("nulls"), "total"), 6).alias("null_pct"))


def id_ranges(events: DataFrame) -> DataFrame:
    steps = with_previous(events, "final_id").withColumn("step", F.col("final_id") - F.col("previous_final_id"))
    return steps.groupBy("market").agg(F.count("*").alias("n"), F.min("final_id").alias("least"), F.max("final_id").alias("most"), F.min_by("final_id", "n").alias("first_id"), F.max_by("final_id", "n").alias("last_id"), F.count_if(F.col("step") == 1).alias("plus_one"), F.count_if(F.col("step") != 1).alias("other_steps"))


def id_steps(events: DataFrame) -> DataFrame:
    """How often each increment between neighbouring ids occurs."""
    steps = with_previous(events, "final_id").where("previous_final_id IS NOT NULL")
    return steps.groupBy("market", (F.col("final_id") - F.col("previous_final_id")).alias("step")).agg(F.count("*").alias("n"))


def predecessor_matches(events: DataFrame) -> DataFrame:
    pairs = with_previous(events, "final_id").where("previous_final_id IS NOT NULL")
    return pairs.groupBy("market", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("prev_id") == F.col("previous_final_id")).alias("matches"))


def event_shapes(rows: DataFrame, event: list[str]) -> DataFrame:
    """Per event: rows per side, positive, removing and malformed (null) quantities, levels that come more than
    once, and whether the event could be a complete snapshot."""
    levels = rows.groupBy(*event, "side", "price").agg(F.count("*").alias("n"), F.count_if(F.col("qty") > 0).alias("positive"), F.count_if(F.col("qty") == 0).alias("zero"), F.count_if(F.col("qty").isNull()).alias("malformed"))
    of = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0))
    return levels.groupBy(*event).agg(of("bid", "n").alias("bid_rows"), of("ask", "n").alias("ask_rows"), F.sum("positive").alias("positive_rows"), F.sum("zero").alias("zero_rows"), F.sum("malformed").alias("malformed_rows"), F.count_if(F.col("n") > 1).alias("repeated_levels"), ((of("bid", "positive") > 0) & (of("ask", "positive") > 0)).alias("complete"))


def ends(events: DataFrame, n: int = 5) -> DataFrame:
    """The first and last n events of each hour, and its first n of either kind."""
    ranked = events.withColumns({"from_start": F.row_number().over(in_archive("n")), "from_end": F.row_number().over(Window.partitionBy(*ARCHIVE).orderBy(F.desc("n"))), "of_kind": F.row_number().over(Window.partitionBy(*ARCHIVE, "kind").orderBy("n"))})
    return ranked.where((F.col("from_start") <= n) | (F.col("from_end") <= n) | (F.col("of_kind") <= n))


def kind_counts(rows: DataFrame) -> DataFrame:
    """Rows and logical events of each kind per hour."""
    events = rows.groupBy(*ARCHIVE, "kind", "n").agg(F.count("*").alias("r"))
    return events.groupBy(*ARCHIVE, "kind").agg(F.sum("r").alias("n_rows"), F.count("*").alias("n_events"))
