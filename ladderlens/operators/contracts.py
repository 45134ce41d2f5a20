"""Venue sequence contracts as rows of a small table, and event rules that depend on them.

A contract row has venue, needs_transaction_time, snapshot_takes_event_time (a snapshot without transaction
time takes its event time), frontier ('final' or 'last'), predecessor ('prev_final', 'final_minus_one' or
'last') and reset_sentinel; users add venues by adding rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "venue string, needs_transaction_time boolean, snapshot_takes_event_time boolean, frontier string, predecessor string, reset_sentinel long"
DEFAULT = [("binance", True, True, "final", "prev_final", None), ("bybit", False, False, "final", "final_minus_one", None), ("okx", False, False, "final", "last", -1)]


def contracts(spark: SparkSession, rows=DEFAULT) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def under_contract(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events (venue, kind, event_time, transaction_time, final_id, prev_final_id, last_id) with the
    projected ``frontier_id`` and ``predecessor_id`` and a ``contract_error``.

    Where the venue says so, a snapshot without transaction time takes its event time; the venue's reset
    sentinel in a snapshot stands for the final id; other negative ids are errors.
    """
    e = events.join(rules, "venue", "left")
    sentinel = (F.col("kind") == "snapshot") & (F.col("last_id") == F.col("reset_sentinel"))
    falls_back = F.col("snapshot_takes_event_time") & F.col("transaction_time").isNull() & (F.col("kind") == "snapshot")
    e = e.withColumns({"transaction_time": F.when(falls_back, F.col("event_time")).otherwise(F.col("transaction_time")), "sentinel": F.coalesce(sentinel, F.lit(False)), "last_id": F.when(sentinel, F.col("final_id")).otherwise(F.col("last_id"))})
    frontier = F.when(F.col("frontier") == "final", F.col("final_id")).otherwise(F.col("last_id"))
    predecessor = F.when(F.col("kind") == "snapshot", None).when(F.col("predecessor") == "prev_final", F.col("prev_final_id")).when(F.col("predecessor") == "final_minus_one", F.col("final_id") - 1).otherwise(F.col("last_id"))
    e = e.withColumns({"frontier_id": frontier, "predecessor_id": predecessor})
    error = F.when(F.col("frontier").isNull(), "unknown_venue").when(F.col("needs_transaction_time") & F.col("transaction_time").isNull(), "no_transaction_time").when(F.col("last_id") < 0, "negative_id").when(F.col("frontier_id").isNull(), "no_frontier").when((F.col("kind") == "update") & F.col("predecessor_id").isNull(), "no_predecessor")
    return e.withColumn("contract_error", error).drop("needs_transaction_time", "snapshot_takes_event_time", "frontier", "predecessor", "reset_sentinel")


def mixed_sentinels(rows: DataFrame, event: list[str], flag: str = "sentinel") -> DataFrame:
    """Events of which some rows carry the reset sentinel and others don't."""
    return rows.groupBy(*event).agg(F.count_if(flag).alias("sentinels"), F.count("*").alias("n_rows")).where("sentinels > 0 AND sentinels < n_rows")


def outside_hour(rows: DataFrame, clock: str, hour: int) -> DataFrame:
    """Rows per market and hour whose clock lies outside their archive hour."""
    return rows.groupBy("market", "hour").agg(F.count("*").alias("n_rows"), F.count_if(F.expr(f"{clock} div {hour}") != F.col("hour")).alias("outside"))


def violations(seconds: DataFrame, expected: int | None = None) -> DataFrame:
    """Counts of broken second invariants: valid ones carry values and no reason, invalid ones the reverse;
    values are not negative; where there is a source_count, it is all of ``expected`` for valid seconds, some for
    degraded and none for invalid ones."""
    ok, off = F.col("quality").isin("VALID", "DEGRADED"), F.col("quality") == "INVALID"
    rules = {"unknown_quality": ~ok & ~off, "valid_without_values": ok & (F.col("bid").isNull() | F.col("ask").isNull()), "valid_with_reason": ok & F.col("reason").isNotNull(), "invalid_with_values": off & (F.col("bid").isNotNull() | F.col("ask").isNotNull()), "invalid_without_reason": off & F.col("reason").isNull(), "negative_values": (F.col("bid") < 0) | (F.col("ask") < 0)}
    if expected is not None:
        n, full = F.col("source_count"), F.col("quality") == "VALID"
        rules["wrong_source_count"] = (full & (n != expected)) | (ok & ~full & ((n < 1) | (n >= expected))) | (off & (n != 0)) | n.isNull()
    return seconds.groupBy("market").agg(*[F.count_if(x).alias(name) for name, x in rules.items()])


def candle_violations(candles: DataFrame) -> DataFrame:
    """Counts of broken candle invariants: valid ones have prices in order and trades, others neither."""
    ok, prices = F.col("quality") == "VALID", ("open", "high", "low", "close")
    some, every = [F.col(x).isNotNull() for x in prices], [F.col(x).isNull() for x in prices]
    rules = {"valid_without_prices": ok & (every[0] | every[1] | every[2] | every[3]), "valid_without_trades": ok & (F.col("trades") < 1), "out_of_order": (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")), "not_positive": F.col("low") <= 0, "empty_with_prices": ~ok & (some[0] | some[1] | some[2] | some[3]), "empty_with_trades": ~ok & (F.col("trades") > 0)}
    return candles.groupBy("symbol").agg(*[F.count_if(x).alias(name) for name, x in rules.items()])


def clamped_clock(rows: DataFrame, clock: str, order: str) -> DataFrame:
    """The clock as a running maximum within the archive hour, and where it had run back."""
    running = F.max(clock).over(Window.partitionBy("market", "hour").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("clamped", running).withColumn("ran_back", F.col("clamped") > F.col(clock))
