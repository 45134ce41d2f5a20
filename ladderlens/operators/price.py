"""Exact trade prices: normalisation, dedup, one-slot OHLC and dense slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 8


def strict_decimal(text: str, positive: bool) -> tuple:
    """(value, problem) of decimal text: finite, at most DIGITS fractional digits, positive or not negative."""
    value = F.expr(f"try_cast({text} AS DECIMAL(18,{DIGITS}))")
    plain = F.col(text).rlike(rf"^\s*[+-]?\d+(\.\d{{0,{DIGITS}}}0*)?\s*$")
    low = value <= 0 if positive else value < 0
    return value, F.when(F.col(text).isNull(), "null").when(value.isNull() | ~plain, "not_decimal").when(low, "out_of_range")


def strict(rows: DataFrame, problem: str = "problem") -> DataFrame:
    """rows without ``problem``; a row that has one fails the job with it."""
    checked = F.when(F.col(problem).isNotNull(), F.raise_error(F.concat(F.lit("rejected row: "), F.col(problem)))).otherwise(F.lit(True))
    return rows.where(checked).drop(problem)


def judged_trades(trades: DataFrame, symbol: Column | None = None, zero_price: Column | None = None) -> DataFrame:
    """Trades with text prices and quantities, normalised, and their first ``problem``. ``symbol`` is the expected
    one of each row. Where ``zero_price`` holds, a price of zero, whatever the quantity, is the venue's mark for
    no price, told as ``zero_price`` only after the whole row was validated; elsewhere prices and quantities
    must be positive."""
    special = F.lit(True) if zero_price is None else zero_price
    price, price_problem = strict_decimal("price", False)
    qty, qty_problem = strict_decimal("qty", False)
    name = F.upper(F.trim("symbol"))
    id_problem = F.when(F.col("trade_id").isNull() | (F.trim("trade_id") == ""), "blank_id")
    other = F.when(F.col("symbol").isNull() | (name == ""), "blank_symbol") if symbol is None else F.when(~F.coalesce(name == symbol, F.lit(False)), "other_symbol")
    clock_problem = F.when(F.col("trade_ms").isNull() | (F.col("trade_ms") < 0), "bad_clock")
    zero = F.when((price == 0) & special, "zero_price").when(price == 0, "out_of_range").when(qty == 0, "zero_quantity")
    return trades.withColumns({"symbol": name, "trade_id": F.trim("trade_id"), "problem": F.coalesce(id_problem, other, clock_problem, price_problem, qty_problem, zero)}).withColumns({"price": price, "qty": qty})


def normalised(trades: DataFrame, symbol: Column | None = None, zero_price: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) trades; see ``judged_trades``. The rejected ones keep their text."""
    judged = judged_trades(trades.withColumns({"raw_price": F.col("price"), "raw_qty": F.col("qty")}), symbol, zero_price)
    rejected = judged.where("problem IS NOT NULL").withColumns({"price": F.col("raw_price"), "qty": F.col("raw_qty")})
    return judged.where("problem IS NULL").drop("problem", "raw_price", "raw_qty"), rejected.drop("raw_price", "raw_qty")


def judged_book(rows: DataFrame, symbol: Column, ids: tuple[str, ...]) -> DataFrame:
    """Level changes with text sides, kinds, prices and quantities, normalised, and their first ``problem``: enums
    are lower-cased, ids and clocks are whole and not negative (a null id is no problem here), prices positive,
    quantities not negative."""
    price, price_problem = strict_decimal("price", True)
    qty, qty_problem = strict_decimal("quantity", False)
    side, kind, name = F.lower(F.trim("side")), F.lower(F.trim("event_type")), F.upper(F.trim("symbol"))
    enums = F.coalesce(F.when(~F.coalesce(name == symbol, F.lit(False)), "other_symbol"), F.when(~F.coalesce(kind.isin("snapshot", "update"), F.lit(False)), "bad_event_type"), F.when(~F.coalesce(side.isin("bid", "ask"), F.lit(False)), "bad_side"))
    clocks = [F.when(F.col(c).isNull() | (F.col(c) < 0), f"bad_{c}") for c in ("received_time", "event_time")]
    negative = [F.when(F.col(c) < 0, f"negative_{c}") for c in ids]
    return rows.withColumns({"symbol": name, "event_type": kind, "side": side, "problem": F.coalesce(enums, *clocks, *negative, price_problem, qty_problem)}).withColumns({"price": price, "quantity": qty})


def deduplicated(trades: DataFrame) -> DataFrame:
    """One row per symbol and trade id, the first by ordinal; ``conflict`` if copies differ in content."""
    content = F.struct("trade_ms", "price", "qty")
    return trades.groupBy("symbol", "trade_id").agg(F.min_by(F.struct("trade_ms", "price", "qty", "ordinal"), "ordinal").alias("t"), F.count("*").alias("copies"), (F.min(content) != F.max(content)).alias("conflict")).select("symbol", "trade_id", "t.*", "copies", "conflict")


def ohlc(trades: DataFrame, slot_ms: int, price: str = "price", clock: str = "trade_ms") -> DataFrame:
    """Open, high, low, close and count per symbol and half-open slot: by clock, then ordinal."""
    order = F.struct(clock, "ordinal")
    return trades.withColumn("slot", F.expr(f"{clock} div {slot_ms}")).groupBy("symbol", "slot").agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("trades"))


def dense(candles: DataFrame, slots_per_hour: int) -> DataFrame:
    """Every slot of every hour that has a candle; those without one say NO_TRADES."""
    hours = candles.select("symbol", F.expr(f"slot div {slots_per_hour}").alias("hour")).distinct()
    grid = hours.select("symbol", "hour", F.explode(F.expr(f"sequence(hour * {slots_per_hour}, (hour + 1) * {slots_per_hour} - 1)")).alias("slot"))
    return grid.join(candles, ["symbol", "slot"], "left").withColumns({"trades": F.coalesce("trades", F.lit(0)), "quality": F.when(F.col("open").isNull(), "NO_TRADES").otherwise("VALID")})


def price_summary(slots: DataFrame) -> DataFrame:
    return slots.groupBy("symbol", "hour").agg(F.count("*").alias("slots"), F.count_if(F.col("quality") == "VALID").alias("valid"), F.count_if(F.col("quality") == "NO_TRADES").alias("no_trades"), F.sum("trades").alias("trades"))


def routed(trades: DataFrame, hour_ms: int, received: str = "received_ns") -> DataFrame:
    """Counters per target hour (by trade time): trades of the archives of the hour and of its neighbours (by
    receipt) are taken, others are outside; copies of a trade are duplicates; symbols that an archive of
    another symbol holds and receipts that run back within an archive are counted as well."""
    rows = trades.withColumns({"archive_hour": F.expr(f"{received} div 1000000 div {hour_ms}"), "hour": F.expr(f"trade_ms div {hour_ms}")})
    archive = Window.partitionBy("symbol", "archive_hour").orderBy("ordinal")
    rows = rows.withColumns({"near": F.abs(F.col("archive_hour") - F.col("hour")) <= 1, "back": F.coalesce(F.col(received) < F.lag(received).over(archive), F.lit(False))})
    once = rows.groupBy("symbol", "hour", "trade_id").agg(F.count("*").alias("n"), F.count_if("near").alias("near"), F.count_if(F.col("near") & (F.col("archive_hour") != F.col("hour"))).alias("neighbours"), F.count_if("back").alias("back"))
    return once.groupBy("symbol", "hour").agg(F.sum("n").alias("input"), F.count_if(F.col("near") > 0).alias("accepted"), F.sum(F.greatest(F.col("near") - 1, F.lit(0))).alias("duplicates"), F.sum(F.col("n") - F.col("near")).alias("outside"), F.sum("neighbours").alias("from_neighbours"), F.sum("back").alias("receipts_back"))


def mixed_archives(trades: DataFrame, hour_ms: int, received: str = "received_ns") -> DataFrame:
    """Archives (by venue and hour of receipt) that hold more than one symbol."""
    rows = trades.groupBy("venue", F.expr(f"{received} div 1000000 div {hour_ms}").alias("archive_hour")).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return rows.where(F.size("symbols") > 1)
