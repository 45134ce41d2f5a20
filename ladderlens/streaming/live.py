"""Structured Streaming forms of the trade and market operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType


def deduplicated(trades: DataFrame, key: list[str], clock: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each trade once, as long as its copies come within the watermark's delay."""
    return trades.withWatermark(clock, delay).dropDuplicatesWithinWatermark(key)


def trade_ohlc(trades: DataFrame, length: str, keys: list[str], clock: str = "ts", order: str = "ordinal", delay: str = "15 minutes") -> DataFrame:
    """Open, high, low, close and count in tumbling windows; later than the watermark is dropped."""
    at = F.struct(clock, order)
    return trades.withWatermark(clock, delay).groupBy(F.window(clock, length), *keys).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("trades"))


def market_sums(seconds: DataFrame, length: str, expected: int, clock: str = "ts", delay: str = "15 minutes") -> DataFrame:
    """Sums of the ``valid`` amounts over markets per window, and how many of the expected ones contributed."""
    ok = F.col("valid")
    sums = seconds.withWatermark(clock, delay).groupBy(F.window(clock, length)).agg(F.sum(F.when(ok, F.col("amount"))).alias("amount"), F.size(F.collect_set(F.when(ok, F.col("market")))).alias("markets"))
    return sums.withColumn("quality", F.when(F.col("markets") >= expected, "VALID").when(F.col("markets") > 0, "DEGRADED").otherwise("INVALID"))


def dropped(progress: list) -> list[tuple[int, int, int]]:
    """(batch, rows read, rows that stateful operators dropped as later than the watermark) of a query's progress."""
    return [(p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])) for p in progress if p["numInputRows"]]


def late_rows(stream: DataFrame, folder: str, key: list[str], clock: str = "ts", delay: str = "15 minutes", feeds: Sequence[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """(batch, n_rows, late, kept) per micro-batch of a stream whose rows are kept once per key: rows read, rows that the
    watermark dropped, as Spark counted them, and rows kept."""
    spark, counts = stream.sparkSession, []
    base = f"{folder}/late-{uuid.uuid4().hex}"
    rows = deduplicated(stream, key, clock, delay).select(*key)
    for query in _runs(rows, base, "append", feeds):
        counts += dropped(query.recentProgress)
    told = spark.createDataFrame(counts, "batch long, n_rows long, late long")
    kept = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out/*").groupBy("batch").agg(F.count("*").alias("kept"))
    return told.join(kept, "batch", "left").select("batch", "n_rows", "late", F.coalesce("kept", F.lit(0)).alias("kept"))


def _runs(stream: DataFrame, base: str, mode: str, feeds: Sequence[Callable[[], None]]) -> Iterator[StreamingQuery]:
    """Run a stream over all that is available after each feed, from where the run before ended, keeping each
    batch's rows. A batch that is retried writes the same folder again."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/number={number}")

    for feed in feeds:
        feed()
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
        yield query


def drained(stream: DataFrame, folder: str, keys: list[str], mode: str = "update", feeds: Sequence[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """Run a stream over all that is available after each of ``feeds``, and read the last state per key."""
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    for _ in _runs(stream, base, mode, feeds):
        pass
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{base}/out/*")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*") if values else rows.select(*keys).distinct()
