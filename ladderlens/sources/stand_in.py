"""Domain tables derived from the driver's star-schema tables, and the same as DuckDB CTEs.

Level changes come from ``lineitem`` (an event is a market and ship date), trades and one-hour
liquidity from ``events``, and the hour catalog from ``orders``. Every operator takes its interval as a
parameter; on these tables blocks of 30 days stand for archive hours and days for seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderlens.operators.events import dealt
from ladderlens.plans.staging import kept

HOUR = 30 * 86400
SNAPSHOT_EVERY, BREAK_EVERY = 30, 37


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "l_extendedprice / l_quantity"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 3 AS market", "unix_seconds(CAST(l_shipdate AS TIMESTAMP)) AS t", f"CASE WHEN {r} < 2100 THEN 'bid' ELSE 'ask' END AS side",
        f"CAST(greatest(50, floor({r} / 50) * 50) AS BIGINT) AS price", "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS BIGINT) AS qty",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank",
    )


RAW_LEVELS = """raw AS (SELECT l_suppkey % 3 AS market, CAST(epoch(l_shipdate) AS BIGINT) AS t,
 CASE WHEN l_extendedprice / l_quantity < 2100 THEN 'bid' ELSE 'ask' END AS side,
 CAST(greatest(50, floor(l_extendedprice / l_quantity / 50) * 50) AS BIGINT) AS price,
 CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS BIGINT) AS qty,
 struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS rank FROM lineitem)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per event, side and price."""
    return raw_levels(spark, sf_dir).groupBy("market", "t", "side", "price").agg(F.max_by("qty", "rank").alias("qty"))


LEVELS = RAW_LEVELS + ", levels AS (SELECT market, t, side, price, arg_max(qty, rank) AS qty FROM raw GROUP BY ALL)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes with their archive hour and event number: counted within the hour and moved on by the
    hours before, of which one row each is summed. The archive is read once, for the levels."""
    levels_ = kept(levels(spark, sf_dir)).withColumn("hour", F.expr(f"t div {HOUR}"))
    rows = levels_.withColumn("n", F.dense_rank().over(Window.partitionBy("market", "hour").orderBy("t")).cast("long"))
    before = Window.partitionBy("market").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = levels_.groupBy("market", "hour").agg(F.count_distinct("t").alias("events")).select("market", "hour", F.coalesce(F.sum("events").over(before), F.lit(0)).alias("before"))
    return rows.join(hours, ["market", "hour"]).withColumn("n", F.col("n") + F.col("before")).drop("before")


def _as_event(columns: str) -> list[str]:
    """An event's kind and sequence ids, which break now and then, from its number."""
    return [*columns.split(), f"CASE WHEN n % {SNAPSHOT_EVERY} = 0 THEN 'snapshot' ELSE 'update' END AS kind", "n AS final_id", f"CASE WHEN n % {BREAK_EVERY} = 0 THEN n - 2 ELSE n - 1 END AS prev_id"]


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, hour, n, t, kind, final_id, prev_id): numbered events."""
    events = _numbered(spark, sf_dir).groupBy("market", "hour", "n").agg(F.first("t").alias("t"))
    return events.selectExpr(*_as_event("market hour n t"))


def events_of(changes: DataFrame) -> DataFrame:
    """``book_events`` of ``changes``, without reading the archive again."""
    return changes.select("market", "hour", "n", "t", "kind", "final_id", "prev_id").distinct()


EVENTS = LEVELS + f""", ev AS (SELECT market, t // {HOUR} AS hour, n, t, CASE WHEN n % {SNAPSHOT_EVERY} = 0 THEN 'snapshot' ELSE 'update' END AS kind,
 n AS final_id, CASE WHEN n % {BREAK_EVERY} = 0 THEN n - 2 ELSE n - 1 END AS prev_id
 FROM (SELECT market, t, row_number() OVER (PARTITION BY market ORDER BY t) AS n FROM (SELECT DISTINCT market, t FROM levels)))"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes with their event's columns and their place in the archive hour."""
    place = F.row_number().over(Window.partitionBy("market", "hour").orderBy("t", "side", "price")).cast("long")
    return _numbered(spark, sf_dir).selectExpr(*_as_event("market hour n t side price qty")).withColumn("row_index", place)


CHANGES = EVENTS + ", changes AS (SELECT *, row_number() OVER (PARTITION BY market, hour ORDER BY t, side, price) AS row_index FROM levels JOIN ev USING (market, t))"


def replay_events(events: DataFrame) -> DataFrame:
    """Events for every outcome of a replay: snapshots without an id, ids that run back, updates that come
    twice with equal or other content (``other``), and hours that are missing. ``base`` is the number before."""
    one = events.where("(hour + market) % 11 <> 0").selectExpr("market", "hour", "2 * n AS n", "t", "kind", "CASE WHEN kind = 'snapshot' AND n % 60 = 0 THEN NULL WHEN n % 53 = 0 THEN n - 5 ELSE n END AS final_id", "prev_id", "n AS base", "false AS other")
    again = one.where("kind = 'update' AND base % 7 = 0").selectExpr("market", "hour", "n + 1 AS n", "t", "kind", "final_id", "prev_id", "base", "base % 13 = 0 AS other")
    return one.union(again)


REPLAY_EVENTS = """r1 AS (SELECT market, hour, 2 * n AS n, t, kind, CASE WHEN kind = 'snapshot' AND n % 60 = 0 THEN NULL WHEN n % 53 = 0 THEN n - 5 ELSE n END AS final_id, prev_id, n AS base, false AS other FROM ev WHERE (hour + market) % 11 <> 0),
 rich AS (SELECT * FROM r1 UNION ALL SELECT market, hour, n + 1, t, kind, final_id, prev_id, base, base % 13 = 0 FROM r1 WHERE kind = 'update' AND base % 7 = 0),
 marks0 AS (SELECT market, n AS base, bool_or(side = 'bid' AND qty > 0) AND bool_or(side = 'ask' AND qty > 0) AS complete FROM changes GROUP BY ALL),
 rich_marks AS (SELECT market, n, complete, base || CASE WHEN other THEN 'x' ELSE '' END AS signature FROM rich JOIN marks0 USING (market, base))"""


def replay_marks(rich: DataFrame, marks: DataFrame) -> DataFrame:
    """Signature and completeness of ``replay_events`` from those of the events that they are made of."""
    of = rich.select("market", "n", "base", "other").join(dealt(marks.withColumnRenamed("n", "base")), ["market", "base"])
    return of.select("market", "n", F.when(F.col("other"), F.concat("signature", F.lit("x"))).otherwise(F.col("signature")).alias("signature"), "complete")


def replay_changes(rich: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes of ``replay_events``; a copy with other content has other quantities."""
    of = rich.select("market", "hour", "n", "t", "base", "other").join(dealt(changes.select("market", F.col("n").alias("base"), "side", "price", "qty", "row_index")), ["market", "base"])
    return of.withColumn("qty", F.col("qty") + F.when(F.col("other") & (F.col("qty") > 0), 1).otherwise(0)).drop("base", "other")


RICH_CHANGES = "rich_changes AS (SELECT x.market, x.hour, x.n, x.t, c.side, c.price, c.qty + CASE WHEN x.other AND c.qty > 0 THEN 1 ELSE 0 END AS qty FROM rich x JOIN changes c ON c.market = x.market AND c.n = x.base)"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, trade_id, ordinal, trade_ms, received_ns, price, qty); every 50th trade comes twice."""
    one = table(spark, sf_dir, "events").selectExpr(
        "event_type AS symbol", "event_id AS trade_id", "event_id AS ordinal", "unix_millis(CAST(ts AS TIMESTAMP)) AS trade_ms",
        "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS received_ns", "CAST(value AS DECIMAL(18,8)) AS price", "CAST(get_json_object(props, '$.k') AS BIGINT) + 1 AS qty",
    )
    again = one.where("trade_id % 50 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    return one.union(again)


TRADES = """one AS (SELECT event_type AS symbol, event_id AS trade_id, event_id AS ordinal, epoch_us(ts) // 1000 AS trade_ms, epoch_us(ts) * 1000 AS received_ns,
 CAST(value AS DECIMAL(18,8)) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS qty FROM events),
 trades AS (SELECT * FROM one UNION ALL SELECT * REPLACE (ordinal + 1000000000 AS ordinal) FROM one WHERE trade_id % 50 = 0)"""


def market_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, ts, bid, ask, quality, reason): one row per market and hour that has any event; an hour
    with one side only is invalid and carries no values."""
    sums = table(spark, sf_dir, "events").selectExpr("user_id % 3 AS market", "unix_seconds(CAST(ts AS TIMESTAMP)) div 3600 * 3600 AS ts", "event_type IN ('view', 'click') AS is_bid", "CAST(round(value * 100) AS BIGINT) AS v")
    sums = sums.groupBy("market", "ts").agg(F.sum(F.expr("CASE WHEN is_bid THEN v END")).alias("b"), F.sum(F.expr("CASE WHEN NOT is_bid THEN v END")).alias("a"))
    return sums.selectExpr("market", "ts", "CASE WHEN a IS NOT NULL THEN b END AS bid", "CASE WHEN b IS NOT NULL THEN a END AS ask", "CASE WHEN a IS NULL OR b IS NULL THEN 'INVALID' ELSE 'VALID' END AS quality", "CASE WHEN b IS NULL THEN 'empty_bid' WHEN a IS NULL THEN 'empty_ask' END AS reason")


SECONDS = """sums AS (SELECT user_id % 3 AS market, epoch_us(ts) // 1000000 // 3600 * 3600 AS ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS b,
 CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type NOT IN ('view', 'click')) AS BIGINT) AS a FROM events GROUP BY ALL),
 seconds AS (SELECT market, ts, CASE WHEN a IS NOT NULL THEN b END AS bid, CASE WHEN b IS NOT NULL THEN a END AS ask,
 CASE WHEN a IS NULL OR b IS NULL THEN 'INVALID' ELSE 'VALID' END AS quality, CASE WHEN b IS NULL THEN 'empty_bid' WHEN a IS NULL THEN 'empty_ask' END AS reason FROM sums)"""


def source_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, hour, status, bytes): the newest order of each instrument and day."""
    newest = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey % 8").alias("instrument"), F.expr("unix_seconds(CAST(o_orderdate AS TIMESTAMP)) div 86400").alias("hour")).agg(F.max_by(F.struct("o_orderstatus", "o_totalprice", "o_orderkey"), "o_orderkey").alias("o"))
    return newest.selectExpr("instrument", "hour", "CASE o.o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'downloaded' ELSE 'missing' END AS status", "CAST(round(o.o_totalprice * 100) AS BIGINT) AS bytes", "o.o_orderkey AS source_id")


SOURCE_HOURS = """src AS (SELECT instrument, hour, CASE o.s WHEN 'F' THEN 'processed' WHEN 'O' THEN 'downloaded' ELSE 'missing' END AS status,
 CAST(round(o.p * 100) AS BIGINT) AS bytes, o.k AS source_id FROM (SELECT o_custkey % 8 AS instrument, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS hour,
 arg_max(struct_pack(s := o_orderstatus, p := o_totalprice, k := o_orderkey), o_orderkey) AS o FROM orders GROUP BY ALL))"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, hour, valid): stored hours; every line of status F stands for valid seconds."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").selectExpr("l_suppkey % 8 AS instrument", "unix_seconds(CAST(l_shipdate AS TIMESTAMP)) div 86400 AS hour", "l_quantity")
    return lines.groupBy("instrument", "hour").agg(F.least(F.lit(3600), F.sum(F.col("l_quantity").cast("long")) * 60).alias("valid"))


OUTPUTS = """outp AS (SELECT l_suppkey % 8 AS instrument, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS hour, least(3600, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 60) AS valid
 FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)"""


def source_records(sources: DataFrame) -> DataFrame:
    """source_hours with a venue, a kind, JSON metadata, some of them malformed, and clocks of which some are missing."""
    return sources.selectExpr("*", "CASE WHEN source_id % 3 = 0 THEN 'trades' ELSE 'orderbook' END AS kind", "concat('v', source_id % 2) AS venue", "CASE WHEN source_id % 13 = 0 THEN '{bad' WHEN source_id % 17 = 0 THEN '{\"content_sha256\": \"zz\"}' ELSE concat('{\"content_sha256\": \"', sha2(CAST(source_id AS STRING), 256), '\"}') END AS meta", "CASE WHEN source_id % 5 = 0 THEN NULL ELSE hour END AS downloaded_at", "hour - 2 AS discovered_at")


SOURCE_RECORDS = SOURCE_HOURS + ", rec AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN 'trades' ELSE 'orderbook' END AS kind, 'v' || source_id % 2 AS venue, NOT (source_id % 13 = 0 OR source_id % 17 = 0) AS sound, CASE WHEN source_id % 5 = 0 THEN NULL ELSE hour END AS downloaded_at, hour - 2 AS discovered_at FROM src)"


def price_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, hour) of stored price hours."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return lines.selectExpr("l_suppkey % 8 AS instrument", "unix_seconds(CAST(l_shipdate AS TIMESTAMP)) div 86400 AS hour").distinct()


PRICE_OUTPUTS = "pout AS (SELECT DISTINCT l_suppkey % 8 AS instrument, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS hour FROM lineitem WHERE l_returnflag = 'A')"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, kind, status, started, ended): an order is a run that ends when its last line ships; open ones have no end."""
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.expr("unix_seconds(CAST(max(l_shipdate) AS TIMESTAMP))").alias("ended"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "o_orderpriority AS kind", "o_orderstatus AS status", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS started")
    return orders.join(ends, "run_id", "left").withColumn("ended", F.when(F.col("status") != "P", F.col("ended")))


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS kind, o_orderstatus AS status, CAST(epoch(o_orderdate) AS BIGINT) AS started, CASE WHEN o_orderstatus <> 'P' THEN e END AS ended FROM orders LEFT JOIN (SELECT l_orderkey, CAST(epoch(max(l_shipdate)) AS BIGINT) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
