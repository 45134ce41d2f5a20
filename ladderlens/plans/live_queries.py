"""Queries over contracts, scalar functions and streams, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.functions import scalar
from ladderlens.operators import book as B
from ladderlens.operators import contracts as C
from ladderlens.operators import hours as H
from ladderlens.operators import price as P
from ladderlens.operators import replay as R
from ladderlens.operators.bars import outages
from ladderlens.plans.bar_queries import CANDLES, DENSE, END, START, STEP, VIEW, _view
from ladderlens.plans.book_queries import RESTORED, SAMPLES, SLOT, checkpoints
from ladderlens.plans.event_queries import RICH, RICH_LIVE
from ladderlens.plans.staging import kept, new_folder, shared_dir
from ladderlens.sources import archive
from ladderlens.sources import stand_in as S
from ladderlens.streaming import live, stateful

SINCE = 1704067200
HALF = SINCE + 15 * 86400


def _venue_events(spark, d):
    """Events of three venues with some fields missing, as contracts must judge them."""
    return S.book_events(spark, d).selectExpr(
        "market", "hour", "n", "kind", "CASE market WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS venue", "t AS event_time", "CASE WHEN n % 13 = 0 THEN NULL ELSE t END AS transaction_time",
        "CASE WHEN n % 41 = 0 THEN NULL ELSE final_id END AS final_id", "CASE WHEN n % 43 = 0 THEN NULL ELSE prev_id END AS prev_final_id", "CASE WHEN kind = 'snapshot' AND market = 2 THEN -1 WHEN n % 47 = 0 THEN -5 ELSE prev_id END AS last_id",
    )


VENUES = S.EVENTS + """, ve AS (SELECT market, hour, n, kind, CASE market WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS venue, t AS et, CASE WHEN n % 13 = 0 THEN NULL ELSE t END AS tt,
 CASE WHEN n % 41 = 0 THEN NULL ELSE final_id END AS f, CASE WHEN n % 43 = 0 THEN NULL ELSE prev_id END AS p, CASE WHEN kind = 'snapshot' AND market = 2 THEN -1 WHEN n % 47 = 0 THEN -5 ELSE prev_id END AS l0 FROM ev),
 vs AS (SELECT *, CASE WHEN venue = 'okx' AND kind = 'snapshot' AND l0 = -1 THEN f ELSE l0 END AS l, coalesce(tt, CASE WHEN venue = 'binance' AND kind = 'snapshot' THEN et END) AS tt2 FROM ve),
 vp AS (SELECT *, CASE WHEN kind = 'snapshot' THEN NULL WHEN venue = 'binance' THEN p WHEN venue = 'bybit' THEN f - 1 ELSE l END AS pred FROM vs),
 vc2 AS (SELECT *, CASE WHEN venue = 'binance' AND tt2 IS NULL THEN 'no_transaction_time' WHEN l < 0 THEN 'negative_id' WHEN f IS NULL THEN 'no_frontier' WHEN kind = 'update' AND pred IS NULL THEN 'no_predecessor' END AS err FROM vp)"""


def _events(spark, d):
    schema = S.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id", (F.col("user_id") % 3).alias("market"), F.round(F.col("value") * 100).cast("long").alias("price"))


def _in_parts(spark, df, parts):
    """A stream of a table's parts (conditions), and what feeds it one part after the other; a run of the stream
    after each feed takes that part as one micro-batch."""
    folder = new_folder(spark, "stream-source")
    feeds = [lambda i=i, where=where: df.where(where).write.parquet(f"{folder}/part={i:03d}") for i, where in enumerate(parts)]
    return spark.readStream.schema(df.schema).parquet(f"{folder}/part=*"), feeds


def stream_ohlc(spark, d):
    rows = live.trade_ohlc(_events(spark, d), "1 hour", ["event_type"], order="event_id")
    out = live.drained(rows, shared_dir(spark), ["window", "event_type"])
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "open", "high", "low", "close", "trades")


def stream_dedup(spark, d):
    rows = _events(spark, d)
    again = rows.union(rows.where("event_id % 50 = 0"))
    return live.drained(live.deduplicated(again, ["event_id"]).select("event_id", "event_type"), shared_dir(spark), ["event_id"], "append").groupBy("event_type").agg(F.count("*").alias("n"))


def _rich_events(spark, d):
    """Events for every outcome of a replay, with their changes, and the time that halves them."""
    changes = kept(S.changes(spark, d))
    events = S.replay_events(S.events_of(changes))
    rich = kept(stateful.with_changes(events.drop("base", "other"), S.replay_changes(events, changes)))
    return rich, rich.agg(F.expr("percentile_approx(t, 0.5)")).first()[0] or 0


def stream_replay(spark, d):
    """Events in two runs, the second from the first one's state, to a sample of each slot that the watermark has passed."""
    events, half = _rich_events(spark, d)
    stream, feeds = _in_parts(spark, events, [f"t <= {half}", f"t > {half}"])
    with stateful.keyed_state(spark, 4):
        return live.drained(stateful.book_samples(stream, SLOT), shared_dir(spark), ["market", "slot"], "append", feeds)


def stream_outcomes(spark, d):
    events, half = _rich_events(spark, d)
    stream, feeds = _in_parts(spark, events, [f"t <= {half}", f"t > {half}"])
    with stateful.keyed_state(spark, 4):
        return live.drained(stateful.replay_outcomes(stream), shared_dir(spark), ["market", "n"], "append", feeds)


def stream_restored(spark, d):
    """Hours after every third one, with the checkpoints of those as initial state."""
    changes = kept(S.changes(spark, d))
    book = kept(S.events_of(changes))
    stored = B.eligible(kept(checkpoints(spark, d, changes).where("through_hour % 3 = 0")))
    starts, levels = R.restored(book, stored)
    initial = kept(starts.join(levels.select("market", "hour", "side", "price", "qty"), ["market", "hour"]))
    events = kept(stateful.with_changes(book.where("hour % 3 <> 0"), changes))
    half = events.agg(F.expr("percentile_approx(t, 0.5)")).first()[0] or 0
    stream, feeds = _in_parts(spark, events, [f"t <= {half}", f"t > {half}"])
    with stateful.keyed_state(spark, 4):
        rows = stateful.replay_outcomes(stream, initial)
        return live.drained(rows, shared_dir(spark), ["market", "n"], "append", feeds).drop("issue")


def stream_outages(spark, d):
    """Alarms over usable seconds that come in two runs, of which the second takes up open outages; market 3 never comes."""
    usable = S.market_seconds(spark, d).where("quality = 'VALID'").select("market", "ts")
    expected = spark.range(4).select(F.col("id").alias("market"), F.lit(SINCE).cast("long").alias("start"))
    stream, feeds = _in_parts(spark, kept(usable), [f"ts < {HALF}", f"ts >= {HALF}"])
    with stateful.keyed_state(spark, 4):
        return live.drained(stateful.outage_alarms(stream, 3600, 3600, expected), shared_dir(spark), ["market", "gap_start", "status"], "append", feeds)


def stream_late(spark, d):
    rows = S.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    stream, feeds = _in_parts(spark, rows, ["event_id % 20 <> 0", "event_id % 20 = 0"])
    return live.late_rows(stream, shared_dir(spark), ["event_id"], feeds=feeds)


def stream_market_sums(spark, d):
    rows = _events(spark, d).withColumnRenamed("price", "amount").withColumns({"market": F.col("market") * 32, "valid": F.col("event_type") != "error"})
    out = live.drained(live.market_sums(rows, "1 hour", 3), shared_dir(spark), ["window"])
    return out.select(F.unix_seconds("window.start").alias("start"), "amount", F.col("markets").cast("long").alias("markets"), "quality")


def book_rows(spark, d):
    """The stand-in changes as an archive has them: text prices, nanosecond clocks, some rows that must be rejected."""
    r = S.changes(spark, d)
    return r.selectExpr(
        "t * 1000000000 AS received_time", "CASE WHEN n % 59 = 0 THEN -1 ELSE t * 1000 END AS event_time", "CASE WHEN kind = 'snapshot' THEN NULL ELSE t * 1000 END AS transaction_time", "concat(' sym', market) AS symbol",
        "CASE WHEN price = 1850 THEN 'other' ELSE upper(kind) END AS event_type", "final_id AS first_update_id", "CASE WHEN n % 61 = 0 THEN -7 ELSE final_id END AS final_update_id", "prev_id AS prev_final_update_id", "CAST(NULL AS BIGINT) AS last_update_id",
        "concat(' ', side) AS side", "CASE WHEN price % 450 = 0 THEN 'abc' ELSE CAST(CAST(price AS DECIMAL(18,2)) AS STRING) END AS price", "CAST(qty AS STRING) AS quantity", "CAST(NULL AS BIGINT) AS order_count", "concat('v', market) AS venue", "hour", "row_index",
    )


def _trade_rows(spark, d):
    return S.trades(spark, d).selectExpr("received_ns AS received_time", "trade_ms AS event_time", "symbol", "CAST(trade_id AS STRING) AS trade_id", "CAST(price AS STRING) AS price", "CAST(qty AS STRING) AS quantity", "trade_ms AS trade_time", "trade_id % 2 = 0 AS is_buyer_maker", "CAST(NULL AS STRING) AS order_type", "symbol AS venue", "trade_ms div 86400000 AS hour", "ordinal")


def _archived(spark, rows, kind, order):
    root = new_folder(spark, "archive")
    archive.write_archive(rows, root, kind, order)
    return archive.read_source(spark, root, kind)


def archive_book(spark, d):
    """Archive files of a range of hours, with their place, from files of their own."""
    rows = _archived(spark, book_rows(spark, d), "orderbook", ["row_index"])
    return rows.where("venue = 'v1' AND hour BETWEEN 310 AND 340").select("venue", "hour", "row_index", F.col("received_time").alias("ns"), F.trim("side").alias("side"), "price", "quantity")


def archive_trades(spark, d):
    rows = _archived(spark, _trade_rows(spark, d), "trades", ["ordinal"]).where("hour >= 19730")
    return rows.groupBy("venue", "hour").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("long")).alias("quantity"), F.max("row_index").alias("last_row"))


def required_columns(spark, d):
    """An archive with more columns than its kind requires: what a scan takes of it."""
    root = new_folder(spark, "wide")
    _trade_rows(spark, d).withColumns({"note": F.lit("x"), "ordinal": F.col("ordinal")}).write.partitionBy("venue").parquet(root)
    rows = archive.require(spark.read.parquet(root), archive.TRADE_SCHEMA)
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.max("received_time").alias("newest"), F.lit(len(rows.columns)).alias("columns"))


def strict_trades(spark, d):
    """Trades with text prices, of which none may be rejected: one that is would fail the query."""
    text = S.trades(spark, d).where("price > 0").selectExpr("symbol", "CAST(trade_id AS STRING) AS trade_id", "trade_ms", "CAST(price AS STRING) AS price", "CAST(qty AS STRING) AS qty")
    return P.strict(P.judged_trades(text)).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("price").cast("decimal(28,8)").cast("string").alias("prices"))


def book_rejects(spark, d):
    judged = P.judged_book(book_rows(spark, d), F.expr("CASE WHEN hour % 9 = 0 THEN 'SYM9' ELSE upper(concat('sym', substr(venue, 2))) END"), ("first_update_id", "final_update_id", "prev_final_update_id"))
    return judged.groupBy("venue", "problem").agg(F.count("*").alias("n"))


def stored_hours(spark, d):
    """Packed hours written twice to a store, of which a range is read back."""
    seconds = S.market_seconds(spark, d).withColumn("source_count", F.when(F.col("quality") == "VALID", 2).otherwise(0))
    path, hours = new_folder(spark, "hours"), kept(H.packed(seconds, ["market"], 86400, ["bid", "ask"]))
    H.write_hours(hours.where("hour % 3 <> 0"), path, ["market", "hour"], 10)
    H.write_hours(hours, path, ["market", "hour"], 10)
    return H.unpacked(H.read_hours(spark, path, 19735, 19752, 10), ["market"], 86400).select("market", "ts", "bid", "ask", "quality", "reason", "source_count")


def stored_prices(spark, d):
    path = new_folder(spark, "prices")
    candles = P.ohlc(P.deduplicated(S.trades(spark, d)), 3_600_000).withColumns({"ts": F.col("slot") * 3600, "quality": F.lit("VALID"), "bid": F.col("open")})
    H.write_hours(H.packed(candles, ["symbol"], 86400, ["bid", "open", "high", "low", "close", "trades"]), path, ["symbol", "hour"], 10)
    out = H.unpacked(H.read_hours(spark, path, 19735, 19752, 10), ["symbol"], 86400)
    return out.select("symbol", "ts", *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close")], "trades")


def exported(spark, d):
    """Bars, regions and scores as JSON files, read back."""
    folder, bars = new_folder(spark, "export"), _view(spark, d)
    expected = spark.range(3).select(F.col("id").alias("market"))
    archive.export(bars, folder, ["valid"], outages(S.market_seconds(spark, d).where("quality = 'VALID'"), expected, START, END, 3600, STEP))
    back, regions = spark.read.schema(bars.schema).json(f"{folder}/bars.json"), spark.read.json(f"{folder}/regions.json")
    return back.select("bar_start", "valid", F.round("bid.c", 6).alias("bid_c")).crossJoin(F.broadcast(regions.agg(F.count("*").alias("regions"))))


DEC = "CAST({0} AS DECIMAL(18,8))"


def exact(spark, d):
    """Sums of exact products, sums and differences."""
    x = S.table(spark, d, "lineitem").select("l_returnflag", *[F.col(f"l_{a}").cast("decimal(18,8)").alias(b) for a, b in (("quantity", "q"), ("extendedprice", "p"), ("tax", "t"))])
    q, p, t = F.col("q"), F.col("p"), F.col("t")
    return x.groupBy("l_returnflag").agg(F.sum(scalar.multiplied(q, p)).cast("decimal(38,16)").cast("string").alias("product"), F.sum(scalar.added(p, t)).cast("decimal(38,8)").cast("string").alias("total"), F.sum(scalar.subtracted(p, q)).cast("decimal(38,8)").cast("string").alias("difference"))


def _defects(spark, d):
    """Seconds of which some break every invariant."""
    t = "ts div 3600"
    return S.market_seconds(spark, d).selectExpr("market", "ts", f"CASE WHEN {t} % 29 = 0 THEN 'ODD' WHEN {t} % 5 = 0 AND quality = 'VALID' THEN 'DEGRADED' ELSE quality END AS quality", f"CASE WHEN {t} % 31 = 0 THEN NULL WHEN {t} % 37 = 0 THEN -1 ELSE bid END AS bid", f"CASE WHEN {t} % 41 = 0 THEN 7 ELSE ask END AS ask", f"CASE WHEN {t} % 43 = 0 THEN 'why' WHEN {t} % 47 = 0 THEN NULL ELSE reason END AS reason", f"CASE WHEN {t} % 53 = 0 THEN 1L WHEN quality = 'VALID' THEN 3L - CAST({t} % 5 = 0 AS INT) ELSE 0L END AS source_count")


DEFECTS = S.SECONDS + """, de0 AS (SELECT market, CASE WHEN ts // 3600 % 29 = 0 THEN 'ODD' WHEN ts // 3600 % 5 = 0 AND quality = 'VALID' THEN 'DEGRADED' ELSE quality END AS quality, CASE WHEN ts // 3600 % 31 = 0 THEN NULL WHEN ts // 3600 % 37 = 0 THEN -1 ELSE bid END AS bid,
 CASE WHEN ts // 3600 % 41 = 0 THEN 7 ELSE ask END AS ask, CASE WHEN ts // 3600 % 43 = 0 THEN 'why' WHEN ts // 3600 % 47 = 0 THEN NULL ELSE reason END AS reason, CASE WHEN ts // 3600 % 53 = 0 THEN 1 WHEN quality = 'VALID' THEN 3 - CAST(ts // 3600 % 5 = 0 AS INT) ELSE 0 END AS source_count FROM seconds),
 de AS (SELECT *, quality IN ('VALID', 'DEGRADED') AS ok, quality = 'INVALID' AS off FROM de0)"""
#: The slots that the watermark, here the last event's time, has passed, on a grid from each market's first slot.
PASSED_SAMPLES = SAMPLES.replace("max(slot) AS b FROM ls GROUP BY market", f"(SELECT max(t) // {SLOT} - 1 FROM replayed) AS b FROM ls GROUP BY market")
CENTS = "CAST(round(value * 100) AS BIGINT)"
QUERIES = {
    "n9_sequence_contracts": (lambda s, d: C.under_contract(_venue_events(s, d), C.contracts(s)).groupBy("venue", "kind", "contract_error").agg(F.count("*").alias("n"), F.count("transaction_time").alias("timed"), F.sum("frontier_id").alias("frontiers"), F.sum("predecessor_id").alias("predecessors")), f"WITH {VENUES} SELECT venue, kind, err AS contract_error, count(*) AS n, count(tt2) AS timed, CAST(sum(f) AS BIGINT) AS frontiers, CAST(sum(pred) AS BIGINT) AS predecessors FROM vc2 GROUP BY ALL"),
    "n6_mixed_sentinels": (lambda s, d: C.mixed_sentinels(S.changes(s, d).withColumn("sentinel", (F.col("price") > 2000) & (F.col("kind") == "snapshot")), ["market", "n"]), f"WITH {S.CHANGES} SELECT market, n, count(*) FILTER (price > 2000 AND kind = 'snapshot') AS sentinels, count(*) AS n_rows FROM changes GROUP BY market, n HAVING sentinels > 0 AND sentinels < n_rows"),
    "n11_hour_ownership": (lambda s, d: C.outside_hour(S.book_events(s, d).withColumn("t", F.col("t") + F.col("n") % 5 * 86400), "t", S.HOUR), f"WITH {S.EVENTS} SELECT market, hour, count(*) AS n_rows, count(*) FILTER ((t + n % 5 * 86400) // {S.HOUR} <> hour) AS outside FROM ev GROUP BY ALL"),
    "n12_second_invariants": (lambda s, d: C.violations(_defects(s, d), 3), f"WITH {DEFECTS} SELECT market, 0::BIGINT + count(*) FILTER (quality NOT IN ('VALID', 'DEGRADED', 'INVALID')) AS unknown_quality, count(*) FILTER (ok AND (bid IS NULL OR ask IS NULL)) AS valid_without_values, count(*) FILTER (ok AND reason IS NOT NULL) AS valid_with_reason, count(*) FILTER (off AND (bid IS NOT NULL OR ask IS NOT NULL)) AS invalid_with_values, count(*) FILTER (off AND reason IS NULL) AS invalid_without_reason, count(*) FILTER (bid < 0 OR ask < 0) AS negative_values, count(*) FILTER ((quality = 'VALID' AND source_count <> 3) OR (quality = 'DEGRADED' AND source_count NOT IN (1, 2)) OR (off AND source_count <> 0)) AS wrong_source_count FROM de GROUP BY market"),
    "n12_candle_invariants": (lambda s, d: C.candle_violations(P.dense(P.ohlc(P.deduplicated(S.trades(s, d)), 3_600_000), 24).withColumns({"high": F.expr("CASE WHEN slot % 9 = 0 THEN low ELSE high END"), "trades": F.expr("CASE WHEN slot % 7 = 0 THEN 0 ELSE trades END"), "close": F.expr("CASE WHEN slot % 5 = 0 THEN coalesce(close, 1) ELSE close END")})), f"WITH {DENSE}, x AS (SELECT symbol, quality = 'VALID' AS ok, open, CASE WHEN slot % 9 = 0 THEN low ELSE high END AS high, low, CASE WHEN slot % 5 = 0 THEN coalesce(close, 1) ELSE close END AS close, CASE WHEN slot % 7 = 0 THEN 0 ELSE trades END AS trades FROM dense) SELECT symbol, count(*) FILTER (ok AND (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL)) AS valid_without_prices, count(*) FILTER (ok AND trades < 1) AS valid_without_trades, count(*) FILTER (low > least(open, close) OR high < greatest(open, close)) AS out_of_order, count(*) FILTER (low <= 0) AS not_positive, count(*) FILTER (NOT ok AND (open IS NOT NULL OR high IS NOT NULL OR low IS NOT NULL OR close IS NOT NULL)) AS empty_with_prices, count(*) FILTER (NOT ok AND trades > 0) AS empty_with_trades FROM x GROUP BY symbol"),
    "b9_clamped_clock": (lambda s, d: C.clamped_clock(S.book_events(s, d).withColumn("t", F.col("t") - F.col("n") % 7 * 86400), "t", "n").select("market", "n", "clamped", "ran_back"), f"WITH {S.EVENTS}, x AS (SELECT market, hour, n, t - n % 7 * 86400 AS t FROM ev) SELECT market, n, max(t) OVER w AS clamped, max(t) OVER w > t AS ran_back FROM x WINDOW w AS (PARTITION BY market, hour ORDER BY n)"),
    "f4_unix_units": (lambda s, d: S.trades(s, d).select("ordinal", scalar.unix_seconds_of(F.when(F.col("trade_id") % 3 == 0, F.col("received_ns")).when(F.col("trade_id") % 3 == 1, F.col("trade_ms")).otherwise(F.expr("trade_ms div 1000"))).alias("seconds")).groupBy("seconds").agg(F.count("*").alias("n")), f"WITH {S.TRADES} SELECT trade_ms // 1000 AS seconds, count(*) AS n FROM trades GROUP BY ALL"),
    "f6_preset_identity": (lambda s, d: S.table(s, d, "customer").select("c_custkey", scalar.identity(F.col("c_name"), F.col("c_nationkey")).alias("preset_hash")), "SELECT c_custkey, sha256(length(c_name) || ':' || c_name || ',' || length(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey || ',') AS preset_hash FROM customer"),
    "a31_input_identity": (lambda s, d: S.market_seconds(s, d).groupBy("market", F.expr("ts div 86400").alias("day")).agg(scalar.input_identity(F.concat_ws(":", F.col("ts").cast("string"), "quality")).alias("digest")), f"WITH {S.SECONDS} SELECT market, ts // 86400 AS day, sha256(string_agg(x, '' ORDER BY x)) AS digest FROM (SELECT *, length(ts || ':' || quality) || ':' || ts || ':' || quality || ',' AS x FROM seconds) GROUP BY ALL"),
    "t1_stream_ohlc": (stream_ohlc, f"SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type, arg_min({CENTS}, (ts, event_id)) AS open, max({CENTS}) AS high, min({CENTS}) AS low, arg_max({CENTS}, (ts, event_id)) AS close, count(*) AS trades FROM events GROUP BY ALL"),
    "t2_stream_dedup": (stream_dedup, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "t3_stream_replay": (stream_replay, f"WITH {RICH_LIVE}{PASSED_SAMPLES} SELECT market, slot, n, valid, state, best_bid, best_ask, CAST(bid_levels AS BIGINT) AS bid_levels, CAST(ask_levels AS BIGINT) AS ask_levels FROM topped"),
    "t3_stream_outcomes": (stream_outcomes, f"WITH {RICH} SELECT market, hour, n, outcome, valid, was_valid, epoch, state, issue FROM replayed"),
    "t3_stream_restored": (stream_restored, f"WITH {RESTORED} SELECT market, hour, n, outcome, valid, was_valid, epoch, state FROM restored"),
    "t4_stream_outages": (
        stream_outages,
        f"WITH {S.SECONDS}, u AS (SELECT market, ts FROM seconds WHERE quality = 'VALID'), e AS (SELECT CAST(m AS BIGINT) AS market, {SINCE} - 3600 AS ts FROM generate_series(0, 3) t(m)), s AS (SELECT market, ts + 3600 AS gap_start, lead(ts) OVER (PARTITION BY market ORDER BY ts) AS gap_end FROM (SELECT * FROM u UNION ALL SELECT * FROM e))"
        ", g AS (SELECT * FROM s WHERE coalesce(gap_end, (SELECT max(ts) FROM u)) - gap_start > 3600) SELECT market, gap_start, NULL::BIGINT AS gap_end, 'open' AS status FROM g UNION ALL SELECT market, gap_start, gap_end, 'closed' FROM g WHERE gap_end IS NOT NULL",
    ),
    "t5_late_rows": (stream_late, "WITH a AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 900000000 AS mark, count(*) AS n FROM events WHERE event_id % 20 <> 0), b AS (SELECT count(*) AS n, count(*) FILTER (epoch_us(ts) <= (SELECT mark FROM a)) AS late FROM events WHERE event_id % 20 = 0) SELECT 0::BIGINT AS batch, n AS n_rows, 0::BIGINT AS late, n AS kept FROM a UNION ALL SELECT (SELECT CASE WHEN n > 0 THEN 2 ELSE 0 END FROM a), n, late, n - late FROM b"),
    "t6_stream_market_sums": (stream_market_sums, f"SELECT epoch_us(ts) // 3600000000 * 3600 AS start, CAST(sum({CENTS}) FILTER (event_type <> 'error') AS BIGINT) AS amount, count(DISTINCT user_id % 3) FILTER (event_type <> 'error') AS markets, CASE WHEN count(DISTINCT user_id % 3) FILTER (event_type <> 'error') >= 3 THEN 'VALID' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'DEGRADED' ELSE 'INVALID' END AS quality FROM events GROUP BY ALL"),
    "s1_archive_scan": (archive_book, f"WITH {S.CHANGES} SELECT 'v' || market AS venue, hour, row_index - 1 AS row_index, t * 1000000000 AS ns, side, CASE WHEN price % 450 = 0 THEN 'abc' ELSE CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) END AS price, CAST(qty AS VARCHAR) AS quantity FROM changes WHERE market = 1 AND hour BETWEEN 310 AND 340"),
    "s2_trade_scan": (archive_trades, f"WITH {S.TRADES} SELECT symbol AS venue, trade_ms // 86400000 AS hour, count(*) AS n, CAST(sum(qty) AS BIGINT) AS quantity, count(*) - 1 AS last_row FROM trades WHERE trade_ms // 86400000 >= 19730 GROUP BY ALL"),
    "s8_stored_hours": (stored_hours, f"WITH {S.SECONDS} SELECT market, ts, bid, ask, quality, reason, CASE WHEN quality = 'VALID' THEN 2 ELSE 0 END AS source_count FROM seconds WHERE ts // 86400 >= 19735 AND ts // 86400 < 19752"),
    "s9_stored_prices": (stored_prices, f"WITH {CANDLES} SELECT symbol, slot * 3600 AS ts, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in ('open', 'high', 'low', 'close'))}, trades FROM candles WHERE slot // 24 >= 19735 AND slot // 24 < 19752"),
    "s11_json_export": (exported, f"WITH {VIEW}, u AS (SELECT market, ts FROM seconds WHERE quality = 'VALID' AND ts >= {START} AND ts < {END}), g AS (SELECT market, ts + {STEP} AS a, coalesce(lead(ts) OVER (PARTITION BY market ORDER BY ts), {END}) AS b FROM u UNION ALL SELECT CAST(m AS BIGINT), {START}, coalesce(min(ts), {END}) FROM generate_series(0, 2) t(m) LEFT JOIN u ON market = m GROUP BY m) SELECT bar_start, valid, round(bid_c, 6) AS bid_c, (SELECT count(*) FROM g WHERE b - a > 3600) AS regions FROM vb"),
    "s4_required_columns": (required_columns, f"WITH {S.TRADES} SELECT symbol, count(*) AS n, max(received_ns) AS newest, 9 AS columns FROM trades GROUP BY ALL"),
    "n13_strict_trades": (strict_trades, f"WITH {S.TRADES} SELECT upper(symbol) AS symbol, count(*) AS n, CAST(CAST(sum(price) AS DECIMAL(28,8)) AS VARCHAR) AS prices FROM trades WHERE price > 0 GROUP BY 1"),
    "n1_book_rejects": (
        book_rejects,
        f"WITH {S.CHANGES}, x AS (SELECT 'v' || market AS venue, CASE WHEN hour % 9 = 0 THEN 'other_symbol' WHEN price = 1850 THEN 'bad_event_type' WHEN n % 59 = 0 THEN 'bad_event_time' WHEN n % 61 = 0 THEN 'negative_final_update_id' WHEN prev_id < 0 THEN 'negative_prev_final_update_id' WHEN price % 450 = 0 THEN 'not_decimal' END AS problem FROM changes) SELECT venue, problem, count(*) AS n FROM x GROUP BY ALL",
    ),
    "f2_utc_to_local": (lambda s, d: S.market_seconds(s, d).select("market", "ts", F.unix_seconds(scalar.utc_to_local(F.timestamp_seconds(F.col("ts") + 75 * 86400), "Europe/Berlin")).alias("local")), f"WITH {S.SECONDS} SELECT market, ts, ts + 75 * 86400 + CASE WHEN ts + 75 * 86400 < 1711846800 THEN 3600 ELSE 7200 END AS local FROM seconds"),
    "f3_floors": (lambda s, d: S.trades(s, d).select(*[F.unix_seconds(scalar.floored(F.timestamp_millis("trade_ms"), x)).alias(x) for x in ("second", "minute", "hour")]).groupBy("second", "minute", "hour").agg(F.count("*").alias("n")), f"WITH {S.TRADES} SELECT trade_ms // 1000 AS second, trade_ms // 60000 * 60 AS minute, trade_ms // 3600000 * 3600 AS hour, count(*) AS n FROM trades GROUP BY ALL"),
    "f5_exact_decimals": (exact, f"WITH x AS (SELECT l_returnflag, {DEC.format('l_quantity')} AS q, {DEC.format('l_extendedprice')} AS p, {DEC.format('l_tax')} AS t FROM lineitem) SELECT l_returnflag, CAST(CAST(sum(CAST(q AS DECIMAL(28,8)) * CAST(p AS DECIMAL(9,2))) AS DECIMAL(38,16)) AS VARCHAR) AS product, CAST(CAST(sum(p + t) AS DECIMAL(38,8)) AS VARCHAR) AS total, CAST(CAST(sum(p - q) AS DECIMAL(38,8)) AS VARCHAR) AS difference FROM x GROUP BY 1"),
    "f6_canonical_text": (lambda s, d: S.table(s, d, "orders").select("o_orderkey", scalar.canonical_fraction(F.col("o_totalprice").cast("decimal(18,2)")).alias("text")), "SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS text FROM orders"),
    "f7_exact_json": (lambda s, d: S.table(s, d, "orders").select("o_orderkey", scalar.exact_json({"price": F.col("o_totalprice").cast("decimal(18,2)"), "at": F.col("o_orderdate").cast("timestamp"), "n": F.col("o_custkey")}).alias("json")), """SELECT o_orderkey, '{"price":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '","at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000Z","n":' || o_custkey || '}' AS json FROM orders"""),
}
