"""Queries over trades, seconds, bars and their statistics, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.operators import bars as A
from ladderlens.operators import hours as H
from ladderlens.operators import price as P
from ladderlens.operators import stats as X
from ladderlens.operators import views as V
from ladderlens.plans.staging import kept
from ladderlens.sources import stand_in as S

STEP, DAY, START, END = 3600, 86400, 1704067200 + 5 * 3600, 1704067200 + 20 * 86400 + 7 * 3600
SLOT_MS = 3_600_000
D = "CAST({0} AS DOUBLE)"


def doubled(df):
    """Decimals as doubles, structs as columns, for comparison."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"{f.name}.{g.name}").cast("double").alias(f"{f.name}_{g.name}") for g in f.dataType]
        elif f.dataType.typeName() == "decimal":
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rounded(df, digits=6):
    d = doubled(df)
    return d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def text_trades(spark, d):
    """Trades as an archive has them: text prices, and some rows that must be rejected."""
    t = S.table(spark, d, "events")
    price = "CASE WHEN event_id % 101 = 0 THEN 'abc' WHEN event_id % 103 = 0 THEN '-1.5' WHEN event_id % 107 = 0 THEN '1.123456789' WHEN event_id % 109 = 0 THEN '0' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END"
    return t.selectExpr("concat(' ', event_type) AS symbol", "CASE WHEN event_id % 113 = 0 THEN ' ' ELSE CAST(event_id AS STRING) END AS trade_id", "CASE WHEN event_id % 127 = 0 THEN -1 ELSE unix_millis(CAST(ts AS TIMESTAMP)) END AS trade_ms", f"{price} AS price", "'1' AS qty")


REJECTED = """x AS (SELECT upper(event_type) AS symbol, CASE WHEN event_id % 113 = 0 THEN 'blank_id' WHEN event_id % 127 = 0 THEN 'bad_clock' WHEN event_id % 101 = 0 OR (event_id % 107 = 0 AND event_id % 103 <> 0) THEN 'not_decimal'
 WHEN event_id % 103 = 0 THEN 'out_of_range' WHEN event_id % 109 = 0 OR CAST(value AS DECIMAL(18,2)) = 0 THEN 'zero_price' END AS problem FROM events)"""


def _candles(spark, d):
    return P.ohlc(P.deduplicated(S.trades(spark, d)), SLOT_MS)


CANDLES = S.TRADES + f", dd AS (SELECT symbol, trade_id, min(ordinal) AS ordinal, arg_min(trade_ms, ordinal) AS trade_ms, arg_min(price, ordinal) AS price, arg_min(qty, ordinal) AS qty, count(*) AS copies, count(DISTINCT (trade_ms, price, qty)) > 1 AS conflict FROM trades GROUP BY symbol, trade_id), candles AS (SELECT symbol, trade_ms // {SLOT_MS} AS slot, arg_min(price, (trade_ms, ordinal)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (trade_ms, ordinal)) AS close, count(*) AS trades FROM dd GROUP BY ALL)"
DENSE = CANDLES + ", hrs AS (SELECT DISTINCT symbol, slot // 24 AS hour FROM candles), grid AS (SELECT symbol, hour, unnest(generate_series(hour * 24, hour * 24 + 23)) AS slot FROM hrs), dense AS (SELECT grid.*, open, high, low, close, coalesce(trades, 0) AS trades, CASE WHEN open IS NULL THEN 'NO_TRADES' ELSE 'VALID' END AS quality FROM grid LEFT JOIN candles USING (symbol, slot))"


def _dense(spark, d):
    return P.dense(_candles(spark, d), 24)


def _summed(spark, d):
    return A.market_sum(S.market_seconds(spark, d), 3)


SUMMED = S.SECONDS + ", ms AS (SELECT *, CASE WHEN source_count >= 3 THEN 'VALID' WHEN source_count > 0 THEN 'DEGRADED' ELSE 'INVALID' END AS quality FROM (SELECT ts, CAST(sum(bid) FILTER (quality = 'VALID') AS BIGINT) AS bid, CAST(sum(ask) FILTER (quality = 'VALID') AS BIGINT) AS ask, count(*) FILTER (quality = 'VALID') AS source_count, coalesce(string_agg(CAST(market AS VARCHAR), ',' ORDER BY market) FILTER (quality = 'VALID'), '') AS contributors FROM seconds GROUP BY ts))"


def _clicks(spark, d):
    """The price of one symbol at the seconds of its candles."""
    return _candles(spark, d).where("symbol = 'click'").withColumn("ts", F.col("slot") * 3600)


def _view(spark, d, bar=6 * STEP):
    return A.view_bars(_summed(spark, d), START, END, bar, STEP, _clicks(spark, d))


def _thin(spark, d):
    """Sums of which some have no liquidity at all."""
    zero = F.expr("ts div 3600 % 23 = 0")
    return _summed(spark, d).withColumns({x: F.when(zero & F.col(x).isNotNull(), 0).otherwise(F.col(x)) for x in ("bid", "ask")})


def _candle_sql(e, name, cond="usable"):
    return f"arg_min({e}, ts) FILTER ({cond} AND {e} IS NOT NULL) AS {name}_o, max({e}) FILTER ({cond}) AS {name}_h, min({e}) FILTER ({cond}) AS {name}_l, arg_max({e}, ts) FILTER ({cond} AND {e} IS NOT NULL) AS {name}_c"


def _view_sql(bar, summed=None):
    e = {"bid": "CAST(bid AS DOUBLE)", "ask": "CAST(ask AS DOUBLE)", "total": "CAST(bid + ask AS DOUBLE)", "delta": "CAST(bid - ask AS DOUBLE)", "share": "100 * CAST(bid AS DOUBLE) / CAST(bid + ask AS DOUBLE)"}
    cols = ", ".join(_candle_sql(x, n, "true") for n, x in e.items())
    return (summed or SUMMED) + f""", {CANDLES}, pr0 AS (SELECT slot * 3600 // {bar} * {bar} AS bar_start, {', '.join(f'CAST({e} AS DOUBLE) AS price_{x}' for x, e in PRICE.items())} FROM candles WHERE symbol = 'click' AND slot * 3600 >= {START} AND slot * 3600 < {END} GROUP BY ALL), vb0 AS (SELECT ts // {bar} * {bar} AS bar_start, {cols}, count(*) AS valid FROM ms WHERE quality <> 'INVALID' AND ts >= {START} AND ts < {END} GROUP BY ALL),
 vg AS (SELECT unnest(generate_series({START // bar * bar}, {(END - 1) // bar * bar}, {bar})) AS bar_start),
 vb AS (SELECT bar_start, vb0.* EXCLUDE (bar_start, valid), pr0.* EXCLUDE (bar_start), coalesce(valid, 0) AS valid, (least(bar_start + {bar}, {END}) - greatest(bar_start, {START})) // {STEP} AS source_seconds, (greatest(bar_start, {START}) + least(bar_start + {bar}, {END})) * 500000 AS midpoint_us FROM vg LEFT JOIN vb0 USING (bar_start) LEFT JOIN pr0 USING (bar_start))"""


PRICE = {"o": "arg_min(open, slot)", "h": "max(high)", "l": "min(low)", "c": "arg_max(close, slot)"}
VIEW = _view_sql(6 * STEP)
THIN = _view_sql(6 * STEP, SUMMED.replace(", ms AS (", ", ms0 AS (", 1) + ", ms AS (SELECT * REPLACE (CASE WHEN ts // 3600 % 23 = 0 AND bid IS NOT NULL THEN 0 ELSE bid END AS bid, CASE WHEN ts // 3600 % 23 = 0 AND ask IS NOT NULL THEN 0 ELSE ask END AS ask) FROM ms0)").replace("100 * CAST(bid AS DOUBLE) / CAST(bid + ask AS DOUBLE)", "100 * CAST(bid AS DOUBLE) / nullif(CAST(bid + ask AS DOUBLE), 0)")
VIEW_COLUMNS = [f"{c}_{x}" for c in ("bid", "ask", "total", "delta", "share", "price") for x in "ohlc"]
VIEW_SELECT = "bar_start, valid, source_seconds, " + ", ".join(f"round({c}, 6) AS {c}" for c in VIEW_COLUMNS)


def _liquidity(spark, d):
    return A.liquidity_bars(S.market_seconds(spark, d), ["market"], DAY, STEP)


LIQUIDITY = (
    S.SECONDS
    + f", u AS (SELECT *, quality = 'VALID' AS usable, ts // {DAY} * {DAY} AS bar_start FROM seconds), g AS (SELECT *, CASE WHEN usable THEN ts - coalesce(max(CASE WHEN usable THEN ts END) OVER (PARTITION BY market, bar_start ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), bar_start - {STEP}) - {STEP} END AS gap FROM u), lb AS (SELECT market, bar_start, "
    + ", ".join(_candle_sql(f"CAST({e} AS DOUBLE)", n) for n, e in A.CHANNELS.items())
    + f", max(gap) AS gap, max(ts) FILTER (usable) AS last_usable, max(ts) AS last_ts, arg_max(quality, ts) AS lq, count(*) AS observed, count(*) FILTER (usable) AS valid FROM g GROUP BY ALL)"
)
WHOLE = (
    SUMMED
    + f", u AS (SELECT *, quality <> 'INVALID' AS usable, ts // {DAY} * {DAY} AS bar_start FROM ms), lb AS (SELECT bar_start, "
    + ", ".join(_candle_sql(f"CAST({e} AS DOUBLE)", n) for n, e in A.CHANNELS.items())
    + ", max(ts) AS last_ts, arg_max(quality, ts) AS lq, count(*) FILTER (usable) AS valid, bool_or(quality = 'DEGRADED') AS degraded FROM u GROUP BY ALL)"
)
LIQUIDITY_SELECT = ", ".join(f"{c}_{x}" for c in A.CHANNELS for x in "ohlc")


def _metrics(spark, d):
    return A.metrics(_view(spark, d), group=5 * DAY)


METRICS = VIEW + ", p AS (SELECT *, CASE WHEN lag(valid) OVER w > 0 THEN lag(bid_c) OVER w END AS b0, CASE WHEN lag(valid) OVER w > 0 THEN lag(ask_c) OVER w END AS a0, bid_c AS b, ask_c AS a FROM vb WINDOW w AS (ORDER BY bar_start))"
METRIC_SQL = {
    "total_change": "(b + a) - (b0 + a0)", "total_change_pct": "100 * ((b + a) - (b0 + a0)) / nullif(b0 + a0, 0)", "delta_change": "(b - a) - (b0 - a0)",
    "imbalance_change": "2 * (100 * b / nullif(b + a, 0) - 100 * b0 / nullif(b0 + a0, 0))", "relative_side_change": "100 * (b / nullif(b0, 0) - a / nullif(a0, 0))",
}


def _scan(spark, d):
    """Bars of a scan: the hourly bid share of each market."""
    s = S.market_seconds(spark, d).where("quality = 'VALID'")
    return s.select("market", "ts", F.round(100 * F.col("bid").cast("double") / (F.col("bid") + F.col("ask")).cast("double"), 4).alias("share"))


SCAN = S.SECONDS + ", scan AS (SELECT market, ts, round(100 * CAST(bid AS DOUBLE) / CAST(bid + ask AS DOUBLE), 4) AS share FROM seconds WHERE quality = 'VALID')"
SCALE = SCAN + ", med AS (SELECT market, median(share) AS median, count(*) AS n FROM scan GROUP BY market), sc AS (SELECT market, median, n, median(abs(share - median)) AS mad, avg(abs(share - median)) AS mean_ad FROM scan JOIN med USING (market) GROUP BY ALL)"
TAILS = ", ct AS (SELECT market, share, count(*) AS ties FROM scan GROUP BY ALL), tl AS (SELECT market, share, (below + (ties - 1) / 2.0) / (total - 1) AS lower_tail, (total - below - ties + (ties - 1) / 2.0) / (total - 1) AS upper_tail FROM (SELECT *, coalesce(sum(ties) OVER (PARTITION BY market ORDER BY share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(ties) OVER (PARTITION BY market) AS total FROM ct))"
SCORE = SCALE + TAILS + f""", z AS (SELECT market, ts, share, upper_tail, lower_tail, CASE WHEN mad > 0 THEN {X.MAD_TO_SIGMA} * (share - median) / mad ELSE (share - median) / ({X.MEAN_AD_TO_SIGMA} * mean_ad) END AS z FROM scan JOIN sc USING (market) JOIN tl USING (market, share)),
 hl AS (SELECT *, CASE WHEN z > 0 THEN least(100, 100 * sqrt((1 - upper_tail) * z / (z + 3.5))) ELSE 0 END AS high, CASE WHEN z < 0 THEN least(100, 100 * sqrt((1 - lower_tail) * -z / (-z + 3.5))) ELSE 0 END AS low FROM z)"""


def _durations(spark, d):
    ends = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ended"))
    o = S.table(spark, d, "orders").join(ends, "o_orderkey")
    seconds = F.greatest(F.lit(0), F.unix_seconds(F.col("ended").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return o.select("o_orderpriority", "o_orderstatus", seconds.cast("double").alias("seconds"))


EXPECTED = lambda spark: spark.range(3).select(F.col("id").alias("market"))


def _grid(spark):
    return spark.range(START, END, STEP).select(F.col("id").alias("ts"))


def _sums_text(df):
    text = F.array_join(F.transform("contributions", lambda x: F.concat_ws(":", x["market"].cast("string"), x["bid"].cast("string"), x["ask"].cast("string"))), ",")
    return df.select("ts", "source_count", F.coalesce(text, F.lit("")).alias("contributions"))


def _requests(spark, d):
    """A request a user: from the first to the last event, some of them reversed or with odd limits and lengths."""
    r = S.table(spark, d, "events").groupBy("user_id").agg(F.expr("min(unix_micros(CAST(ts AS TIMESTAMP)))").alias("a"), F.expr("max(unix_micros(CAST(ts AS TIMESTAMP)))").alias("b"))
    return r.selectExpr("user_id", "CASE WHEN user_id % 7 = 0 THEN b ELSE a END AS start_us", "CASE WHEN user_id % 7 = 0 THEN a ELSE b END AS end_us", "CASE WHEN user_id % 11 = 0 THEN 60 ELSE (user_id % 40) * 86400 + 3600 END AS most_seconds", "CASE user_id % 5 WHEN 0 THEN 3600 WHEN 1 THEN 60 WHEN 2 THEN 7 END AS asked")


REQUESTS = """rq AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN b ELSE a END AS start_us, CASE WHEN user_id % 7 = 0 THEN a ELSE b END AS end_us, CASE WHEN user_id % 11 = 0 THEN 60 ELSE (user_id % 40) * 86400 + 3600 END AS most_seconds,
 CASE user_id % 5 WHEN 0 THEN 3600 WHEN 1 THEN 60 WHEN 2 THEN 7 END AS asked FROM (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY user_id)),
 rs AS (SELECT *, start_us // 1000000 AS start, end_us // 1000000 + 1 AS stop, end_us // 1000000 + 1 - start_us // 1000000 AS slots FROM rq)"""
FITS = lambda x: f"(stop - 1) // {x} - start // {x} + 1"


def _slots(spark, d):
    return V.request_slots(_requests(spark, d))


def _ranges(spark, d):
    """Ranges of users in hours, most of them of whole buckets."""
    return _slots(spark, d).where("end > start").selectExpr("user_id", "start div 3600 * 3600 + CASE WHEN user_id % 9 = 0 THEN 5 ELSE 0 END AS start", "end div 3600 * 3600 AS end", "CAST(CASE WHEN user_id % 2 = 0 THEN 3600 ELSE 14400 END AS BIGINT) AS bar")


RANGES = REQUESTS + ", rg AS (SELECT user_id, start // 3600 * 3600 + CASE WHEN user_id % 9 = 0 THEN 5 ELSE 0 END AS start, stop // 3600 * 3600 AS stop, CASE WHEN user_id % 2 = 0 THEN 3600 ELSE 14400 END AS bar FROM rs WHERE stop > start), rj AS (SELECT *, CASE WHEN stop <= start THEN 'empty' WHEN start % bar <> 0 THEN 'partial_start' WHEN stop % bar <> 0 THEN 'partial_end' END AS problem FROM rg)"


def _map_text(column):
    return F.coalesce(F.array_join(F.transform(F.map_entries(column), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","), F.lit(""))


OUT = f"SELECT {{0}}gap_start, gap_end, row_number() OVER ({{1}} ORDER BY gap_start) AS number, count(*) OVER ({{1}}) > 5000 AS truncated FROM g WHERE gap_end - gap_start > 3600"

QUERIES = {
    "n3_trade_rejects": (lambda s, d: P.normalised(text_trades(s, d))[1].groupBy("symbol", "problem").agg(F.count("*").alias("n")), f"WITH {REJECTED} SELECT symbol, problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY ALL"),
    "n7_trade_normalisation": (lambda s, d: P.normalised(text_trades(s, d))[0].groupBy("symbol").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total")), f"WITH {REJECTED.replace('AS problem FROM', 'AS problem, CAST(value AS DECIMAL(18,2)) AS price FROM')} SELECT symbol, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM x WHERE problem IS NULL GROUP BY symbol"),
    "n8_zero_prices_by_venue": (
        lambda s, d: P.normalised(text_trades(s, d), F.upper(F.when(F.col("trade_id").cast("string").endswith("9"), F.lit("x")).otherwise(F.trim("symbol"))), F.trim("symbol").isin("click", "view"))[1].groupBy("symbol", "problem").agg(F.count("*").alias("n")),
        f"WITH {REJECTED.replace('FROM events)', ', event_type, event_id FROM events)')}, y AS (SELECT symbol, CASE WHEN problem = 'blank_id' THEN problem WHEN event_id % 10 = 9 THEN 'other_symbol' WHEN problem = 'zero_price' AND event_type NOT IN ('click', 'view') THEN 'out_of_range' ELSE problem END AS problem FROM x) SELECT symbol, problem, count(*) AS n FROM y WHERE problem IS NOT NULL GROUP BY ALL",
    ),
    "p1_trade_dedup": (lambda s, d: doubled(P.deduplicated(S.trades(s, d))), f"WITH {CANDLES} SELECT symbol, trade_id, ordinal, trade_ms, {D.format('price')} AS price, qty, copies, conflict FROM dd"),
    "p2_trade_ohlc": (lambda s, d: doubled(_candles(s, d)), f"WITH {CANDLES} SELECT symbol, slot, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in ('open', 'high', 'low', 'close'))}, trades FROM candles"),
    "p3_dense_slots": (lambda s, d: _dense(s, d).select("symbol", "hour", "slot", F.col("close").cast("double").alias("close"), "trades", "quality"), f"WITH {DENSE} SELECT symbol, hour, slot, CAST(close AS DOUBLE) AS close, trades, quality FROM dense"),
    "p4_price_summary": (lambda s, d: P.price_summary(_dense(s, d)), f"WITH {DENSE} SELECT symbol, hour, count(*) AS slots, count(*) FILTER (quality = 'VALID') AS valid, count(*) FILTER (quality = 'NO_TRADES') AS no_trades, CAST(sum(trades) AS BIGINT) AS trades FROM dense GROUP BY ALL"),
    "p5_archive_routing": (
        lambda s, d: P.routed(S.trades(s, d).withColumn("received_ns", F.col("received_ns") + F.col("qty") * 60_000_000_000), SLOT_MS),
        f"WITH {S.TRADES}, r AS (SELECT symbol, trade_id, trade_ms // {SLOT_MS} AS hour, (received_ns + qty * 60000000000) // 1000000 // {SLOT_MS} AS arc, received_ns + qty * 60000000000 AS rn, ordinal FROM trades), q AS (SELECT *, coalesce(rn < lag(rn) OVER (PARTITION BY symbol, arc ORDER BY ordinal), false) AS back, abs(arc - hour) <= 1 AS near FROM r), o AS (SELECT symbol, hour, trade_id, count(*) AS n, count(*) FILTER (near) AS near, count(*) FILTER (near AND arc <> hour) AS nb, count(*) FILTER (back) AS back FROM q GROUP BY ALL) SELECT symbol, hour, CAST(sum(n) AS BIGINT) AS input, count(*) FILTER (near > 0) AS accepted, CAST(sum(greatest(near - 1, 0)) AS BIGINT) AS duplicates, CAST(sum(n - near) AS BIGINT) AS outside, CAST(sum(nb) AS BIGINT) AS from_neighbours, CAST(sum(back) AS BIGINT) AS receipts_back FROM o GROUP BY ALL",
    ),
    "p5_mixed_archives": (lambda s, d: P.mixed_archives(S.trades(s, d).withColumn("venue", F.when(F.col("symbol").isin("click", "view"), F.lit("mixed")).otherwise(F.col("symbol"))), SLOT_MS).select("venue", "archive_hour", F.array_join("symbols", ",").alias("symbols")), f"WITH {S.TRADES} SELECT CASE WHEN symbol IN ('click', 'view') THEN 'mixed' ELSE symbol END AS venue, received_ns // 1000000 // {SLOT_MS} AS archive_hour, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM trades GROUP BY 1, 2 HAVING count(DISTINCT symbol) > 1"),
    "a2_week_floor": (lambda s, d: S.market_seconds(s, d).groupBy(A.floor_to("ts", 604800).alias("week")).agg(F.count("*").alias("n")), f"WITH {S.SECONDS} SELECT (ts - {A.MONDAY}) // 604800 * 604800 + {A.MONDAY} AS week, count(*) AS n FROM seconds GROUP BY ALL"),
    "a8_liquidity_bars": (
        lambda s, d: doubled(_liquidity(s, d)),
        f"WITH {LIQUIDITY} SELECT market, bar_start, {LIQUIDITY_SELECT}, CASE WHEN last_ts = bar_start + {DAY - STEP} AND lq = 'VALID' THEN 'VALID' ELSE 'INVALID' END AS quality, {DAY // STEP} AS expected, observed, valid, observed - valid AS invalid, {DAY // STEP} - observed AS missing, greatest(coalesce(gap, 0), coalesce(bar_start + {DAY} - last_usable - {STEP}, {DAY})) // {STEP} AS longest_gap, observed < {DAY // STEP} AS discontinuity, false AS degraded FROM lb",
    ),
    "a12_price_bars": (lambda s, d: doubled(A.price_bars(_candles(s, d).withColumn("ts", F.col("slot") * 3600).withColumn("quality", F.when(F.col("slot") % 10 == 0, "INVALID").otherwise("VALID")), ["symbol"], DAY)), f"WITH {CANDLES} SELECT symbol, slot // 24 * {DAY} AS bar_start, CAST(arg_min(open, slot) FILTER (slot % 10 <> 0) AS DOUBLE) AS open, CAST(max(high) FILTER (slot % 10 <> 0) AS DOUBLE) AS high, CAST(min(low) FILTER (slot % 10 <> 0) AS DOUBLE) AS low, CAST(arg_max(close, slot) FILTER (slot % 10 <> 0) AS DOUBLE) AS close, CAST(sum(trades) FILTER (slot % 10 <> 0) AS BIGINT) AS trades, count(*) AS seconds, count(*) FILTER (slot % 10 <> 0) AS valid FROM candles GROUP BY ALL"),
    "a3_snapped_ranges": (lambda s, d: V.snapped(_slots(s, d).where("end > start").selectExpr("user_id", "start AS first", "end AS last", "CAST(CASE WHEN user_id % 3 = 0 THEN 604800 ELSE 14400 END AS BIGINT) AS bar")).select("user_id", "bar", "start", F.col("end").alias("stop")), f"WITH {REQUESTS}, x AS (SELECT user_id, start, stop, CASE WHEN user_id % 3 = 0 THEN 604800 ELSE 14400 END AS bar, CASE WHEN user_id % 3 = 0 THEN {A.MONDAY} ELSE 0 END AS z FROM rs WHERE stop > start) SELECT user_id, CAST(bar AS BIGINT) AS bar, (start - z) // bar * bar + z AS start, (stop - z) // bar * bar + z + bar AS stop FROM x"),
    "a4_aligned_buckets": (lambda s, d: V.aligned_buckets(_ranges(s, d))[0].groupBy("user_id").agg(F.count("*").alias("buckets"), F.min("bucket_start").alias("first"), F.max("bucket_end").alias("last"), F.max("index").alias("last_index")), f"WITH {RANGES} SELECT user_id, count(*) AS buckets, min(b) AS first, max(b + bar) AS last, CAST(count(*) - 1 AS INTEGER) AS last_index FROM (SELECT user_id, bar, unnest(generate_series(start, stop - bar, bar)) AS b FROM rj WHERE problem IS NULL) GROUP BY user_id"),
    "a4_rejected_ranges": (lambda s, d: V.aligned_buckets(_ranges(s, d))[1].select("user_id", "problem"), f"WITH {RANGES} SELECT user_id, problem FROM rj WHERE problem IS NOT NULL"),
    "a6_view_timeframe": (
        lambda s, d: V.view_timeframe(_slots(s, d).where("end > start")).select("user_id", "bar", "bars", "problem"),
        f"WITH {REQUESTS}, x AS (SELECT *, CASE {' '.join(f'WHEN {FITS(x)} <= 1200 THEN {x}' for x in V.VIEW_SECONDS)} END AS fine FROM rs WHERE stop > start), y AS (SELECT *, CASE WHEN asked IS NULL THEN fine WHEN asked = 7 THEN NULL WHEN {FITS('asked')} <= 1200 THEN asked END AS bar FROM x) SELECT user_id, CAST(bar AS BIGINT) AS bar, {FITS('bar')} AS bars, CASE WHEN asked = 7 THEN 'unsupported' WHEN asked IS NOT NULL AND bar IS NULL THEN 'too_many_bars' WHEN bar IS NULL THEN 'range_too_long' END AS problem FROM y",
    ),
    "a7_request_slots": (lambda s, d: _slots(s, d).select("user_id", "start", F.col("end").alias("stop"), "slots", "problem"), f"WITH {REQUESTS} SELECT user_id, start, stop, slots, CASE WHEN end_us < start_us THEN 'reversed' WHEN most_seconds < 3600 THEN 'bad_limit' WHEN slots > most_seconds THEN 'too_long' END AS problem FROM rs"),
    "o8_handed_off": (lambda s, d: V.handed_off(_slots(s, d).where("end > start").selectExpr("user_id", "start", "end - 1 AS end", "most_seconds")).select("user_id", "start", F.col("end").alias("stop"), "shortened"), f"WITH {REQUESTS} SELECT user_id, CASE WHEN slots > most_seconds THEN stop - most_seconds ELSE start END AS start, stop - 1 AS stop, slots > most_seconds AS shortened FROM rs WHERE stop > start"),
    "a11_degraded_bars": (lambda s, d: doubled(A.liquidity_bars(_summed(s, d), [], DAY, STEP)).select("bar_start", "quality", "valid", "degraded"), f"WITH {WHOLE} SELECT bar_start, CASE WHEN last_ts <> bar_start + {DAY - STEP} OR lq = 'INVALID' THEN 'INVALID' WHEN lq = 'DEGRADED' OR degraded THEN 'DEGRADED' ELSE 'VALID' END AS quality, valid, degraded FROM lb"),
    "a14_bar_balance": (lambda s, d: A.bar_balance(A.liquidity_bars(_summed(s, d), [], DAY, STEP)).select("bar_start", "end_total", "end_delta", F.round("imbalance", 9).alias("imbalance")), f"WITH {WHOLE} SELECT bar_start, bid_c + ask_c AS end_total, bid_c - ask_c AS end_delta, round((bid_c - ask_c) / nullif(bid_c + ask_c, 0), 9) AS imbalance FROM lb"),
    "a13_repeated_seconds": (lambda s, d: A.repeated_seconds(S.market_seconds(s, d).withColumn("ts", F.expr("ts div 7200 * 7200")), ["market"]), f"WITH {S.SECONDS} SELECT market, ts // 7200 * 7200 AS ts, count(*) AS copies FROM seconds GROUP BY 1, 2 HAVING count(*) > 1"),
    "a15_market_sum": (lambda s, d: A.market_sum(S.market_seconds(s, d), 3, grid=_grid(s)).drop("contributions"), f"WITH {SUMMED}, g AS (SELECT unnest(generate_series({START}, {END - 1}, {STEP})) AS ts) SELECT ts, bid, ask, coalesce(source_count, 0) AS source_count, coalesce(contributors, '') AS contributors, coalesce(quality, 'INVALID') AS quality, round(CAST(bid - ask AS DOUBLE) / nullif(CAST(bid + ask AS DOUBLE), 0), 9) AS imbalance FROM g LEFT JOIN ms USING (ts)"),
    "a17_contributions": (lambda s, d: _sums_text(_summed(s, d)), f"WITH {S.SECONDS} SELECT ts, count(*) FILTER (quality = 'VALID') AS source_count, coalesce(string_agg(market || ':' || bid || ':' || ask, ',' ORDER BY market) FILTER (quality = 'VALID'), '') AS contributions FROM seconds GROUP BY ts"),
    "a20_bars_without_share": (lambda s, d: rounded(A.view_bars(_thin(s, d), START, END, 6 * STEP, STEP)).drop("midpoint_us"), f"WITH {THIN}, z AS (SELECT ts // {6 * STEP} * {6 * STEP} AS bar_start, bool_or(bid + ask = 0) AS none FROM ms WHERE quality <> 'INVALID' AND ts >= {START} AND ts < {END} GROUP BY ALL) SELECT bar_start, valid, source_seconds, {', '.join(f'round({c}, 6) AS {c}' for c in VIEW_COLUMNS if c[:5] not in ('share', 'price'))}, {', '.join(f'CASE WHEN NOT none THEN round(share_{x}, 6) END AS share_{x}' for x in 'ohlc')} FROM vb LEFT JOIN z USING (bar_start)"),
    "a16_expected_markets": (lambda s, d: A.uncovered(S.market_seconds(s, d), s.range(1, 5).select(F.col("id").alias("market"))), f"WITH {S.SECONDS}, e AS (SELECT unnest(generate_series(1, 4)) AS market) (SELECT DISTINCT market, 'unexpected' AS problem FROM seconds ANTI JOIN e USING (market)) UNION ALL (SELECT market, 'absent' AS problem FROM e ANTI JOIN seconds USING (market))"),
    "a19_view_bars": (lambda s, d: rounded(_view(s, d)), f"WITH {VIEW} SELECT {VIEW_SELECT}, midpoint_us FROM vb"),
    "a22_outages": (
        lambda s, d: A.outages(S.market_seconds(s, d).where("quality = 'VALID' AND market <> 2"), s.range(4).select(F.col("id").alias("market")), START, END, 3600, STEP),
        f"WITH {S.SECONDS}, u AS (SELECT market, ts FROM seconds WHERE quality = 'VALID' AND market <> 2 AND ts >= {START} AND ts < {END}), g AS (SELECT market, ts + {STEP} AS gap_start, coalesce(lead(ts) OVER (PARTITION BY market ORDER BY ts), {END}) AS gap_end FROM u UNION ALL SELECT CAST(m AS BIGINT), {START}, coalesce(min(ts), {END}) FROM generate_series(0, 3) t(m) LEFT JOIN u ON market = m GROUP BY m) {OUT.format('market, ', 'PARTITION BY market')}",
    ),
    "a23_partial_warnings": (
        lambda s, d: A.outages(A.whole_seconds(_summed(s, d)).select("ts", F.lit("l2").alias("channel")), s.range(1).select(F.lit("l2").alias("channel")), START, END, 3600, STEP),
        f"WITH {SUMMED}, u AS (SELECT ts FROM ms WHERE quality = 'VALID' AND ts >= {START} AND ts < {END}), g AS (SELECT ts + {STEP} AS gap_start, coalesce(lead(ts) OVER (ORDER BY ts), {END}) AS gap_end FROM u UNION ALL SELECT {START}, coalesce(min(ts), {END}) FROM u) {OUT.format(chr(39) + 'l2' + chr(39) + ' AS channel, ', '')}",
    ),
    "a24_load_counters": (lambda s, d: A.load_counters(_summed(s, d), _clicks(s, d), F.col("trades") > 7, F.col("trades") == 6), f"WITH {SUMMED}, {CANDLES} SELECT count(*) FILTER (quality <> 'INVALID') AS usable, count(*) FILTER (quality = 'INVALID') AS unusable, count(*) FILTER (quality = 'DEGRADED') AS partial, count(slot) FILTER (trades <> 6) AS priced, count(slot) FILTER (trades = 6) AS failed, CASE WHEN coalesce(bool_or(trades > 7), false) THEN 'corrupt' WHEN coalesce(bool_or(trades = 6), false) THEN 'failed' WHEN count(slot) > 0 THEN 'loaded' ELSE 'missing' END AS price_status FROM ms LEFT JOIN (SELECT slot, trades FROM candles WHERE symbol = 'click') c ON c.slot * 3600 = ts"),
    "a25_optional_price": (lambda s, d: doubled(_summed(s, d).join(_clicks(s, d).select("ts", "close"), "ts", "left")).select("ts", "quality", "source_count", "close"), f"WITH {SUMMED}, {CANDLES} SELECT ts, quality, source_count, CAST(close AS DOUBLE) AS close FROM ms LEFT JOIN (SELECT slot, close FROM candles WHERE symbol = 'click') c ON c.slot * 3600 = ts"),
    "a26_price_trust": (lambda s, d: doubled(A.trusted_prices(_candles(s, d).withColumn("ts", F.col("slot")), ["symbol"], F.expr("trades > 2 AND slot % 5 = 0"))).select("symbol", "slot", "close"), f"WITH {CANDLES} SELECT symbol, slot, CAST(close AS DOUBLE) AS close FROM candles LEFT JOIN (SELECT symbol, min(slot) AS bad FROM candles WHERE trades > 2 AND slot % 5 = 0 GROUP BY symbol) b USING (symbol) WHERE bad IS NULL OR slot < bad"),
    "a26_price_regions": (
        lambda s, d: A.price_outages(_candles(s, d).withColumn("ts", F.col("slot") * 3600), ["symbol"], F.expr("trades > 2 AND symbol IN ('click', 'view')"), START, END, 3600, STEP),
        f"WITH {CANDLES}, pc AS (SELECT symbol, slot * 3600 AS ts, trades FROM candles), ok AS (SELECT DISTINCT symbol FROM pc ANTI JOIN (SELECT DISTINCT symbol FROM pc WHERE trades > 2 AND symbol IN ('click', 'view') AND ts >= {START} AND ts < {END}) b USING (symbol)), u AS (SELECT symbol, ts FROM pc SEMI JOIN ok USING (symbol) WHERE ts >= {START} AND ts < {END}), g AS (SELECT symbol, ts + {STEP} AS gap_start, coalesce(lead(ts) OVER (PARTITION BY symbol ORDER BY ts), {END}) AS gap_end FROM u UNION ALL SELECT symbol, {START}, coalesce(min(ts), {END}) FROM ok LEFT JOIN u USING (symbol) GROUP BY symbol) {OUT.format('symbol, ', 'PARTITION BY symbol')}",
    ),
    "a27_coarsened_bars": (lambda s, d: rounded(A.coarsened(_view(s, d), DAY)), f"WITH {_view_sql(DAY)} SELECT {VIEW_SELECT} FROM vb"),
    "a28_component_coverage": (lambda s, d: A.component_coverage(S.market_seconds(s, d), EXPECTED(s), DAY, STEP).withColumn("reasons", _map_text("reasons")), f"WITH {S.SECONDS}, h AS (SELECT DISTINCT ts // {DAY} AS hour FROM seconds), g AS (SELECT m AS market, hour FROM h, generate_series(0, 2) t(m)), r AS (SELECT market, ts // {DAY} AS hour, reason, count(*) AS n, count(*) FILTER (quality = 'VALID') AS v FROM seconds GROUP BY ALL), c AS (SELECT market, hour, CAST(sum(v) AS BIGINT) AS v, coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason), '') AS reasons FROM r GROUP BY ALL) SELECT market, hour, coalesce(v, 0) AS valid, {DAY // STEP} - coalesce(v, 0) AS unusable, coalesce(reasons, '') AS reasons, v IS NULL AS missing_hour FROM g LEFT JOIN c USING (market, hour)"),
    "m1_bar_metrics": (
        lambda s, d: rounded(_metrics(s, d)),
        f"WITH {METRICS} SELECT bar_start, {', '.join(f'round({n}_{x}, 6) AS {m}_{x}' for n, m in (('delta', 'delta'), ('total', 'total'), ('share', 'bid_share')) for x in 'ohlc')}, {', '.join(f'round(2 * share_{x} - 100, 6) AS imbalance_{x}' for x in 'ohlc')}, {', '.join(f'round(100 - share_{y}, 6) AS ask_share_{x}' for x, y in zip('ohlc', 'olhc'))}, {', '.join(f'round({e}, 6) AS {n}' for n, e in METRIC_SQL.items())} FROM p",
    ),
    "x2_robust_scale": (lambda s, d: rounded(X.robust_scale(kept(_scan(s, d)), ["market"], "share")), f"WITH {SCALE} SELECT market, round(median, 6) AS median, n, round(mad, 6) AS mad, round(mean_ad, 6) AS mean_ad, CASE WHEN mad > 0 THEN 'MAD' WHEN mean_ad > 0 THEN 'MEAN_AD' ELSE 'ZERO' END AS scale_kind FROM sc"),
    "x3_tail_fractions": (lambda s, d: rounded(X.tail_fractions(kept(_scan(s, d)), ["market"], "share"), 9), f"WITH {SCAN}{TAILS} SELECT market, share, round(lower_tail, 9) AS lower_tail, round(upper_tail, 9) AS upper_tail FROM tl"),
    "x6_extremeness": (lambda s, d: rounded(X.extremeness(kept(_scan(s, d)), ["market"], "share", "ts")), f"WITH {SCORE} SELECT market, ts, share, round(greatest(high, low), 6) AS score, CASE WHEN high = 0 AND low = 0 THEN NULL WHEN high > low THEN 'BID_DOMINANT' WHEN high < low THEN 'ASK_DOMINANT' ELSE 'BOTH' END AS dominance FROM hl"),
    "x7_duration_summary": (
        lambda s, d: X.duration_summary(_durations(s, d), ["o_orderpriority", "o_orderstatus"], "seconds"),
        "WITH e AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS ended FROM lineitem GROUP BY 1), x AS (SELECT o_orderpriority, o_orderstatus, CAST(greatest(0, epoch(ended) - epoch(o_orderdate)) AS DOUBLE) AS s FROM orders JOIN e USING (o_orderkey)) SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95 FROM x GROUP BY ALL",
    ),
    "h1_packed_hours": (lambda s, d: H.packed(S.market_seconds(s, d), ["market"], DAY, ["bid", "ask", "reason"]).select("market", "hour", F.size("slots").cast("long").alias("slots"), F.expr("aggregate(slots, 0L, (a, x) -> a + coalesce(x.bid, 0))").alias("bid"), F.expr("array_join(transform(slots, x -> concat_ws(':', x.idx div 3600, x.code, x.reason)), ',')").alias("codes")), f"WITH {S.SECONDS} SELECT market, ts // {DAY} AS hour, count(*) AS slots, CAST(coalesce(sum(bid), 0) AS BIGINT) AS bid, string_agg(concat_ws(':', ts % {DAY} // 3600, CASE quality WHEN 'VALID' THEN 0 ELSE 2 END, reason), ',' ORDER BY ts) AS codes FROM seconds GROUP BY ALL"),
    "h1_packed_sums": (lambda s, d: H.packed(_summed(s, d).withColumn("base", F.lit("x")), ["base"], DAY, ["bid", "ask", "source_count"]).select("hour", F.expr("array_join(transform(slots, x -> concat_ws(':', x.idx div 3600, x.code, x.source_count)), ',')").alias("codes")), f"WITH {SUMMED} SELECT ts // {DAY} AS hour, string_agg(concat_ws(':', ts % {DAY} // 3600, CASE quality WHEN 'VALID' THEN 0 WHEN 'DEGRADED' THEN 1 ELSE 2 END, source_count), ',' ORDER BY ts) AS codes FROM ms GROUP BY ALL"),
    "h1_packed_prices": (lambda s, d: H.packed(_dense(s, d).withColumn("ts", F.col("slot")).withColumn("quality", F.when(F.col("quality") == "VALID", "VALID").otherwise("INVALID")).drop("hour"), ["symbol"], 24, ["open", "high", "low", "close", "trades"]).select("symbol", "hour", F.size("slots").cast("long").alias("slots"), F.expr("array_join(transform(slots, x -> concat_ws(':', x.idx, x.code, x.trades, x.close)), ',')").alias("content")), f"WITH {DENSE} SELECT symbol, hour, count(*) AS slots, string_agg(concat_ws(':', slot % 24, CASE quality WHEN 'VALID' THEN 0 ELSE 2 END, trades, close), ',' ORDER BY slot) AS content FROM dense GROUP BY ALL"),
    "h2_unpacked_hours": (lambda s, d: H.unpacked(H.packed(S.market_seconds(s, d), ["market"], DAY, ["bid", "ask"]), ["market"], DAY).select("market", "ts", "bid", "ask", "quality"), f"WITH {S.SECONDS} SELECT market, ts, bid, ask, quality FROM seconds"),
    "h3_verified_hours": (lambda s, d: H.verified(H.packed(S.market_seconds(s, d), ["market"], DAY, ["bid", "ask"]), DAY // STEP).groupBy("market", "state").agg(F.count("*").alias("n")), f"WITH {S.SECONDS}, x AS (SELECT market, ts // {DAY} AS hour, CASE WHEN count(*) = {DAY // STEP} THEN 'ok' ELSE 'incomplete' END AS state FROM seconds GROUP BY 1, 2) SELECT market, state, count(*) AS n FROM x GROUP BY ALL"),
}
