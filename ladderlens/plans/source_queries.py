"""Queries over file layout, profiles, exports, time ranges and presets, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.functions import scalar
from ladderlens.operators import bars as A
from ladderlens.operators import book as B
from ladderlens.operators import catalog as O
from ladderlens.operators import views as V
from ladderlens.plans.bar_queries import VIEW, _view
from ladderlens.plans.book_queries import CHECKPOINT, checkpoints
from ladderlens.plans.staging import kept
from ladderlens.sources import archive as R
from ladderlens.sources import stand_in as S

SERIES = ["bid", "ask", "delta"]
FIXED = tuple(x for x in A.TIMEFRAMES.values() if x < 604800)
ZONE = "Europe/Berlin"
STORED = CHECKPOINT + ", stored AS (SELECT DISTINCT market, through_hour FROM cp WHERE through_hour % 5 <> 0), hours AS (SELECT DISTINCT market, hour AS through_hour FROM ev WHERE hour % 7 <> 0)"


def manifest(s, d):
    """Declared row counts, some of them wrong or absent."""
    counts = S.changes(s, d).groupBy("market", "hour").agg(F.count("*").alias("declared"))
    return counts.where("hour % 10 <> 0").withColumn("declared", F.col("declared") + F.expr("CASE WHEN hour % 11 = 0 THEN 1 ELSE 0 END"))


def paths(s, d):
    rows = S.source_hours(s, d).select("instrument", (F.col("hour") * 86400 + F.col("instrument") * 3600).alias("start"))
    return rows.withColumn("path", R.path_of(F.lit("okx"), F.col("start"), F.concat(F.lit("SYM"), F.col("instrument").cast("string")), F.lit("trades")))


def inventory(s, d):
    """Some checkpoints are not stored, some hold a level without quantity, some hours expect none."""
    changes = kept(S.changes(s, d))
    stored = kept(checkpoints(s, d, changes).where("through_hour % 5 <> 0").withColumn("qty", F.expr("CASE WHEN through_hour % 4 = 0 AND place = 1 THEN 0 ELSE qty END")))
    hours = changes.where("hour % 7 <> 0").select("market", F.col("hour").alias("through_hour")).distinct()
    return O.checkpoint_inventory(stored, B.checkpoint_state(stored), hours, 12)


def spans(s, d):
    """Each symbol's range snapped to the finest bar length that fits the budget."""
    r = S.trades(s, d).groupBy("symbol").agg(F.expr("min(trade_ms) div 1000").alias("first"), F.expr("max(trade_ms) div 1000").alias("last"))
    best = V.snapped(V.finest(r.withColumns({"start": F.col("first"), "end": F.col("last") + 1}), 1200, FIXED))
    return best.select("symbol", "bar", "start", "end", F.expr("(end - start) div bar").alias("bars"))


def local_times(s, d):
    """Hours of a market taken as civil times of a zone: their UTC, or why there is none."""
    local = F.timestamp_seconds(F.col("ts") + F.when(F.col("market") == 0, 285).otherwise(75) * 86400)
    utc, problem = scalar.local_to_utc(local, ZONE)
    return S.market_seconds(s, d).select("market", "ts", F.unix_seconds(utc).alias("utc"), problem.alias("problem"))


QUERIES = {
    "s6_row_reconciliation": (lambda s, d: R.reconciled(S.changes(s, d), manifest(s, d), ["market", "hour"]), f"WITH {S.CHANGES}, c AS (SELECT market, hour, count(*) AS read FROM changes GROUP BY ALL) SELECT market, hour, CASE WHEN hour % 10 <> 0 THEN read + 1 END AS declared, read FROM c WHERE hour % 10 = 0 OR hour % 11 = 0"),
    "s7_path_layout": (lambda s, d: paths(s, d).select("path", R.layout(F.col("path")).alias("l")).select("path", "l.*"), f"WITH {S.SOURCE_HOURS}, x AS (SELECT 'SYM' || instrument AS symbol, hour * 86400 + instrument * 3600 AS start FROM src) SELECT 'okx/' || strftime(make_timestamp(start * 1000000), '%Y-%m-%d/%H') || '/' || symbol || '_trades.parquet' AS path, 'okx' AS venue, start, symbol, 'trades' AS kind FROM x"),
    "s12_long_export": (lambda s, d: R.long_rows(_view(s, d).select("bar_start", *[F.col(c)["c"].alias(c) for c in SERIES]), SERIES), f"WITH {VIEW} " + " UNION ALL ".join(f"SELECT bar_start, '{c}' AS series, {c}_c AS value FROM vb" for c in SERIES)),
    "s13_archive_profile": (lambda s, d: R.profile(S.changes(s, d), ["market", "hour"]), f"WITH {S.CHANGES} SELECT market, hour, count(*) AS n_rows, count(DISTINCT n) AS events, count(DISTINCT CASE WHEN kind = 'snapshot' THEN n END) AS snapshots, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (qty = 0) AS removals, min(final_id) AS least_id, max(final_id) AS most_id, min(t) AS first_t, max(t) AS last_t FROM changes GROUP BY ALL"),
    "a5_auto_timeframe": (spans, f"WITH {S.TRADES}, r AS (SELECT symbol, min(trade_ms) // 1000 AS a, max(trade_ms) // 1000 AS b FROM trades GROUP BY symbol), f(seconds) AS (VALUES {', '.join(f'({x}::BIGINT)' for x in A.TIMEFRAMES.values() if x < 604800)}), x AS (SELECT symbol, a, b, min(seconds) AS bar FROM r, f WHERE ceil((b + 1 - a) / seconds) <= 1200 GROUP BY ALL) SELECT symbol, bar, a // bar * bar AS start, b // bar * bar + bar AS \"end\", (b // bar * bar + bar - a // bar * bar) // bar AS bars FROM x"),
    "a29_preset_components": (lambda s, d: S.table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("markets")).select("o_custkey", F.posexplode("markets").alias("place", "market")).withColumn("component", scalar.identity(F.col("o_custkey"), F.col("market"))), "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS INTEGER) AS place, o_orderpriority AS market, sha256(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || ',' || length(o_orderpriority) || ':' || o_orderpriority || ',') AS component FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)"),
    "o11_newest_release": (lambda s, d: S.trades(s, d).groupBy("symbol").agg(O.newest_release(F.expr("max(trade_ms) div 1000"), 900).alias("newest")), f"WITH {S.TRADES} SELECT symbol, (max(trade_ms) // 1000 - 900) // 3600 * 3600 - 3600 AS newest FROM trades GROUP BY symbol"),
    "o16_checkpoint_inventory": (inventory, f"WITH {STORED}, c AS (SELECT market, through_hour, count(*) AS n, bool_or(side = 'bid') AND bool_or(side = 'ask') AS two_sided, count(last_id) > 0 AS known FROM cp WHERE through_hour % 5 <> 0 GROUP BY ALL) SELECT market, through_hour, 'orphan' AS problem FROM stored ANTI JOIN hours USING (market, through_hour) UNION ALL SELECT market, through_hour, 'missing' FROM hours ANTI JOIN stored USING (market, through_hour) UNION ALL SELECT market, through_hour, 'invalid' FROM c WHERE NOT two_sided OR NOT known OR through_hour % 4 = 0 UNION ALL SELECT market, through_hour, 'oversized' FROM c WHERE n > 12"),
    "o18_stale_runs": (
        lambda s, d: O.stale(S.table(s, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.expr("unix_seconds(CAST(o_orderdate AS TIMESTAMP)) div 86400").alias("started")), ["started"], 10600, 800).select("o_orderkey", "age"),
        "SELECT o_orderkey, 10600 - CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS age FROM orders WHERE o_orderstatus = 'O' AND 10600 - CAST(epoch(o_orderdate) AS BIGINT) // 86400 > 800",
    ),
    "f1_local_to_utc": (local_times, f"WITH {S.SECONDS}, x AS (SELECT market, ts, ts + CASE WHEN market = 0 THEN 285 ELSE 75 END * 86400 AS l FROM seconds) SELECT market, ts, CASE WHEN l < 1711850400 THEN l - 3600 WHEN l >= 1711854000 AND l < 1729994400 THEN l - 7200 WHEN l >= 1729998000 THEN l - 3600 END AS utc, CASE WHEN l >= 1711850400 AND l < 1711854000 THEN 'nonexistent' WHEN l >= 1729994400 AND l < 1729998000 THEN 'ambiguous' END AS problem FROM x"),
}
