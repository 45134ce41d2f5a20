"""Queries over the hour catalog, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.operators import catalog as O
from ladderlens.operators import stats as X
from ladderlens.sources import stand_in as S

SUMMARY = "count(*) AS n, round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95"
BOTH = f"{S.SOURCE_HOURS}, {S.OUTPUTS}"
GRID = BOTH + ", grid AS (SELECT hour, instrument FROM (SELECT unnest(generate_series(min(hour), max(hour))) AS hour FROM src), (SELECT DISTINCT instrument FROM src))"
AVAILABLE = GRID + ", av AS (SELECT instrument, hour, CASE WHEN valid >= 3600 THEN 'analyzable' WHEN valid IS NOT NULL THEN 'materialized' WHEN status IN ('downloaded', 'processed') THEN 'downloaded' WHEN status = 'missing' THEN 'missing' ELSE 'unknown' END AS availability, coalesce(valid, 0) AS valid FROM grid LEFT JOIN src USING (instrument, hour) LEFT JOIN outp USING (instrument, hour))"
ISLANDS = S.OUTPUTS + ", isl AS (SELECT instrument, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM (SELECT *, hour - row_number() OVER (PARTITION BY instrument ORDER BY hour) AS g FROM outp WHERE valid >= 1800) GROUP BY instrument, g)"
RETAIN = BOTH + ", x AS (SELECT instrument, bytes, CASE WHEN status <> 'processed' THEN 'not_processed' WHEN hour >= 10000 THEN 'too_new' WHEN valid IS NULL THEN 'output_missing' ELSE 'prune' END AS decision FROM src LEFT JOIN outp USING (instrument, hour))"
PROBLEMS = f"""{S.SOURCE_RECORDS}, {S.OUTPUTS}, {S.PRICE_OUTPUTS}, done AS (SELECT * FROM rec WHERE status = 'processed'), db AS (SELECT instrument, hour FROM done WHERE kind = 'orderbook'), dt AS (SELECT instrument, hour FROM done WHERE kind = 'trades'), ob AS (SELECT instrument, hour FROM outp),
 pr AS (SELECT instrument, hour, 'malformed_metadata' AS problem FROM done WHERE NOT sound UNION ALL SELECT *, 'orderbook_output_missing' FROM (FROM db ANTI JOIN ob USING (instrument, hour)) UNION ALL SELECT *, 'orderbook_orphan_output' FROM (FROM ob ANTI JOIN db USING (instrument, hour)) UNION ALL SELECT *, 'trades_output_missing' FROM (FROM dt ANTI JOIN pout USING (instrument, hour)) UNION ALL SELECT *, 'trades_orphan_output' FROM (FROM pout ANTI JOIN dt USING (instrument, hour))
 UNION ALL SELECT *, 'book_without_price' FROM (FROM ob ANTI JOIN pout USING (instrument, hour)) UNION ALL SELECT *, 'price_without_book' FROM (FROM pout ANTI JOIN ob USING (instrument, hour)) UNION ALL SELECT instrument, hour, 'oversized' FROM rec WHERE bytes > 45000000)"""


def _available(s, d):
    return O.availability(S.source_hours(s, d), S.outputs(s, d))


def _problems(s, d):
    return O.consistency(S.source_records(S.source_hours(s, d)), S.outputs(s, d), S.price_outputs(s, d), 45_000_000)


def _plan(s, d):
    hours = S.source_hours(s, d).select("hour").distinct()
    return O.planned(hours, s.range(8).select(F.col("id").alias("instrument")))


QUERIES = {
    "o1_availability": (_available, f"WITH {AVAILABLE} SELECT * FROM av"),
    "o3_combined_status": (lambda s, d: O.combined(_available(s, d)), f"WITH {AVAILABLE} SELECT hour, CASE WHEN count(DISTINCT availability) = 1 THEN min(availability) ELSE 'partial' END AS status, count(*) AS markets, {', '.join(f'count(*) FILTER (availability = {chr(39)}{x}{chr(39)}) AS {x}' for x in O.STATES)}, min(valid) AS least_valid FROM av GROUP BY hour"),
    "o4_json_counts": (lambda s, d: S.table(s, d, "events").withColumn("props", F.expr("CASE WHEN event_id % 7 = 0 THEN '{bad' WHEN event_id % 11 = 0 THEN '{\"k\": -4}' ELSE props END")).groupBy("event_type").agg(F.sum(O.json_count("props", "$.k")).alias("k"), F.sum(O.json_count("props", "$.none")).alias("absent")), "SELECT event_type, CAST(sum(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END) AS BIGINT) AS k, CAST(0 AS BIGINT) AS absent FROM events GROUP BY event_type"),
    "o5_newest_window": (lambda s, d: O.newest_window(S.outputs(s, d).where("valid >= 1800"), ["instrument"]), f"WITH {ISLANDS} SELECT instrument, max(first_hour) AS first_hour, max(last_hour) AS last_hour, arg_max(hours, last_hour) AS hours FROM isl GROUP BY instrument"),
    "o6_local_day": (lambda s, d: O.on_local_day(S.market_seconds(s, d), "ts", "America/New_York", "2024-01-10").select("market", "ts"), f"WITH {S.SECONDS} SELECT market, ts FROM seconds WHERE ts >= 1704862800 AND ts < 1704949200"),
    "o7_calendar": (
        lambda s, d: O.calendar(S.market_seconds(s, d).selectExpr("market AS instrument", "ts", "ts div 3600 AS hour", "CASE WHEN quality = 'VALID' THEN 'analyzable' ELSE 'materialized' END AS availability"), "ts", "America/New_York", "2024-01-10", 72),
        f"WITH {S.SECONDS}, h AS (SELECT market AS instrument, ts, ts // 3600 AS hour, quality = 'VALID' AS ok FROM seconds WHERE ts >= 1704862800 - 72 * 3600 AND ts < 1704949200), t AS (SELECT instrument, count(*) AS hours_of_day, count(*) FILTER (ok) AS analyzable, count(*) FILTER (NOT ok) AS materialized FROM h WHERE ts >= 1704862800 GROUP BY 1), i AS (SELECT instrument, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours FROM (SELECT *, hour - row_number() OVER (PARTITION BY instrument ORDER BY hour) AS g FROM h WHERE ok) GROUP BY instrument, g), n AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY last_hour DESC) = 1) SELECT instrument, hours_of_day, analyzable, materialized, CASE WHEN hours_of_day IS NOT NULL THEN 0::BIGINT END AS downloaded, CASE WHEN hours_of_day IS NOT NULL THEN 0::BIGINT END AS missing, CASE WHEN hours_of_day IS NOT NULL THEN 0::BIGINT END AS unknown, first_hour, last_hour, hours FROM (SELECT DISTINCT instrument FROM h) LEFT JOIN t USING (instrument) LEFT JOIN n USING (instrument)",
    ),
    "o9_planned_sources": (_plan, f"WITH {S.SOURCE_HOURS} SELECT hour, CAST(i AS BIGINT) AS instrument FROM (SELECT DISTINCT hour FROM src), generate_series(0, 7) t(i)"),
    "o10_targets": (lambda s, d: O.targets(_plan(s, d), S.source_hours(s, d), S.outputs(s, d)), f"WITH {BOTH} SELECT instrument, hour, 'new' AS why FROM src WHERE status = 'downloaded' UNION ALL SELECT instrument, hour, 'output_missing' AS why FROM src ANTI JOIN outp USING (instrument, hour) WHERE status = 'processed'"),
    "o10_processing_order": (lambda s, d: O.in_processing_order(S.source_records(S.source_hours(s, d)).where("status = 'downloaded'").select("kind", "venue", "instrument", "hour")), f"WITH {S.SOURCE_RECORDS} SELECT kind, venue, instrument, hour, row_number() OVER (PARTITION BY kind, venue ORDER BY instrument, hour) AS place FROM rec WHERE status = 'downloaded'"),
    "o12_catch_up": (lambda s, d: O.catch_up(S.source_hours(s, d), 1, 10200, 72, 10170), f"WITH {S.SOURCE_HOURS}, g AS (SELECT unnest(generate_series(10129, 10200)) AS hour), c AS (SELECT hour FROM src WHERE status <> 'missing' GROUP BY hour HAVING count(DISTINCT instrument) >= 1) SELECT hour FROM g ANTI JOIN c USING (hour) ORDER BY hour < 10170 DESC, hour DESC LIMIT 1"),
    "o13_complete_hours": (lambda s, d: O.complete_hours(S.source_hours(s, d), 3), f"WITH {S.SOURCE_HOURS} SELECT hour FROM src WHERE status <> 'missing' GROUP BY hour HAVING count(DISTINCT instrument) = 3"),
    "o14_retention": (lambda s, d: O.retention(S.source_hours(s, d), S.outputs(s, d), 10000), f"WITH {RETAIN} SELECT instrument, decision, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM x GROUP BY ALL"),
    "o15_consistency": (_problems, f"WITH {PROBLEMS} SELECT * FROM pr"),
    "o17_stale_sources": (lambda s, d: O.stale(S.source_records(S.source_hours(s, d)).where("status = 'downloaded'"), ["downloaded_at", "discovered_at"], 10500, 900).select("instrument", "hour", "age"), f"WITH {S.SOURCE_RECORDS} SELECT instrument, hour, 10500 - coalesce(downloaded_at, discovered_at) AS age FROM rec WHERE status = 'downloaded' AND 10500 - coalesce(downloaded_at, discovered_at) > 900"),
    "o19_newest_runs": (lambda s, d: X.duration_summary(O.newest_runs(S.runs(s, d), 500), ["kind", "status"], "seconds"), f"WITH {S.RUNS}, n AS (SELECT kind, status, CAST(greatest(0, ended - started) AS DOUBLE) AS x FROM runs WHERE ended IS NOT NULL ORDER BY started DESC, run_id DESC LIMIT 500) SELECT kind, status, {SUMMARY} FROM n GROUP BY ALL"),
    "o19_latency": (lambda s, d: X.duration_summary(S.source_records(S.source_hours(s, d)).where("downloaded_at IS NOT NULL").withColumn("seconds", (F.col("downloaded_at") - F.col("discovered_at") + F.col("bytes") % 7).cast("double")), ["kind"], "seconds"), f"WITH {S.SOURCE_RECORDS}, n AS (SELECT kind, CAST(downloaded_at - discovered_at + bytes % 7 AS DOUBLE) AS x FROM rec WHERE downloaded_at IS NOT NULL) SELECT kind, {SUMMARY} FROM n GROUP BY ALL"),
    "o20_inventory": (
        lambda s, d: O.inventory({"sources": S.source_hours(s, d), "outputs": S.outputs(s, d)}, {"status": (S.source_hours(s, d), "status"), "quality": (S.market_seconds(s, d), "quality"), "reason": (S.market_seconds(s, d), "reason")}),
        f"WITH {BOTH}, {S.SECONDS} SELECT 'rows of sources' AS what, '' AS value, count(*) AS n FROM src UNION ALL SELECT 'rows of outputs', '', count(*) FROM outp UNION ALL SELECT 'status', status, count(*) FROM src GROUP BY status UNION ALL SELECT 'quality', quality, count(*) FROM seconds GROUP BY quality UNION ALL SELECT 'reason', coalesce(reason, '-'), count(*) FROM seconds GROUP BY reason",
    ),
    "o20_bytes_by_status": (lambda s, d: S.source_hours(s, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), f"WITH {S.SOURCE_HOURS} SELECT status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM src GROUP BY status"),
    "o21_retained_sample": (lambda s, d: O.retained_sample(_problems(s, d), "problem", ["hour", "instrument"], 5), f"WITH {PROBLEMS} SELECT problem, instrument, hour, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY problem) - 5, 0) AS omitted FROM pr WINDOW w AS (PARTITION BY problem ORDER BY hour, instrument) QUALIFY row_number() OVER w <= 5"),
    "o22_preferred": (lambda s, d: O.preferred(S.table(s, d, "orders").where("o_orderstatus <> 'P'").withColumn("created", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "created", "o_orderkey"), "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey"),
}
