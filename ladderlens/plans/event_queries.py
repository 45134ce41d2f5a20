"""Queries over archive rows and events, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderlens.operators import book as B
from ladderlens.operators import events as E
from ladderlens.operators import replay as R
from ladderlens.operators.ladder import STRUCTURES
from ladderlens.plans.staging import kept
from ladderlens.sources import stand_in as S

EVENT = ["market", "hour", "n"]
KEY = ["t", "kind", "final_id"]
LAGGED = S.EVENTS + ", lagged AS (SELECT *, lag(kind) OVER w AS pk, lag(final_id) OVER w AS pf FROM ev WINDOW w AS (PARTITION BY market ORDER BY n)), inhour AS (SELECT *, lag(kind) OVER w AS pk, lag(final_id) OVER w AS pf FROM ev WINDOW w AS (PARTITION BY market, hour ORDER BY n))"
RELATION = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN 'uncheckable' WHEN {0} < {1} THEN 'regression' WHEN {0} = {1} THEN 'equal' WHEN {0} = {1} + 1 THEN 'increment_by_one' ELSE 'forward_gap' END"
CHECKED = "(kind = 'update' AND pk = 'update')"

COUNTED = ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("zero_changes", "removed", *[y.lower() for y in STRUCTURES], "bid_levels", "ask_levels"))


def replay_sql(ev: str, marks: str, start: str = "(SELECT NULL::BIGINT AS market, NULL::BIGINT AS hour, NULL::BIGINT AS f0, NULL::BIGINT AS e0)", to: str = "replayed") -> str:
    """The replay as windows over whole chains: ev (market, hour, n, t, kind, final_id, prev_id), marks (market,
    n, complete, signature), start (market, hour, f0, e0) of chains that begin with a stored book."""
    return f""" h_{to} AS (SELECT market, hour, f0, e0, count(*) FILTER (new) OVER (PARTITION BY market ORDER BY hour) AS chain FROM (SELECT h.market, h.hour, s.f0, s.e0, s.f0 IS NOT NULL OR coalesce(lag(h.hour) OVER (PARTITION BY h.market ORDER BY h.hour) <> h.hour - 1, true) AS new FROM (SELECT DISTINCT market, hour FROM {ev}) h LEFT JOIN {start} s ON s.market = h.market AND s.hour = h.hour)),
 a_{to} AS (SELECT e.market, e.hour, e.n, e.t, e.kind, e.final_id, e.prev_id, complete, signature, chain, max(f0) OVER (PARTITION BY e.market, chain) AS f0, max(e0) OVER (PARTITION BY e.market, chain) AS e0, kind = 'snapshot' AND final_id IS NOT NULL AS fs, kind = 'snapshot' AND final_id IS NULL AS fls FROM {ev} e JOIN {marks} USING (market, n) JOIN h_{to} h ON h.market = e.market AND h.hour = e.hour),
 b_{to} AS (SELECT *, count(*) FILTER (fs) OVER c AS ep, count(*) FILTER (fs) OVER h AS hep, count(*) FILTER (fls) OVER h AS fl, coalesce(kind = 'update' AND lag(kind) OVER c = 'update' AND final_id = lag(final_id) OVER c AND signature = lag(signature) OVER c, false) AS dup, max(CASE WHEN kind = 'snapshot' THEN n END) OVER c AS own FROM a_{to} WINDOW c AS (PARTITION BY market, chain ORDER BY n), h AS (PARTITION BY market, hour ORDER BY n)),
 c_{to} AS (SELECT *, coalesce(last_value(final_id IGNORE NULLS) OVER (PARTITION BY market, chain, ep ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN ep = 0 THEN f0 END) AS pf FROM b_{to}),
 d_{to} AS (SELECT *, coalesce(CASE WHEN fs THEN complete WHEN fls THEN complete AND hep = 0 AND fl = 1 AND (ep > 0 OR f0 IS NOT NULL) ELSE pf IS NOT NULL AND (prev_id = pf OR (dup AND final_id = pf)) END, false) AS ok FROM c_{to}),
 e_{to} AS (SELECT *, (ep > 0 OR f0 IS NOT NULL) AND bool_and(ok) OVER (PARTITION BY market, chain, ep ORDER BY n) AS valid FROM d_{to}),
 f_{to} AS (SELECT *, coalesce(lag(valid) OVER (PARTITION BY market, chain ORDER BY n), f0 IS NOT NULL) AS was_valid FROM e_{to}),
 g_{to} AS (SELECT *, CASE WHEN kind = 'snapshot' THEN CASE WHEN valid THEN 'SNAPSHOT_APPLIED' ELSE 'INVALIDATED' END WHEN NOT was_valid THEN 'SKIPPED_UNINITIALIZED' WHEN valid AND dup THEN 'DUPLICATE_SKIPPED' WHEN valid THEN 'UPDATE_APPLIED' ELSE 'INVALIDATED' END AS outcome FROM f_{to}),
 {to} AS (SELECT market, hour, n, t, kind, final_id, prev_id, complete, outcome, valid, was_valid, CASE WHEN valid THEN coalesce(own, e0) END AS epoch, CASE WHEN valid AND hep > 0 THEN 'SNAPSHOT' WHEN valid THEN 'CARRIED' WHEN own IS NOT NULL OR e0 IS NOT NULL THEN 'INVALIDATED' ELSE 'UNINITIALIZED' END AS state,
 CASE WHEN outcome = 'INVALIDATED' THEN CASE WHEN kind = 'snapshot' AND complete THEN 'frontierless_snapshot' WHEN kind = 'snapshot' THEN 'incomplete_snapshot' WHEN final_id = pf THEN 'conflicting_replayed_update' WHEN final_id < pf THEN 'update_frontier_regression' ELSE 'update_continuity_mismatch' END END AS issue FROM g_{to})"""


REPLAY = S.CHANGES + ", marks AS (SELECT market, n, bool_or(side = 'bid' AND qty > 0) AND bool_or(side = 'ask' AND qty > 0) AS complete, CAST(n AS VARCHAR) AS signature FROM changes GROUP BY ALL)," + replay_sql("ev", "marks")
RICH = f"{S.CHANGES}, {S.REPLAY_EVENTS},{replay_sql('rich', 'rich_marks')}"
LIVES = "lives AS (SELECT * FROM (SELECT market, epoch, side, price, qty, n AS from_n, lead(n) OVER w AS to_n, t AS from_t, lead(t) OVER w AS to_t FROM vc WINDOW w AS (PARTITION BY market, epoch, side, price ORDER BY n)) WHERE qty > 0)"
RICH_LIVE = f"""{RICH}, {S.RICH_CHANGES}, vc AS (SELECT c.*, r.epoch, r.kind FROM rich_changes c JOIN replayed r USING (market, n) WHERE r.outcome IN ('SNAPSHOT_APPLIED', 'UPDATE_APPLIED')), {LIVES}"""
STRUCTURE = "CASE WHEN bb IS NULL AND ba IS NULL THEN 'EMPTY_BOTH' WHEN bb IS NULL THEN 'EMPTY_BID' WHEN ba IS NULL THEN 'EMPTY_ASK' WHEN bb < ba THEN 'NORMAL' WHEN bb = ba THEN 'LOCKED' ELSE 'CROSSED' END"
DID = f""", tops0 AS (SELECT e.market, e.hour, e.n, max(price) FILTER (side = 'bid') AS bb, min(price) FILTER (side = 'ask') AS ba, count(*) FILTER (side = 'bid') AS bl, count(*) FILTER (side = 'ask') AS al
 FROM (SELECT DISTINCT market, hour, n, epoch FROM vc) e LEFT JOIN lives l ON l.market = e.market AND l.epoch = e.epoch AND e.n >= l.from_n AND (l.to_n IS NULL OR e.n < l.to_n) GROUP BY ALL),
 tops1 AS (SELECT *, {STRUCTURE} AS s FROM tops0), gone AS (SELECT market, hour, count(*) FILTER (qty = 0) AS zero_changes, count(*) FILTER (qty = 0 AND before > 0 AND kind = 'update') AS removed FROM (SELECT *, lag(qty) OVER (PARTITION BY market, epoch, side, price ORDER BY n) AS before FROM vc) GROUP BY ALL),
 did AS (SELECT market, hour, {', '.join(f"count(*) FILTER (s = '{x}') AS {x.lower()}" for x in STRUCTURES)}, arg_max(bl, n) AS bid_levels, arg_max(al, n) AS ask_levels FROM tops1 GROUP BY ALL)"""
REPORT = ", report AS (SELECT market, hour, count(*) AS n_events, count(*) FILTER (outcome = 'SNAPSHOT_APPLIED') AS snapshot_applied, count(*) FILTER (outcome = 'UPDATE_APPLIED') AS update_applied, count(*) FILTER (outcome = 'SKIPPED_UNINITIALIZED') AS skipped_uninitialized, count(*) FILTER (outcome = 'DUPLICATE_SKIPPED') AS duplicate_skipped, count(*) FILTER (outcome = 'INVALIDATED') AS invalidated, count(*) FILTER (outcome = 'SNAPSHOT_APPLIED' AND NOT was_valid) AS recoveries, arg_max(valid, n) AS finally_valid, arg_max(state, n) AS final_state, arg_max_null(final_id, n) AS last_id FROM replayed GROUP BY ALL)"


def replayed(spark, d):
    return R.outcomes(R.marked_events(S.changes(spark, d)))


def rich(spark, d):
    """Every outcome of a replay: see ``S.replay_events``."""
    changes = kept(S.changes(spark, d))
    events = S.replay_events(S.events_of(changes))
    return R.outcomes(events.drop("base", "other"), S.replay_marks(events, R.signatures(changes)))


def rich_report(spark, d):
    changes = kept(S.changes(spark, d))
    events = S.replay_events(S.events_of(changes))
    replayed = kept(R.outcomes(events.drop("base", "other"), S.replay_marks(events, R.signatures(changes))))
    return R.archive_report(replayed, kept(B.valid_changes(S.replay_changes(events, changes), replayed)))


def boundaries(spark, d):
    return E.hour_boundaries(S.book_events(spark, d))


QUERIES = {
    "s1_level_filter": (lambda s, d: S.levels(s, d).where("price >= 2000 AND qty > 0").select("market", "t", "side", "price", "qty"), f"WITH {S.LEVELS} SELECT market, t, side, price, qty FROM levels WHERE price >= 2000 AND qty > 0"),
    "e1_event_grouping": (
        lambda s, d: E.assembled(S.changes(s, d), KEY).select("market", "hour", "event_seq", *KEY, "n_rows", "bid_rows", "ask_rows"),
        f"WITH {S.CHANGES} SELECT market, hour, CAST(row_number() OVER (PARTITION BY market, hour ORDER BY n) AS BIGINT) AS event_seq, t, kind, final_id, count(*) AS n_rows, count(*) FILTER (side = 'bid') AS bid_rows, count(*) FILTER (side = 'ask') AS ask_rows FROM changes GROUP BY market, hour, n, t, kind, final_id",
    ),
    "e2_duplicate_levels": (lambda s, d: E.duplicate_levels(S.raw_levels(s, d), ["market", "t"]), f"WITH {S.RAW_LEVELS} SELECT market, t, side, price, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1"),
    "e3_oversized_events": (lambda s, d: E.oversized_events(S.changes(s, d), EVENT, 12), f"WITH {S.CHANGES} SELECT market, hour, n, count(*) AS n_rows FROM changes GROUP BY market, hour, n HAVING count(*) > 12"),
    "e4_clock_regressions": (
        lambda s, d: E.clock_regressions(S.trades(s, d).withColumns({"day": F.expr("trade_ms div 86400000"), "event_ms": F.expr("trade_ms - trade_id % 3 * 3600000"), "received": F.expr("received_ns + qty * 60000000000")}), ["symbol", "day"], ["trade_ms", "event_ms", "received"], "ordinal", "trade_id"),
        f"WITH {S.TRADES}, y AS (SELECT symbol, ordinal, trade_id, trade_ms // 86400000 AS day, trade_ms, trade_ms - trade_id % 3 * 3600000 AS event_ms, received_ns + qty * 60000000000 AS received FROM trades), x AS (SELECT symbol, day, {', '.join(f'{c} < lag({c}) OVER w AS {c}' for c in ('trade_ms', 'event_ms', 'received'))}, trade_id = lag(trade_id) OVER w AS again FROM y WINDOW w AS (PARTITION BY symbol, day ORDER BY ordinal)) SELECT symbol, day, count(*) AS n_rows, {', '.join(f'count(*) FILTER ({c}) AS {c}_regressions' for c in ('trade_ms', 'event_ms', 'received'))}, count(*) FILTER (again) AS adjacent_duplicates FROM x GROUP BY ALL",
    ),
    "e5_continuity": (lambda s, d: E.continuity(S.book_events(s, d)).where("mismatch").select("market", "hour", "n", "prev_id"), f"WITH {LAGGED} SELECT market, hour, n, prev_id FROM inhour WHERE {CHECKED} AND prev_id <> pf"),
    "e7_read_report": (
        lambda s, d: E.read_report(S.changes(s, d), S.book_events(s, d)),
        f"WITH {LAGGED}, r AS (SELECT market, t // {S.HOUR} AS hour, count(*) AS n_rows FROM levels GROUP BY ALL) SELECT market, hour, n_rows, n_events, updates, snapshots, first_t, last_t, checked, mismatches, regressions FROM r JOIN (SELECT market, hour, count(*) AS n_events, count(*) FILTER (kind = 'update') AS updates, count(*) FILTER (kind = 'snapshot') AS snapshots, min(t) AS first_t, max(t) AS last_t, count(*) FILTER {CHECKED} AS checked, count(*) FILTER ({CHECKED} AND prev_id <> pf) AS mismatches, count(*) FILTER (final_id < pf) AS regressions FROM inhour GROUP BY ALL) USING (market, hour)",
    ),
    "e8_first_issues": (lambda s, d: E.first_issues(S.book_events(s, d), 1), f"WITH {LAGGED}, i AS (SELECT market, hour, n, prev_id, row_number() OVER (PARTITION BY market, hour ORDER BY n) AS issue FROM inhour WHERE {CHECKED} AND prev_id <> pf) SELECT * FROM i WHERE issue <= 1"),
    "e9_replay_outcomes": (replayed, f"WITH {REPLAY} SELECT * FROM replayed"),
    "e10_issue_kinds": (lambda s, d: R.issues(rich(s, d), 5), f"WITH {RICH} SELECT market, hour, n, kind, issue, row_number() OVER w AS number FROM replayed WHERE issue IS NOT NULL WINDOW w AS (PARTITION BY market, hour ORDER BY n) QUALIFY row_number() OVER w <= 5"),
    "e11_duplicate_updates": (lambda s, d: rich(s, d).where("kind = 'update'").groupBy("market", "outcome", F.col("issue")).agg(F.count("*").alias("n")), f"WITH {RICH} SELECT market, outcome, issue, count(*) AS n FROM replayed WHERE kind = 'update' GROUP BY ALL"),
    "e13_frontierless_snapshots": (lambda s, d: rich(s, d).where("kind = 'snapshot' AND final_id IS NULL").select("market", "hour", "n", "outcome", "state", "epoch", "issue"), f"WITH {RICH} SELECT market, hour, n, outcome, state, epoch, issue FROM replayed WHERE kind = 'snapshot' AND final_id IS NULL"),
    "e14_carried_books": (lambda s, d: rich(s, d).groupBy("market", "hour", "state").agg(F.count("*").alias("events"), F.min("n").alias("first_n")), f"WITH {RICH} SELECT market, hour, state, count(*) AS events, min(n) AS first_n FROM replayed GROUP BY ALL"),
    "e12_snapshot_completeness": (lambda s, d: R.signatures(S.changes(s, d)).join(S.book_events(s, d), ["market", "n"]).where("kind = 'snapshot'").groupBy("market", "complete").agg(F.count("*").alias("snapshots")), f"WITH {REPLAY} SELECT market, complete, count(*) AS snapshots FROM replayed WHERE kind = 'snapshot' GROUP BY ALL"),
    "e15_replay_report": (rich_report, f"WITH {RICH_LIVE}{REPORT}{DID} SELECT report.*, {COUNTED} FROM report LEFT JOIN did USING (market, hour) LEFT JOIN gone USING (market, hour)"),
    "e16_chain_report": (
        lambda s, d: R.chain_report(R.replay_report(rich(s, d))),
        f"WITH {RICH}{REPORT}, c AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY market ORDER BY hour) AS chain FROM (SELECT *, coalesce(lag(hour) OVER (PARTITION BY market ORDER BY hour) <> hour - 1, true) AS new FROM report)) SELECT market, chain, min(hour) AS first_hour, count(*) AS hours, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(invalidated) AS BIGINT) AS invalidated, CAST(sum(recoveries) AS BIGINT) AS recoveries, arg_max(finally_valid, hour) AS finally_valid FROM c GROUP BY ALL",
    ),
    "q2_update_relations": (lambda s, d: E.update_relations(S.book_events(s, d)), f"WITH {LAGGED} SELECT market, {RELATION.format('final_id', 'pf')} AS final_relation, {RELATION.format('prev_id', 'pf')} AS predecessor_relation, count(*) AS n FROM lagged WHERE {CHECKED} GROUP BY ALL"),
    "q3_snapshot_relations": (lambda s, d: E.snapshot_relations(S.book_events(s, d)), f"WITH {LAGGED} SELECT market, {RELATION.format('prev_id', 'pf')} AS predecessor_relation, count(*) AS n FROM lagged WHERE kind = 'update' AND pk = 'snapshot' GROUP BY ALL"),
    "q4_hour_boundaries": (
        boundaries,
        f"WITH {S.EVENTS}, x AS (SELECT market, hour, arg_max(final_id, n) AS last_id, arg_min(prev_id, n) AS first_prev, arg_min(prev_id, n) FILTER (kind = 'update') AS fup FROM ev GROUP BY ALL) SELECT a.market, a.hour, a.last_id, b.first_prev AS next_prev, b.fup AS next_update_prev, {RELATION.format('b.first_prev', 'a.last_id')} AS event_relation, {RELATION.format('b.fup', 'a.last_id')} AS update_relation FROM x a JOIN x b ON a.market = b.market AND b.hour = a.hour + 1",
    ),
    "q5_presence_patterns": (
        lambda s, d: E.presence_patterns(E.with_previous(S.book_events(s, d), "final_id"), ["prev_id", "previous_final_id"], ["market", "kind"]),
        f"WITH {LAGGED} SELECT market, kind, (CASE WHEN prev_id IS NULL THEN '-' ELSE '+' END) || (CASE WHEN pf IS NULL THEN '-' ELSE '+' END) AS pattern, count(*) AS n FROM lagged GROUP BY ALL",
    ),
    "q6_null_profile": (lambda s, d: E.null_profile(S.market_seconds(s, d), ["bid", "ask", "reason"]), f"WITH {S.SECONDS} SELECT c AS column_name, n AS nulls, round(100.0 * n / t, 6) AS null_pct FROM (SELECT count(*) AS t, count(*) - count(bid) AS b, count(*) - count(ask) AS a, count(*) - count(reason) AS r FROM seconds) x, LATERAL (VALUES ('bid', x.b), ('ask', x.a), ('reason', x.r)) v(c, n)"),
    "q7_id_ranges": (lambda s, d: E.id_ranges(S.book_events(s, d)), f"WITH {LAGGED} SELECT market, count(*) AS n, min(final_id) AS least, max(final_id) AS most, arg_min(final_id, n) AS first_id, arg_max(final_id, n) AS last_id, count(*) FILTER (final_id - pf = 1) AS plus_one, count(*) FILTER (final_id - pf <> 1) AS other_steps FROM lagged GROUP BY market"),
    "q8_predecessor_matches": (lambda s, d: E.predecessor_matches(S.book_events(s, d)), f"WITH {LAGGED} SELECT market, kind, count(*) AS n, count(*) FILTER (prev_id = pf) AS matches FROM lagged WHERE pf IS NOT NULL GROUP BY ALL"),
    "q7_id_steps": (lambda s, d: E.id_steps(S.replay_events(S.book_events(s, d))), f"WITH {RICH}, x AS (SELECT market, hour, final_id, lag(final_id) OVER (PARTITION BY market ORDER BY n) AS f, lag(hour) OVER (PARTITION BY market ORDER BY n) AS h FROM rich) SELECT market, final_id - f AS step, count(*) AS n FROM x WHERE f IS NOT NULL AND hour - h <= 1 GROUP BY ALL"),
    "q9_event_shapes": (
        lambda s, d: E.event_shapes(S.raw_levels(s, d).withColumn("qty", F.expr("CASE WHEN price % 350 = 0 THEN NULL ELSE qty END")), ["market", "t"]),
        f"WITH {S.RAW_LEVELS}, l AS (SELECT market, t, side, price, count(*) AS n, count(*) FILTER (price % 350 <> 0 AND qty > 0) AS p, count(*) FILTER (price % 350 <> 0 AND qty = 0) AS z, count(*) FILTER (price % 350 = 0) AS b FROM raw GROUP BY ALL) SELECT market, t, CAST(coalesce(sum(n) FILTER (side = 'bid'), 0) AS BIGINT) AS bid_rows, CAST(coalesce(sum(n) FILTER (side = 'ask'), 0) AS BIGINT) AS ask_rows, CAST(sum(p) AS BIGINT) AS positive_rows, CAST(sum(z) AS BIGINT) AS zero_rows, CAST(sum(b) AS BIGINT) AS malformed_rows, count(*) FILTER (n > 1) AS repeated_levels, coalesce(sum(p) FILTER (side = 'bid'), 0) > 0 AND coalesce(sum(p) FILTER (side = 'ask'), 0) > 0 AS complete FROM l GROUP BY market, t",
    ),
    "q10_first_last_events": (lambda s, d: E.ends(S.book_events(s, d), 2).select(*EVENT, "from_start", "from_end", "of_kind"), f"WITH {S.EVENTS} SELECT market, hour, n, row_number() OVER (PARTITION BY market, hour ORDER BY n) AS from_start, row_number() OVER (PARTITION BY market, hour ORDER BY n DESC) AS from_end, row_number() OVER (PARTITION BY market, hour, kind ORDER BY n) AS of_kind FROM ev QUALIFY from_start <= 2 OR from_end <= 2 OR of_kind <= 2"),
    "q11_snapshot_presence": (lambda s, d: S.book_events(s, d).groupBy("market", "hour").agg(F.count_if(F.col("kind") == "snapshot").alias("snapshots")), f"WITH {S.EVENTS} SELECT market, hour, count(*) FILTER (kind = 'snapshot') AS snapshots FROM ev GROUP BY ALL"),
    "q12_kind_counts": (lambda s, d: E.kind_counts(S.changes(s, d)), f"WITH {S.CHANGES} SELECT market, hour, kind, count(*) AS n_rows, count(DISTINCT n) AS n_events FROM changes GROUP BY ALL"),
}
