"""Book replay as segmented running minima.

A complete snapshot with an update id starts a segment; an update holds if its predecessor is the frontier
before it; a snapshot without an id holds only as an hour's first snapshot over a carried book, whose
frontier it keeps. The book is valid while every event since its segment's start holds. This is computed
within each archive hour with the incoming state unknown, and one row per hour carries state on to the
adjacent next hour, so no window spans a market's whole history of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderlens.operators.events import ARCHIVE, dealt, in_archive
from ladderlens.operators.ladder import structure_counts

OUTCOMES = ("SNAPSHOT_APPLIED", "UPDATE_APPLIED", "SKIPPED_UNINITIALIZED", "DUPLICATE_SKIPPED", "INVALIDATED")
STATES = ("UNINITIALIZED", "SNAPSHOT", "CARRIED", "INVALIDATED")
RESTORED = "market long, hour long, frontier long, restored_epoch long"


def _marks() -> list:
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "side", F.col("price").cast("string"), F.col("qty").cast("string")))), ",")
    both = F.bool_or((F.col("side") == "bid") & (F.col("qty") > 0)) & F.bool_or((F.col("side") == "ask") & (F.col("qty") > 0))
    return [F.sha2(text, 256).alias("signature"), both.alias("complete")]


def signatures(rows: DataFrame) -> DataFrame:
    """Per event a digest of its changes and whether both sides have a positive level."""
    return rows.groupBy("market", "n").agg(*_marks())


def marked_events(changes: DataFrame) -> DataFrame:
    """The events (market, hour, n, t, kind, final_id, prev_id) of level changes with their signature and completeness, in
    one pass; changes that lie together by market and hour stay so."""
    return changes.groupBy(*ARCHIVE, "n", "t", "kind", "final_id", "prev_id").agg(*_marks())


def _over_hours(e: DataFrame, restored: DataFrame | None) -> DataFrame:
    """One row per archive hour with what it takes over: whether a valid book (``carried``), its epoch and the frontier
    (``f_in``), and whether its first update that waits for that frontier follows it (``head``)."""
    waiting = F.when(F.col("waits"), F.struct("n", "prev_id", "final_id", "signature", "duplicate"))
    event = F.struct("n", "kind", "final_id", "signature")
    hours = e.groupBy(*ARCHIVE).agg(F.max("segment").alias("segments"), F.max_by("held", "n").alias("held"), F.max("own_epoch").alias("own"), F.max_by("final_id", F.when(F.col("final_id").isNotNull(), F.col("n"))).alias("last_id"), F.max(waiting).alias("w"), F.min("n").alias("first_n"), F.max(event).alias("end"))
    hours = hours.join(restored, list(ARCHIVE), "left") if restored is not None else hours.withColumns({"frontier": F.lit(None).cast("long"), "restored_epoch": F.lit(None).cast("long")})
    over = Window.partitionBy("market").orderBy("hour")
    follows = F.coalesce(F.lag("hour").over(over) == F.col("hour") - 1, F.lit(False)) & F.col("frontier").isNull()
    hours = hours.withColumns({"follows": follows, "b": F.when(follows, F.lag("end").over(over))}).withColumn("chain", F.count_if(~F.col("follows")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    # the hour's very first event may repeat the last one of the hour before
    again = (F.col("w.n") == F.col("first_n")) & (F.col("b.kind") == "update") & (F.col("w.final_id") == F.col("b.final_id")) & (F.col("w.signature") == F.col("b.signature"))
    hours = hours.withColumn("again", F.coalesce(again, F.lit(False)))
    chain = Window.partitionBy("market", "chain").orderBy("hour")
    until, before = chain.rowsBetween(Window.unboundedPreceding, 0), chain.rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumns({"run": F.count_if(F.col("segments") > 0).over(until), "base": F.first("frontier").over(until), "f_in": F.coalesce(F.last("last_id", ignorenulls=True).over(before), F.first("frontier").over(until)), "out_epoch": F.coalesce(F.last("own", ignorenulls=True).over(until), F.first("restored_epoch").over(until))})
    head = F.when(F.col("w").isNotNull(), F.coalesce((F.col("w.prev_id") == F.col("f_in")) | ((F.col("w.duplicate") | F.col("again")) & (F.col("w.final_id") == F.col("f_in"))), F.lit(False))).otherwise(True)
    hours = hours.withColumn("head", head)
    in_run = Window.partitionBy("market", "chain", "run").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    passes = F.when(F.col("segments") > 0, F.col("held")).otherwise(F.col("held") & F.col("head"))
    hours = hours.withColumn("passes", passes).withColumn("out_valid", F.min("passes").over(in_run) & ((F.col("run") > 0) | F.col("base").isNotNull()))
    return hours.select(*ARCHIVE, "f_in", "head", "again", "first_n", F.coalesce(F.lag("out_valid").over(chain), F.col("frontier").isNotNull()).alias("carried"), F.coalesce(F.lag("out_epoch").over(chain), "restored_epoch").alias("carried_epoch"))


def outcomes(events: DataFrame, marks: DataFrame | None = None, restored: DataFrame | None = None) -> DataFrame:
    """events with ``outcome``, ``valid`` and ``was_valid``, ``epoch`` (the event number of the snapshot that the
    book rests on), ``state`` and the ``issue`` of an invalidated one.

    ``marks`` has signature and complete by (market, n); without it events have them (``marked_events``), and their rows
    are dealt out once, by market and hour: all windows are over these, and what crosses hours comes from one
    row an hour. ``restored`` has (market, hour, frontier, restored_epoch) of hours that begin with the book
    of a checkpoint.
    """
    snapshot, update = F.col("kind") == "snapshot", F.col("kind") == "update"
    e = events.join(dealt(marks), ["market", "n"]) if marks is not None else events
    at = in_archive("n")
    again = update & (F.lag("kind").over(at) == "update") & (F.col("final_id") == F.lag("final_id").over(at)) & (F.col("signature") == F.lag("signature").over(at))
    e = e.withColumns({"duplicate": F.coalesce(again, F.lit(False)), "starts": snapshot & F.col("final_id").isNotNull()})
    until, before = at.rowsBetween(Window.unboundedPreceding, 0), at.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumns({"segment": F.count_if("starts").over(until), "place": F.count_if(snapshot & F.col("final_id").isNull()).over(until), "known": F.last("final_id", ignorenulls=True).over(before), "own_epoch": F.max(F.when(snapshot, F.col("n"))).over(until)})
    e = e.withColumn("waits", update & F.col("known").isNull() & F.col("final_id").isNotNull())
    follows = F.coalesce((F.col("prev_id") == F.col("known")) | (F.col("duplicate") & (F.col("final_id") == F.col("known"))), F.lit(False))
    holds = F.when(F.col("starts"), F.col("complete")).when(snapshot, F.col("complete") & (F.col("segment") == 0) & (F.col("place") == 1)).when(F.col("waits"), True).otherwise(follows & F.col("final_id").isNotNull())
    e = e.withColumns({"holds": F.coalesce(holds, F.lit(False)), "waited": F.max("waits").over(until)})
    e = e.withColumn("held", F.min("holds").over(Window.partitionBy(*ARCHIVE, "segment").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    e = e.join(_over_hours(e, restored), list(ARCHIVE))
    e = e.withColumns({"valid": F.when(F.col("segment") > 0, F.col("held")).otherwise(F.col("carried") & F.col("held") & (~F.col("waited") | F.col("head"))), "duplicate": F.col("duplicate") | (F.col("again") & (F.col("n") == F.col("first_n")))})
    e = e.withColumns({"was_valid": F.when(F.col("n") == F.col("first_n"), F.col("carried")).otherwise(F.lag("valid").over(at)), "rests_on": F.coalesce("own_epoch", "carried_epoch"), "known": F.coalesce("known", "f_in")})
    outcome = F.when(snapshot, F.when(F.col("valid"), OUTCOMES[0]).otherwise(OUTCOMES[4])).when(~F.col("was_valid"), OUTCOMES[2]).when(F.col("valid") & F.col("duplicate"), OUTCOMES[3]).when(F.col("valid"), OUTCOMES[1]).otherwise(OUTCOMES[4])
    state = F.when(F.col("valid"), F.when(F.col("segment") > 0, STATES[1]).otherwise(STATES[2])).when(F.col("rests_on").isNotNull(), STATES[3]).otherwise(STATES[0])
    issue = F.when(snapshot, F.when(F.col("complete"), "frontierless_snapshot").otherwise("incomplete_snapshot")).when(F.col("final_id") == F.col("known"), "conflicting_replayed_update").when(F.col("final_id") < F.col("known"), "update_frontier_regression").otherwise("update_continuity_mismatch")
    kept = [c for c in events.columns if c not in ("signature", "complete")]
    return e.select(*kept, "complete", outcome.alias("outcome"), "valid", "was_valid", F.when(F.col("valid"), F.col("rests_on")).alias("epoch"), state.alias("state"), F.when(outcome == OUTCOMES[4], issue).alias("issue"))


def issues(replayed: DataFrame, keep: int = 100) -> DataFrame:
    """The first ``keep`` invalidations of each archive hour."""
    bad = replayed.where("issue IS NOT NULL").withColumn("number", F.row_number().over(in_archive("n")))
    return bad.where(F.col("number") <= keep).select(*ARCHIVE, "n", "kind", "issue", "number")


def replay_report(replayed: DataFrame) -> DataFrame:
    """Per archive hour: outcomes, recoveries (a snapshot applied while there was no valid book) and the final state."""
    counts = [F.count_if(F.col("outcome") == x).alias(x.lower()) for x in OUTCOMES]
    return replayed.groupBy(*ARCHIVE).agg(F.count("*").alias("n_events"), *counts, F.count_if((F.col("outcome") == OUTCOMES[0]) & ~F.col("was_valid")).alias("recoveries"), F.max_by("valid", "n").alias("finally_valid"), F.max_by("state", "n").alias("final_state"), F.max_by("final_id", "n").alias("last_id"))


def archive_report(replayed: DataFrame, changes: DataFrame) -> DataFrame:
    """``replay_report`` with what each hour's applied changes (market, hour, n, epoch, side, price, qty) did: changes to
    zero, levels removed, and after how many applied events the book had which structure."""
    did = structure_counts(changes)
    counts = [c for c in did.columns if c not in ARCHIVE]
    return replay_report(replayed).join(did, list(ARCHIVE), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def chain_report(report: DataFrame) -> DataFrame:
    """Totals over each run of adjacent hours of a market."""
    over = Window.partitionBy("market").orderBy("hour")
    chained = report.withColumn("new", F.coalesce(F.lag("hour").over(over) != F.col("hour") - 1, F.lit(True))).withColumn("chain", F.count_if("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("market", "chain").agg(F.min("hour").alias("first_hour"), F.count("*").alias("hours"), F.sum("n_events").alias("n_events"), F.sum("invalidated").alias("invalidated"), F.sum("recoveries").alias("recoveries"), F.max_by("finally_valid", "hour").alias("finally_valid"))


def restored(events: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts, levels) for a replay that begins with the books of checkpoints (market, through_hour, last_id,
    side, price, qty): where the very next hour has events, its frontier and epoch, and the levels as changes
    of that epoch. The epoch is the number before the hour's first event."""
    first = events.groupBy(*ARCHIVE).agg(F.min("n").alias("first_n"), F.min("t").alias("first_t"))
    book = stored.withColumn("hour", F.col("through_hour") + 1).join(first, list(ARCHIVE))
    starts = book.groupBy(*ARCHIVE).agg(F.first("last_id").alias("frontier"), (F.first("first_n") - 1).alias("restored_epoch"))
    levels = book.select(*ARCHIVE, (F.col("first_n") - 1).alias("n"), (F.col("first_t") - 1).alias("t"), "side", "price", "qty", (F.col("first_n") - 1).alias("epoch"))
    return starts, levels
