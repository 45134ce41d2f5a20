"""Rows of which there is one an event or more do not go whole through the driver."""

from __future__ import annotations

import re

import pytest

from ladderlens.operators import book, replay
from ladderlens.plans.staging import kept
from ladderlens.sources import stand_in
from ladderlens.streaming import stateful


@pytest.fixture(scope="module")
def tables(spark, smallest):
    changes = kept(stand_in.changes(spark, smallest))
    events = stand_in.replay_events(stand_in.events_of(changes))
    return changes, events


def joins(df) -> list[str]:
    return re.findall(r"(\w+Join)", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])


def test_changes_of_events_are_dealt_out(tables):
    changes, events = tables
    assert set(joins(stand_in.replay_changes(events, changes))) == {"SortMergeJoin"}
    assert set(joins(stateful.with_changes(stand_in.events_of(changes), changes))) == {"SortMergeJoin"}


def test_marks_of_events_are_dealt_out(tables):
    changes, events = tables
    marks = stand_in.replay_marks(events, replay.signatures(changes))
    assert set(joins(marks)) == {"SortMergeJoin"}
    assert set(joins(replay.outcomes(events.drop("base", "other"), marks))) == {"SortMergeJoin"}


def test_applied_events_are_dealt_out(tables):
    changes, events = tables
    replayed = kept(replay.outcomes(events.drop("base", "other"), stand_in.replay_marks(events, replay.signatures(changes))))
    assert set(joins(book.valid_changes(changes, replayed))) == {"SortMergeJoin"}
