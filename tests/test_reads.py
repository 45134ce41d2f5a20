"""Queries over the replayed archive read its raw rows once."""

from __future__ import annotations

import pytest

from ladderlens.plans import registry
from ladderlens.sources import stand_in


@pytest.mark.parametrize("name", ["k3_restored_replay", "t3_stream_restored", "t3_stream_replay", "k5_checkpoint_plan"])
def test_the_archive_is_read_once(spark, smallest, monkeypatch, name):
    read, before = [], stand_in.raw_levels
    monkeypatch.setattr(stand_in, "raw_levels", lambda *x: read.append(x) or before(*x))
    df = registry.QUERIES[name](spark, smallest)
    assert len(read) == 1 and not [x for x in df.inputFiles() if "lineitem" in x]


def test_numbering_does_not_read_the_archive_twice(spark, smallest):
    assert not [x for x in stand_in.changes(spark, smallest).inputFiles() if "lineitem" in x]
