"""Scalars in sessions of other zones, digests that can't collide, and several writers of one hour."""

from __future__ import annotations

import datetime as dt
import threading
from contextlib import contextmanager
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from ladderlens.functions import scalar
from ladderlens.operators import contracts, hours
from ladderlens.sources import archive

KOLKATA = "Asia/Kolkata"


@contextmanager
def session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def civil(text):
    return F.timestamp_seconds(F.lit(int(dt.datetime.fromisoformat(f"{text}+00:00").timestamp())))


@pytest.mark.parametrize("session", ["UTC", KOLKATA, "Australia/Lord_Howe"])
def test_civil_times_of_every_zone_rule(spark, session):
    """Half-hour transitions, whole hours, a skipped day, and none; checked against the zones' own rules."""
    cases = [("Australia/Lord_Howe", "2024-04-07T01:"), ("Australia/Lord_Howe", "2024-10-06T02:"), ("Europe/Berlin", "2024-03-31T02:"), ("Europe/Berlin", "2024-10-27T02:"), ("America/Sao_Paulo", "2018-11-04T00:"), ("Pacific/Apia", "2011-12-30T12:"), (KOLKATA, "2024-05-05T12:")]
    with session_zone(spark, session):
        for zone, hour in cases:
            texts = [f"{hour}{m:02d}:00" for m in (0, 15, 29, 30, 45, 59)]
            row = spark.range(1).select(*[c for t in texts for utc, problem in (scalar.local_to_utc(civil(t), zone),) for c in (F.unix_seconds(utc), problem)]).first()
            for i, text in enumerate(texts):
                naive, z = dt.datetime.fromisoformat(text), ZoneInfo(zone)
                found = sorted({u for fold in (0, 1) for u in [naive.replace(tzinfo=z, fold=fold).astimezone(dt.timezone.utc)] if u.astimezone(z).replace(tzinfo=None) == naive})
                want = (int(found[0].timestamp()), None) if len(found) == 1 else (None, "ambiguous" if found else "nonexistent")
                assert (row[2 * i], row[2 * i + 1]) == want, (zone, text)


def test_nothing_depends_on_the_session_zone(spark):
    at = F.timestamp_micros(F.lit(1_704_069_000_123_456))
    path = archive.path_of(F.lit("okx"), F.lit(1_704_067_200), F.lit("S"), F.lit("trades"))
    for zone in ("UTC", KOLKATA, "America/New_York"):
        with session_zone(spark, zone):
            row = spark.range(1).select(*[F.unix_micros(scalar.floored(at, x)) for x in ("second", "minute", "hour")], scalar.exact_json({"at": F.timestamp_seconds(F.lit(1_704_067_200)), "none": F.lit(None).cast("timestamp"), "d": F.lit("1.10").cast("decimal(4,2)"), 'a"b': F.lit('x"y')}), path, archive.layout(path)["start"], archive.layout(F.lit("elsewhere"))["start"]).first()
        assert tuple(row) == (1_704_069_000_000_000, 1_704_069_000_000_000, 1_704_067_200_000_000, '{"at":"2024-01-01T00:00:00.000000Z","none":null,"d":"1.10","a\\"b":"x\\"y"}', "okx/2024-01-01/00/S_trades.parquet", 1_704_067_200, None), zone


def test_identities_tell_parts_apart(spark):
    parts = [("a\n=b", "c"), ("a", "b\n=c"), ("a", None), ("a", ""), (None, "a"), ("", "a"), ("-", "a"), ("1:a,", ""), ("a,1:", "")]
    rows = spark.createDataFrame(parts, "x string, y string")
    assert rows.select(scalar.identity(F.col("x"), F.col("y"))).distinct().count() == len(parts)
    sets = {"one": ["a\nb"], "two": ["a", "b"], "three": ["b", "a"], "none": ["a", None], "twice": ["a", "a"], "once": ["a"]}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v string").groupBy("k").agg(scalar.input_identity(F.col("v"))).collect()}
    assert got["two"] == got["three"] and len(set(got.values())) == len(sets) - 1


def test_event_time_stands_in_for_one_venue_alone(spark):
    e = spark.createDataFrame([(v, "snapshot", 7, None, 1, 0, 0) for v in ("binance", "bybit", "okx")], "venue string, kind string, event_time long, transaction_time long, final_id long, prev_final_id long, last_id long")
    assert {r["venue"]: r["transaction_time"] for r in contracts.under_contract(e, contracts.contracts(spark)).collect()} == {"binance": 7, "bybit": None, "okx": None}


def packed(spark, hour, bid, market=0):
    s = spark.createDataFrame([(market, hour * 3600 + i, bid, 2, "VALID", None, 3) for i in range(3)] + [(market, hour * 3600 + 3, None, None, "INVALID", "locked", 0)], "market long, ts long, bid long, ask long, quality string, reason string, source_count int")
    return hours.packed(s, ["market"], 3600, ["bid", "ask"])


def test_hours_keep_reasons_and_source_counts(spark, tmp_path):
    path = str(tmp_path / "h")
    assert hours.write_hours(packed(spark, 5, 1), path, ["market", "hour"], 10) == 1
    got = {(r["ts"] % 3600, r["reason"], r["source_count"]) for r in hours.unpacked(hours.read_hours(spark, path, 0, 9, 10), ["market"], 3600).collect()}
    assert got == {(0, None, 3), (1, None, 3), (2, None, 3), (3, "locked", 0)}


@pytest.mark.parametrize("second", [1, 9])
def test_a_writer_that_comes_between(spark, tmp_path, monkeypatch, second):
    """Another writer commits the same hour after the first has looked and before it commits: with equal content the first
    adds only what is still absent, with other content it fails, and nothing of it is visible."""
    path, keys, real, calls = str(tmp_path / "h"), ["market", "hour"], hours.put_if_absent, []

    def between(spark_, name, text):
        if not calls:
            calls.append(1)
            assert hours.write_hours(packed(spark, 5, second), path, keys, 10) == 1
        return real(spark_, name, text)

    monkeypatch.setattr(hours, "put_if_absent", between)
    mine = packed(spark, 5, 1).union(packed(spark, 6, 1))
    if second == 1:
        assert hours.write_hours(mine, path, keys, 10) == 1
        assert sorted(r["hour"] for r in hours.read_hours(spark, path, 0, 9, 10).collect()) == [5, 6]
    else:
        with pytest.raises(hours.HourConflict):
            hours.write_hours(mine, path, keys, 10)
        assert [r["hour"] for r in hours.read_hours(spark, path, 0, 9, 10).collect()] == [5]
    assert len(list((tmp_path / "h" / "data").iterdir())) == len(hours.commits(spark, path))


def test_writers_at_once(spark, tmp_path):
    path, told = str(tmp_path / "h"), []

    def write(i):
        try:
            told.append(hours.write_hours(packed(spark, 5, 1).union(packed(spark, 10 + i, 1)).union(packed(spark, 7, i)), path, ["market", "hour"], 10))
        except hours.HourConflict:
            told.append("conflict")

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join(180) for t in threads]
    assert sorted(map(str, told)) == ["3", "conflict", "conflict"]
    assert hours.read_hours(spark, path, 0, 100, 10).count() == 3


def test_two_contents_of_one_key_are_not_written(spark, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(hours.HourConflict, match="two contents"):
        hours.write_hours(packed(spark, 5, 1).union(packed(spark, 5, 2)), path, ["market", "hour"])
    with pytest.raises(FileNotFoundError):
        hours.read_hours(spark, path, 0, 9)
    assert hours.write_hours(packed(spark, 5, 1).union(packed(spark, 5, 1)), path, ["market", "hour"]) == 1
