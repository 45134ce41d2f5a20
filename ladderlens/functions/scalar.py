"""Scalar helpers on columns: civil time, unix time, canonical text and digests."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


DAY_US = 86_400_000_000
UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}


def _offset(utc_us: Column, zone: str) -> Column:
    """Microseconds that the zone is ahead at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def local_to_utc(local: Column, zone: str) -> tuple[Column, Column]:
    """(UTC timestamp, problem) of a civil timestamp: ``nonexistent`` in a gap, ``ambiguous`` in an overlap.

    A civil time is what the offset of a day earlier or of a day later makes of it, where that offset holds
    there too: with both there are two such instants, in a gap there is none, however long the zone's
    transition shifts its clocks. Transitions lie more than two days apart in every zone that has any.
    """
    us = F.unix_micros(local)
    near = F.unix_micros(F.to_utc_timestamp(local, zone))
    first, second = us - _offset(near - DAY_US, zone), us - _offset(near + DAY_US, zone)
    holds = [x + _offset(x, zone) == us for x in (first, second)]
    problem = F.when(~holds[0] & ~holds[1], "nonexistent").when(holds[0] & holds[1] & (first != second), "ambiguous")
    return F.when(problem.isNull(), F.timestamp_micros(F.when(holds[0], first).otherwise(second))), problem


def utc_to_local(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def unix_seconds_of(value: Column) -> Column:
    """Whole seconds of a unix time whose size tells its unit: ns from 1e17, us from 1e14, ms from 1e11, else s."""
    size = F.abs(value)
    divisor = F.when(size >= 10**17, F.lit(10**9)).when(size >= 10**14, F.lit(10**6)).when(size >= 10**11, F.lit(10**3)).otherwise(F.lit(1))
    return F.floor(value / divisor).cast("long")


def canonical_fraction(value: Column, digits: int = 8) -> Column:
    """Decimal text without an exponent or trailing zeros."""
    text = value.cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def framed(part: Column) -> Column:
    """A part's text behind its length, so that parts in a row can't be read in two ways; null is neither empty nor a text."""
    text = part.cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text, F.lit(",")), F.lit("-,"))


def identity(*parts: Column) -> Column:
    """A digest of ordered parts: different for different parts, null and empty ones too."""
    return F.sha2(F.concat(*[framed(p) for p in parts]), 256)


def input_identity(rows_text: Column) -> Column:
    """A digest of a set of rows, whatever their order: different for different rows; null rows count as such."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(framed(rows_text))), ""), 256)


def floored(at: Column, unit: str) -> Column:
    """A timestamp down to its second, minute or hour of UTC, in any session's zone."""
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    us = F.unix_micros(at)
    return F.timestamp_micros(us - F.pmod(us, F.lit(UNITS[unit])))


def multiplied(a: Column, b: Column) -> Column:
    """The exact product of two decimals of 8 digits: 16 digits."""
    return a.cast("decimal(18,8)") * b.cast("decimal(18,8)")


def added(a: Column, b: Column) -> Column:
    return a.cast("decimal(18,8)") + b.cast("decimal(18,8)")


def subtracted(a: Column, b: Column) -> Column:
    return a.cast("decimal(18,8)") - b.cast("decimal(18,8)")


JSON_TIMES = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def exact_json(fields: dict[str, Column]) -> Column:
    """A JSON object whose decimals are text with all their digits and whose times are UTC with microseconds, in
    any session's zone; null fields stay, as null."""
    text = []
    for n, c in fields.items():
        kind = F.typeof(c)
        written = F.to_json(F.array(F.struct(c.alias("v"))), JSON_TIMES)  # [{"v":...}]
        time = F.substring(written, 7, F.length(written) - 8)
        quoted, plain = F.to_json(F.array(c.cast("string"))), kind.isin("bigint", "int", "smallint", "boolean")
        value = F.when(c.isNull(), "null").when(kind.startswith("timestamp"), time).when(plain, c.cast("string")).otherwise(F.substring(quoted, 2, F.length(quoted) - 2))
        text.append(F.concat(F.lit(f'{json.dumps(n, ensure_ascii=False)}:'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *text), F.lit("}"))
