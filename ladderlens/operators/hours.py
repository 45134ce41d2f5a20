"""Compact hours: the seconds of an hour packed in one row, and back; idempotent writes."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of stored hours that a write filters by; more of them are read without a filter.
MOST_BLOCKS = 1000
QUALITY_CODES = {"VALID": 0, "DEGRADED": 1, "INVALID": 2}


def packed(seconds: DataFrame, keys: list[str], hour: int, columns: list[str]) -> DataFrame:
    """One row per key and hour with its slots in order and a digest of their content: of each slot ``columns``, the
    quality, and its reason and source count where seconds have them."""
    columns = [*columns, *[c for c in ("reason", "source_count") if c in seconds.columns and c not in columns]]
    code = F.create_map(*[x for k, v in QUALITY_CODES.items() for x in (F.lit(k), F.lit(v))])[F.col("quality")]
    slot = F.struct((F.col("ts") % hour).alias("idx"), *[F.col(c) for c in columns], code.alias("code"))
    out = seconds.groupBy(*keys, F.expr(f"ts div {hour}").alias("hour")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    return out.withColumn("content_sha256", digest())


def digest():
    return F.sha2(F.array_join(F.transform("slots", lambda s: F.to_json(s)), "\n"), 256)


def unpacked(hours: DataFrame, keys: list[str], hour: int) -> DataFrame:
    names = F.create_map(*[x for k, v in QUALITY_CODES.items() for x in (F.lit(v), F.lit(k))])
    rows = hours.select(*keys, "hour", F.inline("slots"))
    return rows.withColumns({"ts": F.col("hour") * hour + F.col("idx"), "quality": names[F.col("code")]}).drop("idx", "code", "hour")


def verified(hours: DataFrame, expected: int) -> DataFrame:
    """Status of each hour: ok, corrupt (digest), incomplete, or inconsistent (a valid slot without values)."""
    bad = F.exists("slots", lambda s: (s["code"] != 2) & s["bid"].isNull())
    return hours.withColumn("state", F.when(F.col("content_sha256") != digest(), "corrupt").when(bad, "inconsistent").when(F.size("slots") != expected, "incomplete").otherwise("ok"))


class HourConflict(ValueError):
    """An hour comes with the same key and other content."""


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that nobody has made yet; false, and nothing done, if somebody has. One of several
    writers wins: by an exclusive creation on a local or mounted file system, by the name node's on HDFS. An
    object store needs a connector whose creation without overwriting is exclusive."""
    fs, at = _file_system(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            handle = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as out:
            out.write(text)
        return True
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001
        if "AlreadyExists" in str(e) or fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a store in order: number, data folder, blocks."""
    fs, at = _file_system(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    found = []
    for n in range(1, len(fs.listStatus(at)) + 1):
        row = spark.read.schema("folder string, blocks array<long>").option("multiLine", True).json(f"{path}/commits/{n:010d}.json").first()
        if row is None or row["folder"] is None:
            break  # its writer is just writing it
        found.append({"number": n, **row.asDict()})
    return found


def _stored(spark: SparkSession, path: str, log: list[dict], within: Callable[[int], bool]) -> DataFrame | None:
    """The rows of the commits that have a block ``within``."""
    folders = [f"{path}/data/{c['folder']}" for c in log if any(map(within, c["blocks"]))]
    return reduce(DataFrame.unionByName, [spark.read.parquet(f) for f in folders]) if folders else None


def write_hours(new: DataFrame, path: str, keys: list[str], block: int = 24 * 30) -> int:
    """Add hours that are not stored yet, partitioned by blocks of ``block`` hours; equal ones are skipped, and any
    other content under a stored key, or twice under one key of ``new``, is an error before anything is visible.
    Returns how many rows were added. Only the blocks that the new hours are in are read, and of them
    only keys and digests.

    Any number of writers: data goes to a folder of its own, which nobody reads until a numbered commit
    names it. Numbers are taken exclusively (``put_if_absent``); who finds the next one taken looks at what
    that commit has brought and tries again, so of two writers of one hour the second skips or fails. A
    writer that dies leaves a folder that no commit names.
    """
    spark = new.sparkSession
    new = new.withColumn("block", F.expr(f"hour div {block}")).persist()
    try:
        if (n := new.groupBy(*keys).agg(F.count_distinct("content_sha256").alias("n")).where("n > 1").count()) > 0:
            raise HourConflict(f"{n} hours come with two contents")
        blocks = sorted(r["block"] for r in new.select("block").distinct().toLocalIterator())
        one = new.dropDuplicates(keys)
        while True:
            log, mine = commits(spark, path), set(blocks)
            stored, absent = _stored(spark, path, log, mine.__contains__), one
            if stored is not None:
                known = stored.where(F.col("block").isin(blocks) if len(blocks) <= MOST_BLOCKS else F.lit(True)).select(*keys, F.col("content_sha256").alias("stored_sha256"))
                both = one.join(known, keys, "left")
                if (n := both.where("content_sha256 <> stored_sha256").count()) > 0:
                    raise HourConflict(f"{n} hours are stored with other content")
                absent = both.where("stored_sha256 IS NULL").drop("stored_sha256")
            count = absent.count()
            if not count:
                return 0
            folder = uuid.uuid4().hex
            absent.write.partitionBy("block").parquet(f"{path}/data/{folder}")
            if put_if_absent(spark, f"{path}/commits/{len(log) + 1:010d}.json", json.dumps({"folder": folder, "blocks": blocks})):
                return count
            fs, at = _file_system(spark, f"{path}/data/{folder}")
            fs.delete(at, True)  # ours, and named by no commit
    finally:
        new.unpersist()


def read_hours(spark: SparkSession, path: str, start: int, end: int, block: int = 24 * 30) -> DataFrame:
    """Committed hours of [start, end): only the commits and blocks that it touches are read."""
    first, last = start // block, (end - 1) // block
    log = commits(spark, path)
    hours = _stored(spark, path, log, lambda b: first <= b <= last)
    if hours is None:
        if not log:
            raise FileNotFoundError(f"nothing is stored at {path}")
        hours = spark.read.parquet(f"{path}/data/{log[0]['folder']}")
    return hours.where(F.col("block").between(first, last) & (F.col("hour") >= start) & (F.col("hour") < end)).drop("block")
