"""Archive files: required columns, layout, row counts, profiles and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOOK_SCHEMA = "received_time long, event_time long, transaction_time long, symbol string, event_type string, first_update_id long, final_update_id long, prev_final_update_id long, last_update_id long, side string, price string, quantity string, order_count long"
TRADE_SCHEMA = "received_time long, event_time long, symbol string, trade_id string, price string, quantity string, trade_time long, is_buyer_maker boolean, order_type string"
LAYOUT = r"([^/]+)/(\d{4}-\d{2}-\d{2})/(\d{2})/([^/]+)_(orderbook|trades)\.parquet$"


#: Partition columns of an archive.
PARTITIONS = ["venue", "hour"]


class ContractError(ValueError):
    """A source lacks required columns or has them in another type."""


def require(df: DataFrame, schema: str) -> DataFrame:
    """df restricted to the required columns; fails before any job if one is absent or of another type."""
    wanted = StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in wanted if have.get(f.name) != f.dataType]
    if wrong:
        raise ContractError(f"missing or of another type: {', '.join(wrong)}")
    return df.select(*wanted.names)


SCHEMAS = {"orderbook": BOOK_SCHEMA, "trades": TRADE_SCHEMA}


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The required columns with the partition columns and the row's place: file and index in it."""
    df = spark.read.parquet(path)
    require(df, schema)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index")]
    return df.select(*StructType.fromDDL(schema).names, *[c for c in PARTITIONS if c in df.columns], *place)


def read_source(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The archive files of one kind of data, each kind in its own folder and schema."""
    if kind not in SCHEMAS:
        raise ContractError(f"unknown kind of data: {kind}")
    return scan(spark, f"{root}/kind={kind}", SCHEMAS[kind])


def write_archive(rows: DataFrame, root: str, kind: str, order: list[str]) -> None:
    """Rows (the kind's columns, venue, hour) as archive files, one for each venue and hour, in ``order``."""
    columns = [*StructType.fromDDL(SCHEMAS[kind]).names, *PARTITIONS]
    dealt = rows.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, *order).select(*columns)
    dealt.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{root}/kind={kind}")


def layout(path: Column) -> Column:
    """Venue, hour start (unix seconds), symbol and kind from a file's place, in any session's zone; a path of another
    form has no start."""
    part = lambda i: F.regexp_extract(path, LAYOUT, i)
    start = F.unix_date(part(2).try_cast("date")).cast("long") * 86400 + part(3).try_cast("long") * 3600
    return F.struct(part(1).alias("venue"), start.alias("start"), part(4).alias("symbol"), part(5).alias("kind"))


def path_of(venue: Column, start: Column, symbol: Column, kind: Column) -> Column:
    """A file's place from its venue, UTC hour start (unix seconds), symbol and kind."""
    day, hour = F.floor(start / 86400), F.floor(F.pmod(start, F.lit(86400)) / 3600)
    date = F.date_from_unix_date(day.cast("int")).cast("string")
    return F.concat(F.concat_ws("/", venue, date, F.lpad(hour.cast("string"), 2, "0"), symbol), F.lit("_"), kind, F.lit(".parquet"))


def reconciled(rows: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose rows read are not those declared, absent ones included."""
    read = rows.groupBy(*keys).agg(F.count("*").alias("read"))
    both = manifest.join(read, keys, "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("read"))).select(*keys, "declared", "read")


def profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, events, snapshots, sides and the id and clock ranges of each file."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("n").alias("events"), F.count_distinct(F.when(F.col("kind") == "snapshot", F.col("n"))).alias("snapshots"), F.count_if(F.col("side") == "bid").alias("bids"), F.count_if(F.col("qty") == 0).alias("removals"), F.min("final_id").alias("least_id"), F.max("final_id").alias("most_id"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def long_rows(bars: DataFrame, series: list[str]) -> DataFrame:
    """One row per bar and series, for a long CSV: empty where a series has no value."""
    return bars.select("bar_start", *[F.col(c).cast("double").alias(c) for c in series]).unpivot(["bar_start"], series, "series", "value")


def export(bars: DataFrame, folder: str, series: list[str], regions: DataFrame | None = None, scores: DataFrame | None = None) -> None:
    """Bars as JSON, structs and all, and as long CSV; outage regions and scores as JSON beside them."""
    for name, table in (("bars", bars), ("regions", regions), ("scores", scores)):
        if table is not None:
            table.write.mode("overwrite").json(f"{folder}/{name}.json")
    long_rows(bars, series).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{folder}/bars.csv")
