"""Texts kept by partition in the shared folder, so that later passes bring rows to the texts.

A pass over the texts that needs what a shuffle found out would otherwise shuffle the texts too. Here
each task writes its partition to one file, and a later pass sends rows to the file's number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.llm.common import BLOCK_BYTES, text_blocks
from ladderlens.llm.records import _store

#: Stands for a null id: larger than all others.
NO_ID = (1 << 63) - 1
Blocks = Iterator[tuple[pa.RecordBatch, list[bytes]]]


def _file(folder: str, part: int) -> tuple:
    store, base = _store(folder)
    return store, f"{base}/part-{part:06d}.parquet"


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], dtype=np.int64)


def write_parts(docs: DataFrame, folder: str, work: Callable[[int, Blocks], Iterator[pa.RecordBatch]], schema: str, about: Callable[[list[bytes]], dict[str, pa.Array]] | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """Write docs (doc_id, text; null text: empty) by partition, with the columns that ``about`` makes of a
    block of texts, and return what ``work(part, blocks)`` yields. A task writes under its attempt's name
    and renames, so an attempt that is lost leaves nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        store, name = _file(folder, part)

        def written() -> Blocks:
            out = None
            for batch, texts in text_blocks(batches, size=size):
                rows = pa.table({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.binary())} | (about(texts) if about else {}))
                if out is None:
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(f"{name}.{context.taskAttemptId()}")
                    out = pq.ParquetWriter(sink, rows.schema, compression="zstd", use_dictionary=False)
                out.write_table(rows)
                yield batch, texts
            if out is not None:
                out.close(), sink.close()
                store.move(f"{name}.{context.taskAttemptId()}", name)

        yield from work(part, written())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def written_parts(folder: str) -> int:
    """One more than the largest number of a part that was written; 0 if there is none."""
    from pyarrow import fs

    store, base = _store(folder)
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]
    return 1 + max((int(x[5:11]) for x in names if x.startswith("part-") and x.endswith(".parquet")), default=-1)


def table_of(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Columns of the parts that were written, with ``part``, without the texts."""
    number = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int").alias("part")
    return spark.read.schema(schema).parquet(f"{folder}/part-*.parquet").select("*", number)


def over_parts(rows: DataFrame, parts: int, folder: str, work: Callable[[int, pa.Table, Blocks], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work(part, rows, blocks)`` for every part that rows name: the rows with its number in ``part``, and its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        numbers = table.column("part").to_numpy()
        for part in np.unique(numbers).tolist():
            store, name = _file(folder, part)
            with store.open_input_file(name) as source:
                yield from work(part, table.filter(pa.array(numbers == part)), text_blocks(pq.ParquetFile(source).iter_batches(256, columns=["doc_id", "text"])))

    return rows.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def _saved(folder: str, name: str, part: int) -> tuple:
    store, base = _store(folder)
    return store, f"{base}/{name}-{part:06d}.parquet"


def keep_rows(folder: str, name: str, part: int, rows: pa.Table) -> None:
    """In a task: write rows that a later pass over the same part needs. An attempt that is lost leaves nothing."""
    (store, path), attempt = _saved(folder, name, part), TaskContext.get().taskAttemptId()
    with store.open_output_stream(f"{path}.{attempt}") as sink:
        pq.write_table(rows, sink, compression="zstd", use_dictionary=False)
    store.move(f"{path}.{attempt}", path)


def save_rows(rows: DataFrame, parts: int, folder: str, name: str) -> int:
    """Write rows (with ``part``) to one file a part, for passes that need them more than once; returns their number."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        numbers = table.column("part").to_numpy()
        for part in np.unique(numbers).tolist():
            keep_rows(folder, name, part, table.filter(pa.array(numbers == part)).drop_columns(["part"]))
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64())], names=["n"])

    return rows.select(*columns).repartitionById(parts, F.col("part")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def over_saved(spark, parts: int, folder: str, names: list[str], work: Callable[[int, dict[str, pa.Table | None], Blocks], Iterator[pa.RecordBatch]], schema: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Run ``work(part, saved, blocks)`` for every part: its saved rows by name (None: it has none), and its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def read(store, path: str):
            return None if store.get_file_info(path).type == fs.FileType.NotFound else store.open_input_file(path)

        for batch in batches:
            for part in batch.column("id").to_pylist():
                source = read(*_file(folder, part))
                if source is None:
                    continue  # a partition without documents
                saved = {}
                for name in names:
                    rows = read(*_saved(folder, name, part))
                    saved[name] = pq.read_table(rows) if rows is not None else None
                with source:
                    yield from work(part, saved, text_blocks(pq.ParquetFile(source).iter_batches(256, columns=["doc_id", "text"]), size=size))

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)
