"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.paths import fresh_path, shared_dir

#: What empties the tables that an operator keeps between a worker's tasks, and whose task the worker ran last.
TABLES: dict[str, Callable[[], None]] = {}
_last = [""]


def begin_task(owner: str) -> None:
    """Empty other operators' tables: a worker goes on from one stage to the next and would hold all of them."""
    if _last[0] not in ("", owner):
        for name, clear in TABLES.items():
            if name != owner:
                clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass
    _last[0] = owner


#: Rows and bytes of a batch that goes to a Python worker: a task holds a few at a time, in the JVM and in the worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Set this session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES at most."""
    for key, least in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(least))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of frames that nothing holds any more.

    It works from garbage collections of the driver, which a long loop of small jobs may not bring about by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts_of(column: pa.Array, batch: int = 512) -> Iterator[str | None]:
    """The strings of an Arrow column, made a few at a time."""
    for at in range(0, len(column), batch):
        yield from column.slice(at, batch).to_pylist()


def map_rows(df: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, setup: Callable[[], Callable[..., Iterable[tuple]]], batch: int = 512) -> DataFrame:
    """Arrow map of some columns of df: setup() runs once per task and returns f(*column values) -> rows of the output.

    Output batches are cut at `batch` rows, so memory follows a few rows and not the partition.
    """

    owner = setup.__module__
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        f, rows = setup(), []
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                for values in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                    rows.extend(f(*values))
                    if len(rows) >= batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return df.select(*columns).mapInArrow(run, ddl)


__all__ = ["begin_task", "cut", "fresh_path", "map_rows", "release", "remove", "small_batches", "shared_dir", "table", "texts_of"]
