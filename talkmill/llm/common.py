"""Helpers shared by the operators: shared-folder tables, text slices, per-worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.session import scratch_dir

#: Characters of text that a task turns into arrays at a time (a longer text goes alone).
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost
    executors, and is computed once however often it is used."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, divisor: int):
    """crc32 of the id's decimal text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def slices(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``limit`` at most."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def small(batches, rows: int = 500):
    """Record batches in slices of few rows, so that few texts at a time become objects."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def worker_value(key: Any, make: Callable[[], Any], large: bool = False) -> Any:
    """A value kept by a worker process over its tasks (tokenizers, word caches). The caller
    bounds its size; results never depend on what it holds. Of ``large`` ones a worker keeps the
    last only, as operators that follow each other in one worker don't need each other's."""
    home = sys.modules.setdefault("talkmill_worker_values", types.ModuleType("talkmill_worker_values"))
    values = home.__dict__.setdefault("large" if large else "small", {})
    if key not in values:
        if large:
            values.clear()
        values[key] = make()
    return values[key]


def ship(spark: SparkSession, value: Any):
    """Broadcast a value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with its place from 1 in the given order as ``number``, written and read again.
    Ranges of the order number their own rows, then the rows of the ranges before are added, so
    no task holds more than a range; an order that tells all rows apart keeps ranges even."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "numbered")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            more = [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__range", "__within"])
            at += n

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, f"{own}, __range int, __within long").write.parquet(path)
    rows = spark.read.parquet(path)
    # One row for each range.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__range").agg(F.count("*").alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    return rows.join(before, "__range").select(
        *[F.col(f"`{n}`") for n in df.columns], (F.col("__before") + F.col("__within") + 1).alias("number")
    )
