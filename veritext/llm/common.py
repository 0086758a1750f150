"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` (shared by
    driver and executors) and read it back: the lineage ends there, a lost
    executor re-reads files, and later consumers prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veritext-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slice_of(key: str | Column, slices: int) -> Column:
    """Stable slice number of a row: a hash of its key, the same on every
    re-run of a task (nulls are one key)."""
    return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")


def unit(seed: str, *keys: str | Column) -> Column:
    """Uniform number in (0, 1) from md5(seed:key:...): the same for every
    partitioning, and easy to restate in SQL.  52 bits, never 0 or 1."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"),
                                                     F.lit("")) for k in keys])
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 52))


def give_back() -> None:
    """Return a Python worker's free memory to the system: Spark keeps idle
    workers for later stages, beside the memory that those need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def by_group(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A grouped Arrow function whose worker gives back what a group took."""
    def run(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            give_back()
    return run


def by_groups(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``by_group`` for a cogrouped function."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            give_back()
    return run


def by_batch(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``by_group`` for a function over a partition's batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()
    return run
