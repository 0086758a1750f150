"""Driver-side path probing through Hadoop FileSystem (works for local,
HDFS and object stores alike; only metadata calls, no data)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def is_dir(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def glob(spark: SparkSession, pattern: str) -> list[str]:
    p, fs = _fs(spark, pattern)
    st = fs.globStatus(p)
    if st is None:
        return []
    return sorted(str(s.getPath()) for s in st)


def total_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Summed length of the given files (metadata calls only)."""
    total = 0
    for path in paths:
        p, fs = _fs(spark, path)
        total += int(fs.getFileStatus(p).getLen())
    return total
