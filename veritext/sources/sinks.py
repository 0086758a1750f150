"""Sinks (K1-K4).  Result tables here are small (models x metrics, <= n
samples per class pair), so one file per table is written; large tables
(corpora) go to partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_small_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header-carrying CSV; an empty result still gets its header (K2)."""
    (df.coalesce(1).write.mode(mode).option("header", True)
       .option("emptyValue", "").csv(path))


def write_metrics(df: DataFrame, path: str) -> None:  # K1
    write_small_csv(df, path)


def write_error_samples(df: DataFrame, path: str) -> None:  # K2
    write_small_csv(df.select("true_label", "pred_label", "text", "word_count"), path)


def write_cross_summary(df: DataFrame, path: str) -> None:
    """K3 keyed by direction: no overwrite of the other direction."""
    df.write.mode("overwrite").option("header", True).partitionBy("source", "target").csv(path)


def write_corpus(df: DataFrame, path: str, partition_cols: list[str] | None = None, fmt: str = "parquet") -> None:  # K4
    """A corpus as Parquet, or as CSV (header, quotes doubled) with as many
    files as the corpus has partitions."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.options(header=True, quote='"', escape='"', emptyValue="")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.save(path)
