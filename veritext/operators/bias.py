"""Bias analytics (C3): class counts per split, imbalance ratio, per-class
scores with an under-served flag, and length profiles per class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import confusion_counts, per_class


def split_class_counts(df: DataFrame, split_col: str = "split", label_col: str = "label_id",
                       classes: list | None = None) -> DataFrame:
    """(split, class, n) for every split and every class (A2): a class that a
    split lacks counts 0.  ``classes`` defaults to those of any split."""
    cnt = df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    # splits x classes rows: the window over the count table is bounded
    known = F.array(*map(F.lit, classes)) if classes else F.collect_set(label_col).over(Window.partitionBy())
    full = (cnt.withColumn("_known", known)
               .select(F.col(split_col).alias("_split"), F.explode("_known").alias("_class")).distinct())
    on = F.col("_split").eqNullSafe(F.col(split_col)) & (F.col("_class") == F.col(label_col))
    return full.join(cnt, on, "left").select(F.col("_split").alias(split_col), F.col("_class").alias(label_col),
                                             F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def imbalance_ratio(counts: DataFrame, group: list[str] | None = None, n_col: str = "n") -> DataFrame:
    """max(n)/min(n) per group; +inf when a class has zero rows (A3)."""
    g = list(group or [])
    return counts.groupBy(*g).agg(F.max(n_col).alias("max_n"), F.min(n_col).alias("min_n")).withColumn(
        "imbalance_ratio",
        F.when(F.col("min_n") > 0, F.col("max_n") / F.col("min_n")).otherwise(F.lit(float("inf"))))


def performance_disparities(pred: DataFrame, threshold: float = 0.5, true_col: str = "true_label",
                            pred_col: str = "pred_label", group: list[str] | None = None) -> DataFrame:
    """Per-class P/R/F1/support + ``underserved`` = f1 < threshold."""
    pc = per_class(confusion_counts(pred, true_col, pred_col, group), group)
    return pc.withColumn("underserved", F.col("f1") < F.lit(threshold))


def length_profile(df: DataFrame, label_col: str, length_col: str = "text_length", exact: bool = True) -> DataFrame:
    """Mean, median and population std of text length per class.

    ``median`` is exact: Spark's percentile keeps a value->count map, bounded
    by the number of distinct lengths (not rows), so a hot class stays cheap.
    ``exact=False`` switches to ``percentile_approx``."""
    med = F.median(length_col) if exact else F.percentile_approx(length_col, 0.5, 10000)
    return df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(length_col).alias("mean_length"),
        med.cast("double").alias("median_length"),
        F.stddev_pop(length_col).alias("std_length"),
    )
