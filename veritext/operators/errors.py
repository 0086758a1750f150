"""Error analytics on one prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import name_for_id
from ..functions.text import char_length, word_count


def collect_errors(df: DataFrame, label_names: dict, text_col: str = "text",
                   true_col: str = "true_id", pred_col: str = "pred_id",
                   keep: list[str] | None = None) -> DataFrame:
    """Prediction table with names, correctness and text length features.
    Class ids outside ``label_names`` fall back to str(id).  ``text_length``
    / ``word_count`` columns already present (computed where the text was
    read) are used as they are, so consumers that never show the text let
    Catalyst prune it before any join."""
    tl = F.col("text_length").cast("int") if "text_length" in df.columns else char_length(text_col)
    wc = F.col("word_count").cast("int") if "word_count" in df.columns else word_count(text_col)
    return df.select(
        *(keep or []),
        F.col(text_col).alias("text"),
        F.col(true_col).cast("int").alias("true_id"),
        F.col(pred_col).cast("int").alias("pred_id"),
        name_for_id(F.col(true_col).cast("int"), label_names).alias("true_label"),
        name_for_id(F.col(pred_col).cast("int"), label_names).alias("pred_label"),
        (F.col(true_col) == F.col(pred_col)).alias("correct"),
        tl.alias("text_length"),
        wc.alias("word_count"),
    )


def error_summary(pred: DataFrame, correct_col: str = "correct", group: list[str] | None = None) -> DataFrame:
    g = list(group or [])
    c = F.col(correct_col)
    return pred.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~c).alias("errors"),
        F.count_if(c).alias("correct"),
    ).select(*g, "total", "errors", "correct",
             (100.0 * F.col("errors") / F.col("total")).alias("error_pct"),
             (100.0 * F.col("correct") / F.col("total")).alias("correct_pct"))


def error_rate_by_class(pred: DataFrame, true_col: str = "true_label", correct_col: str = "correct",
                        group: list[str] | None = None) -> DataFrame:
    """Per true class: n, errors, error_rate; ascending by error rate."""
    g = list(group or [])
    return (pred.groupBy(*g, F.col(true_col).alias("true_label"))
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(correct_col)).alias("errors"))
                .withColumn("error_rate", F.col("errors") / F.col("n"))
                .orderBy(*g, "error_rate", "true_label"))


def confusion_pairs_topk(pred: DataFrame, k: int = 10, true_col: str = "true_label",
                         pred_col: str = "pred_label", correct_col: str = "correct") -> DataFrame:
    """Most frequent (true -> pred) error pairs, ties broken by the names."""
    return (pred.where(~F.col(correct_col))
                .groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label"))
                .agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), "true_label", "pred_label").limit(k))


def mean_words_by_correctness(pred: DataFrame) -> DataFrame:
    """Average word count of correct vs misclassified rows."""
    return pred.groupBy("correct").agg(F.avg("word_count").alias("avg_word_count"),
                                       F.count(F.lit(1)).alias("n"))


def error_crosstab(pred: DataFrame, classes: list[str], true_col: str = "true_label",
                   pred_col: str = "pred_label", correct_col: str = "correct") -> DataFrame:
    """Misclassification crosstab with every class as row and column.
    Explicit pivot values: no extra job to discover them."""
    errs = pred.where(~F.col(correct_col))
    pv = (errs.groupBy(F.col(true_col).alias("true_label"))
              .pivot(pred_col, classes).agg(F.count(F.lit(1))))
    spark = pred.sparkSession
    all_rows = spark.createDataFrame([(c,) for c in classes], "true_label string")
    out = F.broadcast(all_rows).join(pv, "true_label", "left")
    return out.select("true_label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in classes])


def error_samples(pred: DataFrame, order_cols: list[str], n: int = 5, true_col: str = "true_label",
                  pred_col: str = "pred_label", correct_col: str = "correct",
                  cols: list[str] | None = None) -> DataFrame:
    """First n misclassified rows per (true, pred) pair in input order.
    Planned as WindowGroupLimit (partial + final), so a hot pair never
    materialises more than n rows per partition."""
    w = Window.partitionBy(true_col, pred_col).orderBy(*order_cols)
    out = (pred.where(~F.col(correct_col))
               .withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") <= n).drop("_rn"))
    return out.select(*(cols or ["true_label", "pred_label", "text", "word_count"]))


def histogram(df: DataFrame, value_col: str, group: list[str], bins: int = 30) -> DataFrame:
    """Equal-width density histogram per group over the group's own min..max
    (A17).  Two passes: a min/max aggregate (one row per group, joined
    back) and a count per (group, bin).  Last bin is closed; a degenerate
    range uses [v-0.5, v+0.5]; empty bins have count 0."""
    rng = df.groupBy(*group).agg(F.min(value_col).cast("double").alias("_lo"),
                                 F.max(value_col).cast("double").alias("_hi"),
                                 F.count(F.lit(1)).alias("_n"))
    rng = (rng.withColumn("_lo2", F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") - 0.5).otherwise(F.col("_lo")))
              .withColumn("_hi2", F.when(F.col("_hi") == F.col("_lo"), F.col("_hi") + 0.5).otherwise(F.col("_hi")))
              .withColumn("_w", (F.col("_hi2") - F.col("_lo2")) / bins))
    x = F.col(value_col).cast("double")
    b = F.least(F.lit(bins - 1), F.floor((x - F.col("_lo2")) / F.col("_w")).cast("int"))
    # one row per group, computed once; below a checked row bound it comes
    # back as a local table (broadcast without shuffling the data), above
    # it stays a persisted distributed table joined normally
    from .metrics import materialize_small
    rng = materialize_small(rng)
    counted = (df.join(rng, group)
                 .groupBy(*group, b.alias("bin"))
                 .agg(F.count(F.lit(1)).alias("_count")))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = grid.join(counted, [*group, "bin"], "left").withColumn("count", F.coalesce("_count", F.lit(0)).cast("long"))
    return filled.select(*group, "bin",
                          (F.col("_lo2") + F.col("bin") * F.col("_w")).alias("bin_start"),
                          (F.col("_lo2") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
                          "count", (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"))
