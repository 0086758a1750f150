"""Error and bias analysis of any number of models in one scan.

``prediction_report`` aggregates a prediction table once, by grouping sets:
per model over all rows, per correctness, per true class, and per pair of
classes.  The tables of the error analysis (summary, error rate per class,
mean words by correctness, confusions) and of the bias analysis (length
profile, per-class precision, recall and F1, underserved classes) are cut from
its few rows (models x classes^2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .bias import performance_disparities  # noqa: F401  (the one-table form)
from .metrics import per_class

SECTIONS = {0: "pair", 3: "class", 6: "correctness", 7: "all"}  # by grouping_id of (true, pred, correct)


def prediction_report(pred: DataFrame, model_col: str = "model") -> DataFrame:
    """(model, section, true_label, pred_label, correct, n, errors, words,
    mean_length, median_length, std_length) of a table with ``true_label,
    pred_label, correct, text_length, word_count``."""
    m, t, p, c = F.col(model_col), F.col("true_label"), F.col("pred_label"), F.col("correct")
    sets = [[m, t, p, c], [m, t], [m, c], [m]]
    found = pred.groupingSets(sets, m, t, p, c).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count_if(~c).alias("errors"),
        F.avg("word_count").alias("words"), F.avg("text_length").alias("mean_length"),
        F.median("text_length").cast("double").alias("median_length"), F.stddev_pop("text_length").alias("std_length"))
    section = F.element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("_set").cast("int"))
    return staged(found.select(m.alias("model"), section.alias("section"), "true_label", "pred_label", "correct", "n",
                               "errors", "words", "mean_length", "median_length", "std_length"))


def error_analysis(report: DataFrame) -> dict[str, DataFrame]:
    """The tables of the error analysis, per model."""
    rate = F.col("errors") / F.col("n")
    whole = report.where("section = 'all'")
    return {
        "summary": whole.select("model", F.col("n").alias("total"), "errors", (F.col("n") - F.col("errors")).alias("correct"),
                                (100 * rate).alias("error_pct"), (100 - 100 * rate).alias("correct_pct")),
        "per_class": report.where("section = 'class'").select("model", "true_label", "n", "errors", rate.alias("error_rate")),
        "mean_words": report.where("section = 'correctness'").select("model", "correct", F.col("words").alias("avg_word_count"), "n"),
        "confusions": report.where("section = 'pair' and errors > 0").select("model", "true_label", "pred_label", "n"),
    }


def bias_analysis(report: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """The per-class tables of the bias analysis, per model."""
    pairs = report.where("section = 'pair'").groupBy("model", "true_label", "pred_label").agg(F.sum("n").alias("n"))
    classes = per_class(pairs, ["model"]).withColumn("underserved", F.col("f1") < threshold)
    return {
        "length_profile": report.where("section = 'class'").select("model", "true_label", "n", "mean_length",
                                                                   "median_length", "std_length"),
        "disparities": classes,
    }
