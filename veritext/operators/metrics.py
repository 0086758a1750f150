"""Classification metrics over prediction tables.

The only data-sized step is one ``groupBy(model, true, pred).count()``
(map-side combined, output <= models * k^2 rows).  Everything after it is
arithmetic on that tiny table, so the same code serves 400 or 4e11 rows and
any number of models in one pass.

Label set per model = union of true and predicted classes; zero division
yields 0 (sklearn ``zero_division=0`` semantics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def materialize_small(df: DataFrame) -> DataFrame:
    """Run an aggregate ONCE, so later self-joins/unions over it never rescan
    the source table.  Its stored size tells Spark whether to broadcast it."""
    return staged(df)


def confusion_counts(pred: DataFrame, true_col: str = "true_label", pred_col: str = "pred_label",
                     group: list[str] | None = None, materialize: bool = True) -> DataFrame:
    """(group..., true_label, pred_label, n): the one data-sized step."""
    g = list(group or [])
    cnt = (pred.groupBy(*g, F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label"))
               .agg(F.count(F.lit(1)).alias("n")))
    return materialize_small(cnt) if materialize else cnt


def class_set(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Union of true and predicted classes per group (U4)."""
    g = list(group or [])
    return (counts.select(*g, F.col("true_label").alias("cls"))
                  .union(counts.select(*g, F.col("pred_label").alias("cls")))
                  .where(F.col("cls").isNotNull()).distinct())


def confusion_matrix(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Zero-filled k x k matrix in long form (true_label, pred_label, n).

    The class grid is built by exploding the (<= k element) class array of
    each group twice -- a generator over a tiny row, not a join."""
    g = list(group or [])
    classes = class_set(counts, g).groupBy(*g).agg(F.array_sort(F.collect_set("cls")).alias("_cs"))
    grid = (classes.select(*g, F.explode("_cs").alias("true_label"), "_cs")
                   .select(*g, "true_label", F.explode("_cs").alias("pred_label")))
    return (grid.join(counts, [*g, "true_label", "pred_label"], "left")
                .select(*g, "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_normalized(cm: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Row-normalised matrix; 0/0 -> 0."""
    g = list(group or [])
    w = Window.partitionBy(*g, "true_label")
    tot = F.sum("n").over(w)
    return cm.withColumn("rate", F.when(tot > 0, F.col("n") / tot).otherwise(F.lit(0.0)))


def per_class(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """precision, recall, f1, support for each class of the label union."""
    g = list(group or [])
    sup = counts.groupBy(*g, F.col("true_label").alias("cls")).agg(F.sum("n").alias("support"))
    prd = counts.groupBy(*g, F.col("pred_label").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = (counts.where(F.col("true_label") == F.col("pred_label"))
                .select(*g, F.col("true_label").alias("cls"), F.col("n").alias("tp")))
    cls = class_set(counts, g)
    t = (cls.join(sup, [*g, "cls"], "left").join(prd, [*g, "cls"], "left").join(tp, [*g, "cls"], "left")
            .select(*g, "cls",
                    F.coalesce("tp", F.lit(0)).alias("tp"),
                    F.coalesce("support", F.lit(0)).alias("support"),
                    F.coalesce("predicted", F.lit(0)).alias("predicted")))
    return t.select(
        *g, "cls",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("support") + F.col("predicted") > 0,
               2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("tp").cast("long").alias("tp"),
    )


def summary_metrics(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """accuracy, {precision, recall, f1} x {macro, weighted} per group (C4)."""
    g = list(group or [])
    pc = per_class(counts, g)
    tot = F.sum("support")
    return pc.groupBy(*g).agg(
        (F.sum("tp") / tot).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall_weighted"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"),
    )


def class_report(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg', 'weighted avg' rows."""
    g = list(group or [])
    pc = per_class(counts, g)
    rows = pc.select(*g, F.col("cls").alias("row"), "precision", "recall", "f1", "support")
    tot = F.sum("support")
    agg = pc.groupBy(*g).agg(
        (F.sum("tp") / tot).alias("acc"), tot.alias("n"),
        F.avg("precision").alias("pm"), F.avg("recall").alias("rm"), F.avg("f1").alias("fm"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("pw"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("rw"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("fw"),
    )
    acc = agg.select(*g, F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support"))
    mac = agg.select(*g, F.lit("macro avg").alias("row"), F.col("pm").alias("precision"),
                     F.col("rm").alias("recall"), F.col("fm").alias("f1"), F.col("n").alias("support"))
    wei = agg.select(*g, F.lit("weighted avg").alias("row"), F.col("pw").alias("precision"),
                     F.col("rw").alias("recall"), F.col("fw").alias("f1"), F.col("n").alias("support"))
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


METRIC_NAMES = ["accuracy", "precision_macro", "precision_weighted", "recall_macro",
                "recall_weighted", "f1_macro", "f1_weighted"]


def model_comparison(metrics: DataFrame, id_cols: list[str], metric_names: list[str] | None = None) -> DataFrame:
    """Wide metric table -> long (id..., metric, value) via unpivot."""
    names = metric_names or [m for m in METRIC_NAMES if m in metrics.columns]
    return metrics.unpivot(id_cols, names, "metric", "value")


def generalization_gap(metrics: DataFrame, model_col: str = "model", domain_col: str = "domain",
                       in_domain: str = "in", cross_domain: str = "cross") -> DataFrame:
    """Conditional aggregate over (model, domain) metrics."""
    d = F.col(domain_col)
    out = metrics.groupBy(model_col).agg(
        F.max(F.when(d == in_domain, F.col("accuracy"))).alias("in_dist_accuracy"),
        F.max(F.when(d == in_domain, F.col("f1_macro"))).alias("in_dist_f1_macro"),
        F.max(F.when(d == cross_domain, F.col("accuracy"))).alias("cross_accuracy"),
        F.max(F.when(d == cross_domain, F.col("f1_macro"))).alias("cross_f1_macro"),
    )
    return out.withColumn("generalization_gap_f1", F.col("in_dist_f1_macro") - F.col("cross_f1_macro"))


def log_loss(df: DataFrame, prob_col: str, label_col: str, weight_col: str | None = None,
             eps: float = 1e-15, group: list[str] | None = None) -> DataFrame:
    """Mean cross-entropy; ``prob_col`` is an array of class probabilities
    indexed by the integer label (A24).  Optional per-row weights."""
    g = list(group or [])
    p = F.element_at(F.col(prob_col), F.col(label_col).cast("int") + 1)
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    nll = -F.log(p)
    if weight_col:
        w = F.col(weight_col)
        return df.groupBy(*g).agg((F.sum(w * nll) / F.sum(w)).alias("log_loss"))
    return df.groupBy(*g).agg(F.avg(nll).alias("log_loss"))


def class_weights(df: DataFrame, label_col: str = "label_id") -> DataFrame:
    """Balanced weights n / (k * n_c) (A18) as a tiny table (label, n_c, weight)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(label_col, "n_c",
                    (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label_col: str = "label_id", weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight; the class table has k rows -> broadcast."""
    cw = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(cw), label_col)


def array_argmax(col) -> "F.Column":
    """Index (0-based) of the first maximum of a numeric array."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")
