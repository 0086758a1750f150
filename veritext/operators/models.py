"""MLlib classifiers on the TF-IDF vector face (M1-M6, M8, M9).

* logistic regression: multinomial, L2, ``regParam = 1 / (C * sum(w))``
  (the per-sample objective scaled to MLlib's weighted-mean loss), no
  standardisation, balanced ``weightCol``;
* multinomial naive Bayes: MLlib ``NaiveBayes`` with balanced weights;
* linear SVM + 3-fold sigmoid calibration: per fold a weighted
  ``LinearSVC`` (one-vs-rest for k > 2) is fitted on the other folds, a 1-D
  logistic (Platt) calibrator is fitted on the held-out margins, and test
  probabilities are the average over folds of the calibrated (normalised)
  scores.  All fits are distributed; only model coefficients (k x V) and the
  calibrators' two scalars per class and fold reach the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .tfidf import constant_array, generated


def balanced_weights(df: DataFrame, label_col: str = "label_id", weight_col: str = "weight") -> DataFrame:
    return metrics.with_class_weight(df, label_col, weight_col)


# Iteration limits of the original solvers.
LR_ITERATIONS, SVC_ITERATIONS = 1000, 2000


def make_lr(n: int, C: float = 1.0, max_iter: int = LR_ITERATIONS, weighted: bool = True) -> LogisticRegression:
    kw = dict(featuresCol="features", labelCol="label", family="multinomial", regParam=1.0 / (C * n),
              elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-4)
    if weighted:
        kw["weightCol"] = "weight"
    return LogisticRegression(**kw)


def make_nb(alpha: float = 1.0, weighted: bool = True) -> NaiveBayes:
    kw = dict(featuresCol="features", labelCol="label", modelType="multinomial", smoothing=alpha)
    if weighted:
        kw["weightCol"] = "weight"
    return NaiveBayes(**kw)


def _svc(n: int, C: float, weighted: bool, label: str) -> LinearSVC:
    kw = dict(featuresCol="features", labelCol=label, regParam=1.0 / (C * n), maxIter=SVC_ITERATIONS,
              standardization=False, tol=1e-4)
    if weighted:
        kw["weightCol"] = "weight"
    return LinearSVC(**kw)


def lr_certificate(train: DataFrame, model, reg: float) -> dict[str, float]:
    """Loss of a multinomial logistic regression at the fitted weights and at
    zero, and the norm of its gradient there, from the data: one pass sums the
    residuals of each class per feature.  ``train`` has features (sparse),
    label, weight."""
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    classes = range(len(w))
    rows = train.select("label", "weight", F.unwrap_udt("features").alias("v")).select(
        "label", "weight", F.col("v.indices").alias("i"), F.col("v.values").alias("x"))

    def margin(c: int) -> F.Column:
        by_index = constant_array(w[c].tolist(), "double")
        return F.aggregate(F.zip_with("i", "x", lambda i, x: x * F.get(by_index, i)), F.lit(float(b[c])), lambda s, x: s + x)

    rows = generated(rows, F.array(*[margin(c) for c in classes]), "m")
    rows = generated(rows, F.array_max("m"), "top")
    rows = generated(rows, F.aggregate("m", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))), "total")
    residuals = [F.exp(F.get("m", F.lit(c)) - F.col("top")) / F.col("total") - (F.col("label") == c).cast("double")
                 for c in classes]
    loss = F.log("total") + F.col("top") - F.get("m", F.col("label").cast("int"))
    rows = rows.select("weight", F.array(*residuals).alias("r"), loss.alias("loss"), "i", "x")
    # index -1 carries the intercepts and the loss, each row once
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("x"))),
                     F.zip_with("i", "x", lambda i, x: F.struct(i.alias("i"), x.alias("x"))))
    sums = (rows.select("weight", "r", "loss", F.explode(parts).alias("e")).groupBy("e.i")
            .agg(*[F.sum(F.col("weight") * F.get("r", F.lit(c)) * F.col("e.x")).alias(f"g{c}") for c in classes],
                 F.sum(F.when(F.col("e.i") == -1, F.col("weight") * F.col("loss"))).alias("loss"),
                 F.sum(F.when(F.col("e.i") == -1, F.col("weight"))).alias("n")).collect())  # one row per feature
    whole = next(r for r in sums if r["i"] == -1)
    gradient = reg * w
    for r in sums:
        if r["i"] >= 0:
            gradient[:, r["i"]] += np.array([r[f"g{c}"] for c in classes]) / whole["n"]
    ends = np.array([whole[f"g{c}"] for c in classes]) / whole["n"]
    return {"loss": whole["loss"] / whole["n"] + reg / 2 * float((w * w).sum()), "null_loss": math.log(len(w)),
            "gradient_norm": float(np.sqrt((gradient * gradient).sum() + (ends * ends).sum()))}


@dataclass
class CalibratedSVCModel:
    classes: list[int]
    folds: list[dict] = field(default_factory=list)  # per fold: {cls: (svc_model, a, b)}

    def transform(self, df: DataFrame, prob_col: str = "probability", pred_col: str = "prediction") -> DataFrame:
        out = df
        prob_terms = []
        binary = len(self.classes) == 2
        for fi, fold in enumerate(self.folds):
            cal = []
            for c, (m, a, b) in fold.items():
                raw = f"_raw_{fi}_{c}"
                out = m.setRawPredictionCol(raw).setPredictionCol(f"_p_{fi}_{c}").transform(out)
                margin = vector_to_array(F.col(raw))[1]
                cal.append((c, 1.0 / (1.0 + F.exp(-(F.lit(a) * margin + F.lit(b))))))
            if binary:
                p1 = cal[0][1]
                probs = [1.0 - p1, p1]
            else:
                tot = sum(p for _, p in cal)
                probs = [F.when(tot > 0, p / tot).otherwise(F.lit(1.0 / len(cal))) for _, p in cal]
            prob_terms.append(probs)
        k = len(self.classes)
        avg = [sum(ps[i] for ps in prob_terms) / len(prob_terms) for i in range(k)]
        arr = F.array(*avg)
        out = out.withColumn(prob_col, arr)
        drop = [c for c in out.columns if c.startswith("_raw_") or c.startswith("_p_")]
        return out.drop(*drop).withColumn(pred_col, metrics.array_argmax(prob_col).cast("double"))


def fit_calibrated_svc(train: DataFrame, C: float = 1.0, folds: int = 3, weighted: bool = True,
                       fold_col: str = "fold", parallelism: int = 3) -> CalibratedSVCModel:
    """``train`` has features, label (double 0..k-1), weight, fold."""
    classes = sorted(int(r[0]) for r in train.select("label").distinct().collect())
    n = train.count()
    model = CalibratedSVCModel(classes=classes)
    binary = len(classes) == 2
    targets = [classes[1]] if binary else classes
    def one_fold(f: int) -> dict:
        fit_part = train.where(F.col(fold_col) != f)
        held = train.where(F.col(fold_col) == f)
        n_fit = fit_part.count()
        fold_models = {}
        for c in targets:
            y = f"_y{c}"
            m = _svc(n_fit or n, C, weighted, y).fit(fit_part.withColumn(y, (F.col("label") == c).cast("double")))
            scored = m.setRawPredictionCol("_raw").setPredictionCol("_pp").transform(
                held.withColumn(y, (F.col("label") == c).cast("double")))
            mcol = VectorAssembler(inputCols=["_m"], outputCol="_mv").transform(
                scored.withColumn("_m", vector_to_array("_raw")[1]))
            platt = LogisticRegression(featuresCol="_mv", labelCol=y, regParam=0.0, standardization=False,
                                       maxIter=LR_ITERATIONS).fit(mcol)
            fold_models[c] = (m, float(platt.coefficients[0]), float(platt.intercept))
        return fold_models

    # folds are independent Spark jobs: submit them concurrently
    with ThreadPoolExecutor(max_workers=min(parallelism, folds)) as pool:
        model.folds.extend(pool.map(one_fold, range(folds)))
    return model


class MacroF1Evaluator(Evaluator):
    """Macro-F1 over the union of true and predicted classes, zero division 0
    (M9).  One aggregation to a k x k table, then driver arithmetic."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol = labelCol
        self.predictionCol = predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        cnt = metrics.confusion_counts(dataset, self.labelCol, self.predictionCol)
        row = metrics.summary_metrics(cnt).select("f1_macro").first()
        return float(row[0]) if row and row[0] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True
