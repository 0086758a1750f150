"""Grid search with nested calibration and refit.

Each parameter value is fitted on two of the three stratified folds and scored
(macro-F1) on the third.  The SVM is the calibrated one: inside the two folds
its own three (``inner``) folds are fitted and calibrated as in the final model.
The solvers of all these fits step together (``solvers``): a round evaluates
every fit that still runs, naive Bayes takes its sums from one pass, and one
pass scores every value.  The best value of each model is fitted again on
all training rows.  Where a class is missing from a part of the folds, models
are fitted one by one by MLlib, which defines what such a fit returns.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fs import total_bytes
from . import models, solvers

PART_BYTES = 8 * 1024 * 1024  # stored vectors that a task of a fit reads
LEAST_BYTES = 1024 * 1024  # the same while there are cores left

# The grids of the original search.
GRIDS = {"logistic_regression": ("C", (0.01, 0.1, 1.0, 10.0)),
         "multinomial_naive_bayes": ("alpha", (0.01, 0.1, 0.5, 1.0, 2.0)),
         "linear_svm": ("C", (0.01, 0.1, 1.0, 10.0))}


def compact(train: DataFrame) -> DataFrame:
    """``train`` in one partition per ``PART_BYTES`` of its stored rows, or in
    one a core where those hold ``LEAST_BYTES``: a round of the solvers waits
    for its longest task, so few partitions are dealt out evenly."""
    size = total_bytes(train.sparkSession, train.inputFiles())
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-size // PART_BYTES), min(cores, -(-size // LEAST_BYTES)))
    if not size:
        return train
    return train.coalesce(parts) if parts == 1 or train.rdd.getNumPartitions() >= 4 * parts else train.repartition(parts)


def fitted(model: str, value: float, train: DataFrame, fold_col: str):
    """One model with one parameter value; ``fold_col`` calibrates the SVM."""
    if model == "logistic_regression":
        return models.make_lr(max(1, train.count()), C=value).fit(train)
    if model == "multinomial_naive_bayes":
        return models.make_nb(value, weighted=False).fit(train)
    return models.fit_calibrated_svc(train, C=value, fold_col=fold_col)


def grid_search(train: DataFrame, folds: int = 3, parallelism: int = 8,
                grids: dict | None = None) -> tuple[DataFrame, dict]:
    """(model, param, value, mean_f1_macro, is_best) of every value, and per
    model its best value (the first one of equal scores) with the refitted
    model.  ``train`` has features, label, weight, fold and inner."""
    grids = grids or GRIDS
    train = compact(train)
    tasks = [(model, value, fold) for model, (_, values) in grids.items() for value in values for fold in range(folds)]
    search = Together.of(train, folds)
    found = search.scores(tasks) if search else one_by_one(train, tasks, parallelism)
    rows, tops = [], {}
    for model, (param, values) in grids.items():
        means = [sum(found[model, v, f] for f in range(folds)) / folds for v in values]
        tops[model] = top = values[means.index(max(means))]
        rows += [(model, param, v, s, v == top) for v, s in zip(values, means, strict=True)]
    fits = search.refitted(tops) if search else {}
    best = {model: (top, fits[model] if model in fits else fitted(model, top, train, "fold")) for model, top in tops.items()}
    if search:
        search.freed()
    table = train.sparkSession.createDataFrame(
        rows, "model string, param string, value double, mean_f1_macro double, is_best boolean")
    return table, best


def one_by_one(train: DataFrame, tasks: list[tuple[str, float, int]], parallelism: int) -> dict[tuple, float]:
    """Macro-F1 of every (model, value, fold), each model fitted by MLlib."""
    score = models.MacroF1Evaluator("label", "prediction")

    def one(task: tuple[str, float, int]) -> float:
        model, value, fold = task
        m = fitted(model, value, train.where(F.col("fold") != fold), "inner")
        return score.evaluate(m.transform(train.where(F.col("fold") == fold)))

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(tasks, pool.map(one, tasks), strict=True))


def macro_f1(counts: np.ndarray) -> float:
    """Of a (true, predicted) table: the classes that occur in it, zero division 0."""
    hit, true, said = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    seen = (true + said) > 0
    return float(np.mean(2 * hit[seen] / (true + said)[seen]))


class Together:
    """The fits of a grid, all at once."""

    def __init__(self, train: DataFrame, counts: dict[tuple[int, int], np.ndarray], folds: int, width: int, whole: bool):
        self.counts, self.folds, self.width, self.sc = counts, folds, width, train.sparkSession.sparkContext
        self.parts = sorted(counts)
        self.k = counts[self.parts[0]].shape[1]
        rows = solvers.stored_rows(train, width)
        self.rows = self.sc.broadcast(solvers.Rows.joined(rows.collect())) if whole else None
        self.data = solvers.Local([solvers.Block(self.rows.value)]) if whole else solvers.Spread(rows.map(solvers.Block))
        parts, k, ids = self.parts, self.k, np.arange(self.k)

        def moments(b: solvers.Block, _) -> list[np.ndarray]:
            part = np.stack([((b.fold == f) & (b.inner == g)) for f, g in parts], axis=1).astype(float)
            weighted = part * b.weight[:, None]
            of_class = (part[:, :, None] * (b.label[:, None] == ids)[:, None, :]).reshape(len(part), -1)
            squares = [(i, x, v * v) for i, x, v in b.columns]
            both = solvers.times(b.columns, np.concatenate((weighted, of_class), axis=1), width)
            return [both, solvers.times(squares, weighted, width)]

        both, squares = self.data.summed(moments)
        n = len(parts)
        self.sums = dict(zip(parts, both[:, :n].T, strict=True))
        self.squares = dict(zip(parts, squares.T, strict=True))
        self.by_class = dict(zip(parts, both[:, n:].reshape(width, n, k).transpose(1, 2, 0), strict=True))

    @classmethod
    def of(cls, train: DataFrame, folds: int) -> Together | None:
        """None where a class is missing from a part of the folds."""
        rows = train.groupBy("fold", "inner", "label").agg(
            F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("w2"),
            F.sum(F.size(F.unwrap_udt("features")["values"])).alias("entries")).collect()
        labels, parts = {r["label"] for r in rows}, {(r["fold"], r["inner"]) for r in rows}
        k = len(labels)
        whole = (k > 1 and labels == set(range(k)) and {f for f, _ in parts} == set(range(folds)) and len(rows) == len(parts) * k
                 and len(parts) == folds * len({g for _, g in parts}) and all(r["w"] is not None and r["w"] > 0 for r in rows))
        entries = sum(r["entries"] or 0 for r in rows)
        if not whole or not entries:
            return None
        width = train.select("features").first()[0].size
        counts = {p: np.zeros((3, k)) for p in parts}
        for r in rows:
            counts[r["fold"], r["inner"]][:, int(r["label"])] = r["n"], r["w"], r["w2"]
        return cls(train, counts, folds, width, entries <= solvers.WHOLE_ENTRIES)

    def rows_of(self, use: tuple[int, int], table: dict) -> np.ndarray:
        """Sum of a table of the parts over those that a fit uses."""
        return sum(table[p] for p in self.parts if p[0] != use[0] and p[1] != use[1])

    def linear(self, model: str, C: float, use: tuple[int, int]) -> list[solvers.Linear]:
        """The fits of a logistic regression, or of an SVM per target class."""
        n, w, w2 = self.rows_of(use, self.counts)
        m = solvers.Moments.of(w.sum(), w2.sum(), self.rows_of(use, self.sums), self.rows_of(use, self.squares))
        reg = 1.0 / (C * n.sum())
        if model == "linear_svm":
            return [solvers.Linear(m, reg, np.zeros(1), use, c) for c in ([1] if self.k == 2 else range(self.k))]
        start = np.log1p(w)
        return [solvers.Linear(m, reg, start - start.mean(), use)]

    def fitted(self, asked: list[tuple[str, float, tuple[int, int]]]) -> list[tuple[tuple, solvers.Linear, np.ndarray, tuple | None]]:
        """(asked, fit, last point, calibrator) of all fits of the asked models."""
        each = [(a, f) for a in sorted(asked, key=lambda a: a[0] == "linear_svm") for f in self.linear(*a)]
        fits, limits = [f for _, f in each], (models.LR_ITERATIONS, models.SVC_ITERATIONS, models.LR_ITERATIONS)
        if not fits:
            return []
        if self.rows is not None:
            found = solvers.fitted_in_tasks(self.rows, fits, self.k, limits, self.sc)
        else:
            found = solvers.fitted(self.data, lambda: self.data, fits, self.k, limits)
        return [(a, f, *end) for (a, f), end in zip(each, found, strict=True)]

    def freed(self) -> None:
        self.data.freed()
        if self.rows is not None:
            self.rows.unpersist()

    def bayes(self, alpha: float, use: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, class) log probabilities and the classes' priors, unweighted."""
        n, terms = self.rows_of(use, self.counts)[0], self.rows_of(use, self.by_class)
        theta = np.log(terms + alpha) - np.log(terms.sum(axis=1, keepdims=True) + self.width * alpha)
        return theta.T, np.log(n + alpha) - np.log(n.sum() + self.k * alpha)

    def scores(self, tasks: list[tuple[str, float, int]]) -> dict[tuple, float]:
        """Macro-F1 of every (model, value, fold) on the rows of the fold."""
        inner = sorted({g for _, g in self.parts})
        asked = [(m, v, (f, g)) for m, v, f in tasks if m != "multinomial_naive_bayes"
                 for g in (inner if m == "linear_svm" else [-1])]
        weights, ends, at, lo = [], [], {}, 0
        for (m, v, (f, _)), fit, point, line in self.fitted(asked):
            w, e = fit.raw(point)
            weights.append(w)
            ends.append(e)
            at.setdefault((m, v, f), []).append((lo, line))
            lo += len(e)
        for m, v, f in tasks:
            if m == "multinomial_naive_bayes":
                w, e = self.bayes(v, (f, -1))
                weights.append(w)
                ends.append(e)
                at[m, v, f] = [(lo, None)]
                lo += len(e)
        k, lines = self.k, [(task[2], at[task]) for task in tasks]

        def counts(b: solvers.Block, given: tuple) -> list[np.ndarray]:
            z = solvers.times(b.rows, given[0], len(b.label)) + given[1]
            out = np.zeros((len(lines), k, k))
            for i, (fold, columns) in enumerate(lines):
                mine = b.fold == fold
                if columns[0][1] is None:
                    said = np.argmax(z[mine, columns[0][0]:columns[0][0] + k], axis=1)
                else:
                    said = np.argmax(probabilities(z[mine], columns, k), axis=1)
                out[i] = np.bincount(b.label[mine] * k + said, minlength=k * k).reshape(k, k)
            return [out]

        found = self.data.summed(counts, (np.concatenate(weights, axis=1), np.concatenate(ends)))[0]
        return {task: macro_f1(found[i]) for i, task in enumerate(tasks)}

    def refitted(self, tops: dict[str, float]) -> dict:
        """The logistic regression and the SVM with their best values, fitted
        on all rows; the SVM is calibrated on the folds."""
        asked = [(m, v, (f, -1)) for m, v in tops.items() if m != "multinomial_naive_bayes"
                 for f in (range(self.folds) if m == "linear_svm" else [-1])]
        out: dict = {}
        svm = [{} for _ in range(self.folds)]
        for (m, _, (f, _)), fit, point, line in self.fitted(asked):
            w, e = fit.raw(point)
            if fit.target < 0:
                matrix = DenseMatrix(self.k, self.width, w.T.ravel(order="F").tolist())
                out[m] = made(LogisticRegressionModel, matrix, DenseVector(e - e.mean()), self.k, True)
            else:
                svm[f][fit.target] = (made(LinearSVCModel, DenseVector(w[:, 0]), float(e[0])), *line)
        if svm[0]:
            out["linear_svm"] = models.CalibratedSVCModel(list(range(self.k)), svm)
        return out


def probabilities(z: np.ndarray, columns: list[tuple[int, tuple[float, float]]], k: int) -> np.ndarray:
    """Calibrated class probabilities, averaged over the fits of the folds."""
    with np.errstate(over="ignore"):
        p = np.stack([1.0 / (1.0 + np.exp(-(a * z[:, c] + b))) for c, (a, b) in columns], axis=1)
    if k == 2:
        return np.stack((1.0 - p, p), axis=2).mean(axis=1)
    p = p.reshape(len(z), -1, k)
    total = p.sum(axis=2, keepdims=True)
    return np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / k).mean(axis=1)


def made(kind: type, *parts):
    """An MLlib model of given coefficients."""
    return kind(JavaParams._new_java_obj(f"org.apache.spark.ml.classification.{kind.__name__}", kind._randomUID(), *parts))
