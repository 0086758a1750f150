"""Fits that step together against MLlib's, one by one."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tests.test_reports import vectors
from veritext.operators import models, solvers, tuning


@pytest.mark.parametrize("classes", [2, 3])
def test_fits_equal_mllib(spark, classes, monkeypatch):
    monkeypatch.setattr(models, "SVC_ITERATIONS", 10)
    train = vectors(spark, classes).withColumn("weight", 0.5 + F.col("doc_id") % 3).coalesce(1).persist()
    search = tuning.Together.of(train, 3)
    found = search.fitted([("logistic_regression", 1.0, (-1, -1)), ("linear_svm", 1.0, (0, 1))])
    lr = models.make_lr(180).fit(train)
    w, e = found[0][1].raw(found[0][2])
    assert np.allclose(w.T, lr.coefficientMatrix.toArray(), atol=1e-5)
    assert np.allclose(e - e.mean(), lr.interceptVector.toArray(), atol=1e-5)
    part = train.where("fold <> 0 and inner <> 1").withColumn("y", (F.col("label") == found[1][1].target).cast("double"))
    svm = models._svc(part.count(), 1.0, True, "y").fit(part)
    w, e = found[1][1].raw(found[1][2])
    assert np.allclose(w[:, 0], svm.coefficients.toArray(), atol=1e-5) and e[0] == pytest.approx(svm.intercept, abs=1e-5)
    search.freed()


def test_rounds_of_jobs_equal_rounds_in_tasks(spark, monkeypatch):
    """Scores and refitted models, with all rows in a task and with blocks of an RDD."""
    monkeypatch.setattr(models, "SVC_ITERATIONS", 6)
    monkeypatch.setattr(models, "LR_ITERATIONS", 6)
    monkeypatch.setattr(solvers, "BLOCK_ENTRIES", 200)
    train = vectors(spark, 3, seed=3).coalesce(2).persist()
    tasks = [("logistic_regression", 0.01, 1), ("multinomial_naive_bayes", 0.5, 0), ("linear_svm", 1.0, 2)]
    found = []
    for most in (solvers.WHOLE_ENTRIES, 0):
        monkeypatch.setattr(solvers, "WHOLE_ENTRIES", most)
        search = tuning.Together.of(train, 3)
        assert (search.rows is None) == (most == 0)
        scores, fits = search.scores(tasks), search.refitted({"logistic_regression": 1.0, "linear_svm": 1.0})
        svm = [x for fold in fits["linear_svm"].folds for m, a, b in fold.values() for x in (*m.coefficients.toArray(), m.intercept, a, b)]
        found.append([*scores.values(), *fits["logistic_regression"].coefficientMatrix.toArray().ravel(), *svm])
        search.freed()
    assert found[0] == pytest.approx(found[1], rel=1e-6, abs=1e-9)


def test_a_grid_runs_few_jobs(spark):
    """A solver's step is no Spark job."""
    train = vectors(spark, 2).coalesce(1).persist()
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    tuning.grid_search(train, grids={"logistic_regression": ("C", (0.1, 1.0)), "multinomial_naive_bayes": ("alpha", (1.0,))})
    assert jobs() - before < 40


def test_parts_without_a_class_and_dense_rows(spark):
    """One by one where a part of the folds lacks a class; dense vectors count as sparse ones."""
    train = vectors(spark, 2, 90).coalesce(1).persist()
    few = train.where("label = 0 or fold <> 1 or inner <> 2")
    assert tuning.Together.of(few, 3) is None and tuning.Together.of(train.limit(0), 3) is None
    table, _ = tuning.grid_search(few.coalesce(1).persist(), grids={"multinomial_naive_bayes": ("alpha", (1.0, 2.0))})
    assert table.count() == 2
    dense = spark.createDataFrame([(r.doc_id, r.label, r.weight, r.fold, r.inner, Vectors.dense(r.features.toArray()))
                                   for r in train.collect()], train.columns)
    one, other = (tuning.Together.of(t.coalesce(1), 3) for t in (train, dense))
    assert all(np.allclose(one.sums[p], other.sums[p]) for p in one.parts)
