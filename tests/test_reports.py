"""Error and bias analysis in one scan, grid search, certificate."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from veritext.operators import bias, errors, models, report, tuning


def predictions(spark, models_of=("a", "b")):
    rows = [(m, t, p, t == p, n, n // 5) for m in models_of for i, (t, p) in enumerate(
        [("x", "x"), ("x", "y"), ("y", "y"), ("z", "x"), ("x", "x"), ("y", "z")] * 4) for n in [10 + i * (2 if m == "a" else 3)]]
    return spark.createDataFrame(rows, "model string, true_label string, pred_label string, correct boolean, "
                                       "text_length int, word_count int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_report_equals_the_single_tables(spark):
    pred = predictions(spark)
    rep = report.prediction_report(pred)
    e, b = report.error_analysis(rep), report.bias_analysis(rep)
    for m in ("a", "b"):
        one = pred.where(F.col("model") == m)
        assert rows_of(e["summary"].where(F.col("model") == m).drop("model")) == rows_of(errors.error_summary(one))
        assert rows_of(e["per_class"].where(F.col("model") == m).drop("model")) == rows_of(errors.error_rate_by_class(one))
        assert rows_of(b["length_profile"].where(F.col("model") == m).drop("model")) == rows_of(bias.length_profile(one, "true_label"))
        assert rows_of(b["disparities"].where(F.col("model") == m).drop("model")) == rows_of(bias.performance_disparities(one))
        top = e["confusions"].where(F.col("model") == m).drop("model").orderBy(F.desc("n"), "true_label", "pred_label").limit(10)
        assert [tuple(r) for r in top.collect()] == [tuple(r) for r in errors.confusion_pairs_topk(one, 10).collect()]


def test_report_scans_once(spark, tmp_path):
    predictions(spark).write.parquet(str(tmp_path / "p"))
    found = []
    staged = report.staged
    report.staged = lambda df: found.append(df) or staged(df)
    try:
        rep = report.prediction_report(spark.read.parquet(str(tmp_path / "p")))
    finally:
        report.staged = staged
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") >= 1
    assert report.bias_analysis(rep)["disparities"].count() == 6


def vectors(spark, classes, n=180, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % classes
        x = np.abs(rng.normal(size=6) * 0.4 + np.eye(6)[c] * 1.5)
        part = i // classes % 9
        rows.append((i, float(c), 1.0, part // 3, part % 3, Vectors.sparse(6, range(6), x.tolist())))
    return spark.createDataFrame(rows, ["doc_id", "label", "weight", "fold", "inner", "features"])


@pytest.mark.parametrize("classes", [2, 3])
def test_grid_search_scores_every_value_and_refits(spark, classes, monkeypatch):
    monkeypatch.setattr(models, "SVC_ITERATIONS", 15)  # the search is tested, not the solver
    grids = {"logistic_regression": ("C", (0.001, 1.0)), "multinomial_naive_bayes": ("alpha", (1.0,)), "linear_svm": ("C", (1.0,))}
    train = vectors(spark, classes).coalesce(1).persist()
    table, best = tuning.grid_search(train, grids=grids)
    rows = {(r.model, r.value): r for r in table.collect()}
    assert len(rows) == 4 and sum(r.is_best for r in rows.values()) == 3
    # one score again, by hand
    score = []
    for fold in range(3):
        m = models.make_lr(120, C=1.0).fit(train.where(f"fold <> {fold}"))
        score.append(models.MacroF1Evaluator("label", "prediction").evaluate(m.transform(train.where(f"fold = {fold}"))))
    assert rows["logistic_regression", 1.0].mean_f1_macro == pytest.approx(np.mean(score))
    for name, (_, m) in best.items():
        out = m.transform(vectors(spark, classes, 60, 5))
        assert out.where("label = prediction").count() >= 48, name


@pytest.mark.parametrize("classes", [2, 3])
def test_certificate_tells_the_optimum(spark, classes):
    train = vectors(spark, classes)
    m = models.make_lr(180).fit(train)
    c = models.lr_certificate(train, m, 1.0 / 180)
    assert c["loss"] == pytest.approx(m.summary.objectiveHistory[-1], rel=1e-6)
    assert c["gradient_norm"] < 1e-3 and c["loss"] < c["null_loss"]
    early = models.make_lr(180, max_iter=1).fit(train)
    assert models.lr_certificate(train, early, 1.0 / 180)["gradient_norm"] > 10 * c["gradient_norm"]
