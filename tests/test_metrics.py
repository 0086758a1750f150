import pytest
from pyspark.sql import functions as F

from veritext.operators import metrics


def _pred(spark, t, p):
    return spark.createDataFrame(list(zip(t, p)), "true_label int, pred_label int")


def test_metrics_fixture(spark):
    cnt = metrics.confusion_counts(_pred(spark, [0, 0, 1, 1, 2], [0, 1, 1, 1, 1]))
    pc = {r.cls: r for r in metrics.per_class(cnt).collect()}
    assert pc[0].recall == 0.5 and pc[1].recall == 1.0 and pc[2].recall == 0.0
    assert pc[0].precision == 1.0 and pc[1].precision == 0.5 and pc[2].precision == 0.0
    assert pc[0].f1 == pytest.approx(2 / 3) and pc[2].f1 == 0.0
    s = metrics.summary_metrics(cnt).first()
    assert s.accuracy == pytest.approx(0.6)
    assert s.f1_macro == pytest.approx(0.4444444, abs=1e-6)
    assert s.f1_weighted == pytest.approx(0.5333333, abs=1e-6)


def test_label_union_includes_predicted_only_class(spark):
    cnt = metrics.confusion_counts(_pred(spark, [0, 0], [0, 1]))
    pc = {r.cls: r for r in metrics.per_class(cnt).collect()}
    assert set(pc) == {0, 1} and pc[1].support == 0 and pc[1].f1 == 0.0


def test_confusion_zero_filled(spark):
    cm = metrics.confusion_matrix(metrics.confusion_counts(_pred(spark, [0, 1, 2], [0, 0, 0])))
    assert cm.count() == 9 and cm.where("n = 0").count() == 6


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label_id int")
    w = {r.label_id: r.weight for r in metrics.class_weights(df).collect()}
    assert w[0] == pytest.approx(4 / 6) and w[1] == pytest.approx(2.0)
    tot = metrics.with_class_weight(df).agg(F.sum("weight")).first()[0]
    assert tot == pytest.approx(4.0)


def test_argmax_first_max(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>")
    assert df.select(metrics.array_argmax("x").alias("a")).first().a == 1


def test_generalization_gap(spark):
    m = spark.createDataFrame([("lr", "in", 0.6, 0.5), ("lr", "cross", 0.5, 0.3)],
                              "model string, domain string, accuracy double, f1_macro double")
    g = metrics.generalization_gap(m).first()
    assert g.generalization_gap_f1 == pytest.approx(0.2)
