"""Sinks (K1-K4) and the degenerate inputs of FIXTURES D."""
import glob
import os

from pyspark.sql import functions as F


def _csv_lines(path):
    files = sorted(glob.glob(os.path.join(path, "part-*.csv")))
    lines = []
    for f in files:
        with open(f) as fh:
            lines += [x.rstrip("\n") for x in fh if x.strip()]
    return lines


def test_error_sample_csv_keeps_header_when_empty(spark, tmpdir_path):
    from veritext.sources.sinks import write_error_samples
    empty = spark.createDataFrame([], "true_label string, pred_label string, text string, word_count int, extra int")
    out = os.path.join(tmpdir_path, "err")
    write_error_samples(empty, out)
    assert _csv_lines(out) == ["true_label,pred_label,text,word_count"]


def test_metrics_csv_and_cross_summary_by_direction(spark, tmpdir_path):
    from veritext.sources.sinks import write_cross_summary, write_metrics
    m = spark.createDataFrame([("lr", 0.5, 1.25)], "model string, accuracy double, train_time double")
    write_metrics(m, os.path.join(tmpdir_path, "m"))
    assert _csv_lines(os.path.join(tmpdir_path, "m")) == ["model,accuracy,train_time", "lr,0.5,1.25"]
    s = spark.createDataFrame([("nb", "a", "b", 0.1), ("nb", "b", "a", 0.2)],
                              "model string, source string, target string, generalization_gap_f1 double")
    path = os.path.join(tmpdir_path, "x")
    write_cross_summary(s, path)
    back = spark.read.option("header", True).csv(path)
    assert sorted((r.source, r.target) for r in back.collect()) == [("a", "b"), ("b", "a")]


def test_one_class_corpus(spark):
    """One class: the split is still exact, the balanced weight is 1, every
    metric is 1 and SMOTE has nothing to generate."""
    from veritext.operators import metrics, sampling
    from veritext.operators.balance import smote
    rows = [(i, "only", 0, [float(i), 1.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, label string, label_id int, vec array<double>")
    s = sampling.stratified_split(df, "label_id", "doc_id", 20, 10, 42)
    got = {r.split: r.n for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"test": 2, "val": 1, "train": 7}
    w = metrics.class_weights(df).collect()
    assert len(w) == 1 and abs(w[0].weight - 1.0) < 1e-12
    pred = df.select(F.col("label").alias("true_label"), F.col("label").alias("pred_label"))
    sm = metrics.summary_metrics(metrics.confusion_counts(pred)).first()
    assert sm.accuracy == 1.0 and sm.f1_macro == 1.0 and sm.f1_weighted == 1.0
    assert smote(df, "doc_id", "label_id", "vec", k=3).count() == 0


def test_class_absent_from_predictions_scores_zero(spark):
    from veritext.operators import metrics
    pred = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "true_label string, pred_label string")
    sm = metrics.summary_metrics(metrics.confusion_counts(pred)).first()
    # precision: a = 1/3, b = c = 0 (zero division -> 0); recall: a = 1
    assert abs(sm.precision_macro - (1 / 3) / 3) < 1e-9
    assert abs(sm.recall_macro - 1 / 3) < 1e-9
    assert abs(sm.accuracy - 1 / 3) < 1e-9
