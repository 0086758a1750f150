import pytest
from pyspark.sql import functions as F

from veritext.operators import bias, errors

NAMES = {0: "true", 1: "fake"}


def _pred(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, true_id int, pred_id int")
    return errors.collect_errors(df, NAMES, keep=["doc_id"])


def test_collect_errors_columns_and_fallback(spark):
    p = _pred(spark, [(1, "a b", 0, 7)]).first()
    assert p.pred_label == "7" and p.correct is False and p.word_count == 2 and p.text_length == 3


def test_error_samples_empty_when_no_errors(spark):
    p = _pred(spark, [(1, "a", 0, 0), (2, "b", 1, 1)])
    out = errors.error_samples(p, ["doc_id"])
    assert out.count() == 0 and out.columns == ["true_label", "pred_label", "text", "word_count"]


def test_error_samples_first_n_in_order(spark):
    rows = [(i, f"t{i}", 0, 1) for i in range(10)]
    out = errors.error_samples(_pred(spark, rows), ["doc_id"], n=5,
                               cols=["doc_id"]).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 2, 3, 4]


def test_crosstab_all_classes(spark):
    p = _pred(spark, [(1, "a", 0, 1)])
    ct = {r.true_label: r for r in errors.error_crosstab(p, ["true", "fake"]).collect()}
    assert set(ct) == {"true", "fake"} and ct["true"]["fake"] == 1 and ct["fake"]["true"] == 0


def test_histogram_density_integrates_to_one(spark):
    df = spark.range(100).select((F.col("id") % 17).alias("v"), F.lit(1).alias("g"))
    h = errors.histogram(df, "v", ["g"], 30).collect()
    assert sum(r.density * (r.bin_end - r.bin_start) for r in h) == pytest.approx(1.0)
    assert sum(r["count"] for r in h) == 100


def test_histogram_degenerate_range(spark):
    df = spark.createDataFrame([(5, 1), (5, 1)], "v int, g int")
    h = errors.histogram(df, "v", ["g"], 30).collect()
    full = [b for b in h if b["count"]]
    assert len(h) == 30 and len(full) == 1 and full[0].bin_start <= 5 <= full[0].bin_end


def test_imbalance_inf(spark):
    c = spark.createDataFrame([("train", 0, 5), ("train", 1, 0)], "split string, label_id int, n long")
    assert bias.imbalance_ratio(c, ["split"]).first().imbalance_ratio == float("inf")


def test_length_profile_population_std(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3)], "c string, text_length int")
    r = bias.length_profile(df, "c").first()
    assert r.mean_length == 2 and r.median_length == 2 and r.std_length == pytest.approx(1.0)
