import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veritext.functions.hashing import hash_key
from veritext.operators import sampling


def _df(spark, n=2000, k=3):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % k).cast("int").alias("label_id"))


def test_split_is_exact_partition_and_stratified(spark):
    df = _df(spark)
    s = sampling.stratified_split(df, "label_id", "doc_id", 20, 10)
    assert s.count() == 2000 and s.select("doc_id").distinct().count() == 2000
    for r in s.groupBy("label_id").agg(F.count("*").alias("n"),
                                       F.count_if(F.col("split") == "test").alias("t"),
                                       F.count_if(F.col("split") == "val").alias("v")).collect():
        assert r.t == (r.n * 20 + 99) // 100
        assert r.t + r.v == (r.n * 30 + 99) // 100


def test_split_invariant_under_repartition(spark):
    df = _df(spark)
    a = {r.doc_id: r.split for r in sampling.stratified_split(df).collect()}
    b = {r.doc_id: r.split for r in sampling.stratified_split(df.repartition(13)).collect()}
    assert a == b


def test_two_level_rank_equals_window(spark):
    from pyspark.sql import Window
    from veritext.functions.hashing import hash_key
    df = _df(spark, 3000, 2)
    r = sampling.exact_rank(df, ["label_id"], "doc_id", 42, bits=6, size_col=None)
    w = Window.partitionBy("label_id").orderBy(hash_key(42, "doc_id"), "doc_id")
    ref = df.withColumn("_ref", F.row_number().over(w) - 1)
    j = r.join(ref, ["doc_id", "label_id"])
    assert j.where(F.col("_rank") != F.col("_ref")).count() == 0


def test_kfold_balanced(spark):
    f = sampling.kfold_assign(_df(spark, 999, 3), 3)
    sizes = [r["count"] for r in f.groupBy("label_id", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_hash_sample_exact_size_and_deterministic(spark):
    df = _df(spark)
    a = sorted(r.doc_id for r in sampling.hash_sample(df, 50).collect())
    b = sorted(r.doc_id for r in sampling.hash_sample(df.repartition(7), 50).collect())
    c = sorted(r.doc_id for r in sampling.hash_sample(df, 50, bits=0).collect())
    assert len(a) == 50 and a == b == c


def test_hash_sample_equals_the_order(spark):
    df = spark.range(0, 3000, numPartitions=6).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"),
                                                      F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("h"))
    want = {r.doc_id for r in df.orderBy(hash_key(42, "doc_id"), "doc_id").limit(250).collect()}
    assert {r.doc_id for r in sampling.hash_sample(df, 250).collect()} == want
    assert sampling.hash_sample(df, 5000).count() == 3000 and sampling.hash_sample(df, 0).count() == 0
    by = sampling.hash_sample(df, 40, strata=["g", "h"]).groupBy("g", "h").count().collect()
    assert len(by) == 21 and {r["count"] for r in by} == {40}
    assert sampling.hash_sample(df.limit(0), 5).collect() == []


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds_equal_the_window(spark, k):
    df = spark.range(0, 500, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "few")
                                                     .when(F.col("id") < 300, "many").otherwise("some").alias("label"))
    w = Window.partitionBy("label")
    rank = F.row_number().over(w.orderBy(hash_key(42, "doc_id"), "doc_id")) - 1
    rows = df.select("doc_id", F.floor(rank * k / F.count("*").over(w)).alias("f")).collect()
    out = sampling.kfold_assign(df, k, "label", "doc_id").collect()
    assert {r.doc_id: r.fold for r in out} == {r.doc_id: r.f for r in rows}


def test_folds_and_samples_shuffle_no_text(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label_id"), F.lit("t").alias("text"))
    for out in (sampling.kfold_assign(df), sampling.hash_sample(df, 10), sampling.hash_sample(df, 10, strata=["label_id"])):
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
