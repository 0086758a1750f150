"""Work that must not grow faster than the rows."""
import re

import pytest
from pyspark.sql import functions as F

from veritext.operators import lemma, nb, tfidf, tuning
from veritext.plans import flows, queries, transfer
from veritext.session import staged
from veritext.sources import tables

TEXTS = ["cats sat near dogs", "dogs ran near cats", "birds sang songs often", "birds sang near cats", "dogs bark often"]


def corpus(spark, n=60):
    """Preprocessed rows; the last word tells the label."""
    rows = [(i, "en" if i % 2 else "de", i // 2 % 2, ("fake", "true")[i // 2 % 2],
             f"{TEXTS[i % 5]} {('lie', 'fact')[i // 2 % 2]}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, lang string, label_id int, label string, clean_text string")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_log_loss_takes_maximum_and_sum_once_a_row(spark, tmpdir_path):
    rows = [(1, 0, [1.0, 2.0]), (2, 1, [0.5, 0.5]), (3, 1, [3.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmpdir_path}/embeddings.parquet")
    out = queries.q_log_loss(spark, tmpdir_path)
    assert _plan(out).count("array_max(") == 1 and _plan(out).count("aggregate(") == 1
    assert out.first().log_loss == pytest.approx((1.313262 + 0.693147 + 2.126928) / 3, abs=2e-6)


def test_both_directions_share_one_preprocessing(spark, monkeypatch):
    calls = []

    def cleaned(*_):
        calls.append(1)
        return staged(corpus(spark))

    monkeypatch.setattr(flows, "cleaned_corpus", cleaned)
    monkeypatch.setattr(transfer, "cleaned_corpus", cleaned)
    out = flows.run_bidirectional(spark, "unused").collect()
    assert {(r.source, r.target) for r in out} == {("en", "other"), ("other", "en")}
    assert len(calls) == 1


def test_solvers_side_by_side_read_few_partitions(spark):
    train = staged(corpus(spark).repartition(8))
    few = tuning.compact(train)
    assert train.rdd.getNumPartitions() > 1 and few.rdd.getNumPartitions() == 1
    assert sorted(few.collect()) == sorted(train.collect())
    assert tuning.compact(corpus(spark)).count() == 60  # rows that are not stored


def test_tasks_that_hold_terms_read_bounded_input(spark, tmpdir_path, monkeypatch):
    docs = corpus(spark, 2000).select("doc_id", F.concat("clean_text", F.lit(" x"), F.sha2(F.col("doc_id").cast("string"), 256)).alias("text"))
    docs.repartition(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    seen = []
    count = queries.term_stats
    monkeypatch.setattr(queries, "TERM_BYTES", 2048)
    monkeypatch.setattr(queries, "term_stats", lambda df, *a, **k: seen.append(df.rdd.getNumPartitions()) or count(df, *a, **k))
    out = {r.term: (r.df, r.total_tf) for r in queries.q_bigrams(spark, tmpdir_path).collect()}
    assert out["sat near"] == (400, 400)
    assert seen[0] > max(8, spark.sparkContext.defaultParallelism)
    assert tables.spread(spark.range(5), ["id"]).count() == 5


def test_terms_are_sorted_and_filtered_without_lambdas(spark):
    df = corpus(spark)
    assert "lambda" not in _plan(tfidf.term_stats(df))
    table = spark.createDataFrame([("cats", "cat", 36)], "token string, lemma string, df long")
    out = lemma.lemmatise_text(df, table)
    assert "filter(array_distinct" not in _plan(out) and "cat sat near dogs lie" in {r.lemma_text for r in out.collect()}


def test_nb_sums_by_term_number(spark):
    df = corpus(spark)
    m = tfidf.fit_tfidf(df)
    long = m.transform_long(df, keep=["label_id"])
    theta, _ = nb.nb_fit(long, df, m.vocab)
    by_term, _ = nb.nb_fit(long.drop("term_index"), df, m.vocab)
    numbered = re.compile(r"Aggregate \[label_id#\d+, term_index#\d+\]")
    assert numbered.search(_plan(theta)) and not numbered.search(_plan(by_term))
    got = {(r.label_id, r.term): r.theta for r in theta.collect()}
    for r in by_term.collect():
        assert got[r.label_id, r.term] == pytest.approx(r.theta, abs=1e-12)
