"""Model-based queries (rows-only checks: MLlib optimisers are not SQL)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import metrics, models, sampling, tuning
from ..operators.scoring import LinearLogProbScorer, score_batches
from ..operators.tfidf import fit_tfidf
from ..session import staged
from ..sources.tables import read_table
from .common import SEED, preprocessor, split_corpus
from .queries import query


def features(spark, d, max_features: int = 10000, pre=None):
    """Split corpus -> TF-IDF fitted on train -> stored vectors for train and
    test rows, with balanced weights and stratified folds on the training rows."""
    s = split_corpus(spark, d, pre=pre)
    rows = s.where(F.col("split") == "train")
    tf = fit_tfidf(rows, max_features=max_features)
    # nine parts of each class from one set of thresholds: three folds, and three inner folds of any two of them
    folded = sampling.kfold_assign(rows, 9, "label_id", "doc_id", SEED, fold_col="part").select(
        "*", (F.col("part") / 3).cast("int").alias("fold"), (F.col("part") % 3).alias("inner"))
    label = F.col("label_id").cast("double")
    train = tf.transform_vectors(folded, keep=["label_id", "split", "fold", "inner"]).withColumn("label", label)
    test = tf.transform_vectors(s.where(F.col("split") == "test"), keep=["label_id", "split"]).withColumn("label", label)
    return tf, models.balanced_weights(train, "label_id", "weight"), test


def _pred_out(scored):
    return scored.select("doc_id", F.col("label_id").alias("true_id"), F.col("prediction").cast("int").alias("pred_id"))


@query("lr_predict")
def q_lr(spark, d):
    _, train, test = features(spark, d)
    n = train.count()
    m = models.make_lr(n).fit(train)
    out = m.transform(test)
    return out.select("doc_id", F.col("label_id").alias("true_id"), F.col("prediction").cast("int").alias("pred_id"),
                      F.round(F.array_max(vector_to_array("probability")), 6).alias("p_max"))


@query("svm_calibrated_predict")
def q_svm(spark, d):
    _, train, test = features(spark, d)
    m = models.fit_calibrated_svc(train)
    out = m.transform(test)
    return out.select("doc_id", F.col("label_id").alias("true_id"), F.col("prediction").cast("int").alias("pred_id"),
                      F.round(F.array_max("probability"), 6).alias("p_max"))


@query("nb_mllib_predict")
def q_nb_mllib(spark, d):
    _, train, test = features(spark, d)
    return _pred_out(models.make_nb(1.0).fit(train).transform(test))


@query("grid_search_scores")
def q_grid(spark, d):
    """3-fold stratified grid search, macro-F1, for LR (C), NB (alpha,
    unweighted as in the original) and the calibrated SVM (C).  The best value
    of each model is refitted on all training rows; its row holds the refitted
    model's accuracy and macro-F1 on the test rows."""
    _, train, test = features(spark, d)
    scores, best = tuning.grid_search(train)
    parts = [m.transform(test).select(F.lit(name).alias("model"), F.lit(value).alias("value"), F.col("label_id").alias("true_label"),
                                      F.col("prediction").cast("int").alias("pred_label")) for name, (value, m) in best.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    s = metrics.summary_metrics(metrics.confusion_counts(rows, group=["model", "value"]), ["model", "value"])
    tested = s.select("model", "value", F.round("accuracy", 6).alias("test_accuracy"), F.round("f1_macro", 6).alias("test_f1_macro"))
    return scores.withColumn("mean_f1_macro", F.round("mean_f1_macro", 6)).join(tested, ["model", "value"], "left")


@query("lr_certificate")
def q_lr_certificate(spark, d):
    """M1: one aggregation recomputes the loss and its gradient at the fitted
    weights; the fit is stationary, beats the zero weights, and did not end at
    its iteration limit."""
    _, train, _ = features(spark, d)
    n = train.count()
    m = models.make_lr(n).fit(train)
    c = models.lr_certificate(train, m, 1.0 / n)
    return spark.createDataFrame(
        [("logistic_regression", c["gradient_norm"] <= 1e-3, c["loss"] < c["null_loss"],
          m.summary.totalIterations < models.LR_ITERATIONS)],
        "model string, stationary boolean, not_worse_than_null boolean, ended_before_limit boolean")


@query("generalization_gap_models")
def q_gap_models(spark, d):
    """C6/C7 with LR and the calibrated SVM, English to the other languages."""
    from .transfer import cross_domain_models
    return cross_domain_models(spark, d)


@query("batch_score")
def q_batch_score(spark, d):
    """Score the unlabelled benchmark corpus with a naive Bayes model trained
    on the labelled corpus, through the pluggable mapInPandas scorer."""
    pre = preprocessor()
    tf, train, _ = features(spark, d, pre=pre)
    nbm = models.make_nb(1.0).fit(train)
    theta = nbm.theta.toArray()
    state = {"theta": theta, "prior": nbm.pi.toArray(),
             "classes": np.array([int(c) for c in range(theta.shape[0])], dtype=np.int32)}
    bc = spark.sparkContext.broadcast(state)  # k x V, V <= max_features
    # the training corpus's lemmas; every item is scored, an empty one by the prior
    bench = read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("clean_text"))
    bench = preprocessor(lemmaTable=pre.fitted_lemmas, dropEmpty=False).transform(bench)
    feats = tf.sparse_rows(bench).select(F.col("doc_id").alias("id"), F.col("term_indices").alias("idx"),
                                         F.col("weights").alias("val"))
    out = score_batches(feats, LinearLogProbScorer(bc))
    return out.select(F.col("id").alias("item_id"), "pred_id", F.round("p_max", 6).alias("p_max"))


@query("smote_embeddings")
def q_smote(spark, d):
    """SMOTE on the embeddings table: every label raised to the majority count."""
    from ..operators.balance import smote
    e = read_table(spark, d, "embeddings")
    out = smote(e, "vec_id", "label", "embedding", k=5, seed=SEED)
    return out.select("label", "syn_idx", "base_id", "nn_id", F.round("lam", 6).alias("lam"),
                      F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


def _train_rows(spark, d):
    """Sparse TF-IDF rows of the training documents."""
    s = split_corpus(spark, d)
    train = s.where(F.col("split") == "train")
    return fit_tfidf(train).sparse_rows(train, keep=["label_id"])


@query("smote_tfidf")
def q_smote_tfidf(spark, d):
    """B4 on the TF-IDF matrix: the training split's classes raised to the
    majority count; one row per synthetic row."""
    from ..operators.balance import smote_sparse
    out = smote_sparse(_train_rows(spark, d), k=5, seed=SEED)
    return out.select("label", "syn_idx", "base_id", "nn_id", F.round("lam", 6).alias("lam"),
                      "indices", F.transform("values", lambda v: F.round(v, 6)).alias("values"))


@query("smote_class_counts")
def q_smote_counts(spark, d):
    """Class counts and imbalance of the training split before and after SMOTE."""
    from ..operators import bias
    from ..operators.balance import smote_sparse
    rows = staged(_train_rows(spark, d))
    before = rows.select("label_id", F.lit("train").alias("split"))
    extra = smote_sparse(rows, k=5, seed=SEED).select(F.col("label").alias("label_id"))
    after = rows.select("label_id").unionByName(extra).withColumn("split", F.lit("train_resampled"))
    counts = staged(bias.split_class_counts(before.unionByName(after.select("label_id", "split"))))
    ratio = bias.imbalance_ratio(counts, ["split"]).select("split", F.round("imbalance_ratio", 6).alias("imbalance_ratio"))
    return counts.join(ratio, "split")


@query("baseline_metrics")
def q_baseline(spark, d):
    """LR, NB and calibrated SVM trained on the split corpus and evaluated
    in one aggregation (train_time is wall clock -> rows-only check)."""
    from .flows import run_baseline
    m = run_baseline(spark, d)["metrics"]
    return m.select("model", *[F.round(F.col(c), 6).alias(c) for c in metrics.METRIC_NAMES], "train_time")


@query("transformer_arm_encode")
def q_transformer_arm(spark, d):
    """C9 data flow: raw-text 70/15/15 split, fixed-length windows of all rows."""
    from .flows import run_transformer_arm
    out = run_transformer_arm(spark, d)
    return out["encoded"].join(out["split"], "doc_id")
