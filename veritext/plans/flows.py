"""End-to-end plans.

Everything returns DataFrames (printed banners of the original become
tables).  Each analysis reads ONE cached prediction table; all models are
evaluated by one ``groupBy(model, true, pred)``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import name_for_id
from ..operators import bias, errors, metrics, models, nb, sampling
from ..operators.encode import encode_fixed_length
from ..operators.tfidf import fit_tfidf, staged_vectors
from ..session import staged
from ..sources.tables import labelled_corpus
from .common import SEED, cleaned_corpus


def run_error_analysis(pred: DataFrame, classes: list[str], order_cols: list[str] | None = None,
                       n_samples: int = 5) -> dict[str, DataFrame]:
    """C2 over one prediction table (text, true/pred ids+labels, correct, lengths)."""
    p = pred.cache()
    return {
        "summary": errors.error_summary(p),
        "per_class": errors.error_rate_by_class(p),
        "top_pairs": errors.confusion_pairs_topk(p, 10),
        "mean_words": errors.mean_words_by_correctness(p),
        "crosstab": errors.error_crosstab(p, classes),
        "length_histogram": errors.histogram(p, "word_count", ["correct"], 30),
        "samples": errors.error_samples(p, order_cols or ["doc_id"], n_samples),
    }


def run_bias_analysis(split_df: DataFrame, pred: DataFrame, label_col: str = "label_id",
                      resampled_train: DataFrame | None = None) -> dict[str, DataFrame]:
    """Class counts per split (before and, when given, after resampling),
    imbalance ratio, per-class disparities, length profile per class."""
    counts = bias.split_class_counts(split_df, "split", label_col)
    out = {
        "class_counts": counts,
        "imbalance": bias.imbalance_ratio(counts, ["split"]),
        "disparities": bias.performance_disparities(pred),
        "length_profile": bias.length_profile(pred, "true_label"),
    }
    if resampled_train is not None:
        rc = resampled_train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
        out["class_counts_resampled"] = rc
        out["imbalance_resampled"] = bias.imbalance_ratio(rc)
    return out


def evaluate_all(pred_all: DataFrame, model_col: str = "model") -> dict[str, DataFrame]:
    """Metrics, per-class report and confusion matrices of every model
    from one aggregation."""
    cnt = metrics.confusion_counts(pred_all, "true_label", "pred_label", [model_col]).cache()
    summary = metrics.summary_metrics(cnt, [model_col])
    return {
        "metrics": summary,
        "report": metrics.class_report(cnt, [model_col]),
        "confusion": metrics.confusion_matrix(cnt, [model_col]),
        "confusion_normalized": metrics.confusion_normalized(metrics.confusion_matrix(cnt, [model_col]), [model_col]),
        "comparison": metrics.model_comparison(summary, [model_col]),
    }


def run_baseline(spark: SparkSession, sf_dir: str, use_smote: bool = False, class_weight: bool = True,
                 max_features: int = 10000) -> dict[str, DataFrame]:
    """Corpus -> clean -> exact 70/10/20 split -> TF-IDF on train ->
    LR / NB / calibrated SVM -> one evaluation pass -> error + bias analytics."""
    s = sampling.stratified_split(cleaned_corpus(spark, sf_dir), "label_id", "doc_id", 20, 10, SEED)
    rows = s.where(F.col("split") == "train")
    tf = fit_tfidf(rows, max_features=max_features)
    folded = sampling.kfold_assign(rows, 3, "label_id", "doc_id", SEED)
    train = models.balanced_weights(tf.transform_vectors(folded, keep=["label_id", "split", "clean_text", "fold"])
                                    .withColumn("label", F.col("label_id").cast("double")))
    resampled = None
    if use_smote:
        from ..operators.balance import smote_sparse
        original = staged(tf.sparse_rows(rows, keep=["label_id"])).withColumn("doc_id", F.col("doc_id").cast("string"))
        syn = smote_sparse(tf.sparse_rows(rows, keep=["label_id"]), k=5, seed=SEED)
        extra = syn.select(F.concat(F.lit("smote-"), F.col("label").cast("string"), F.lit("-"),
                                    F.col("syn_idx").cast("string")).alias("doc_id"), F.col("label").alias("label_id"),
                           F.col("indices").alias("term_indices"), F.col("values").alias("weights"))
        resampled = staged(original.drop("tf").unionByName(extra))
        folded = sampling.kfold_assign(resampled, 3, "label_id", "doc_id", SEED)
        train = staged_vectors(folded, ["doc_id", "label_id", "fold"], tf.vocab_size, "term_indices", "weights")
        train = models.balanced_weights(train.withColumn("label", F.col("label_id").cast("double")))
    n = train.count()
    test = tf.transform_vectors(s.where(F.col("split") == "test"), keep=["label_id", "split", "clean_text"]) \
        .withColumn("label", F.col("label_id").cast("double"))
    fitted, times = {}, {}
    t0 = time.time(); fitted["logistic_regression"] = models.make_lr(n, weighted=class_weight).fit(train); times["logistic_regression"] = time.time() - t0
    t0 = time.time(); fitted["multinomial_naive_bayes"] = models.make_nb(1.0).fit(train); times["multinomial_naive_bayes"] = time.time() - t0
    t0 = time.time(); svm = models.fit_calibrated_svc(train, weighted=class_weight); times["linear_svm"] = time.time() - t0
    names = {r.label_id: r.label for r in s.groupBy("label_id").agg(F.min_by("label", "doc_id").alias("label")).collect()}
    preds = []
    for name, m in fitted.items():
        preds.append(m.transform(test).select(F.lit(name).alias("model"), "doc_id", "label_id", "prediction"))
    preds.append(svm.transform(test).select(F.lit("linear_svm").alias("model"), "doc_id", "label_id", "prediction"))
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    allp = allp.select("model", "doc_id", name_for_id(F.col("label_id"), names).alias("true_label"),
                       name_for_id(F.col("prediction").cast("int"), names).alias("pred_label"),
                       F.col("label_id").alias("true_id"), F.col("prediction").cast("int").alias("pred_id"))
    ev = evaluate_all(allp)
    tt = spark.createDataFrame(list(times.items()), "model string, train_time double")
    ev["metrics"] = ev["metrics"].join(tt, "model", "left")
    last = allp.where(F.col("model") == "linear_svm").join(test.select("doc_id", F.col("clean_text").alias("text")), "doc_id")
    last = last.withColumn("correct", F.col("true_id") == F.col("pred_id")) \
               .withColumn("text_length", F.length("text")).withColumn("word_count", F.size(F.split("text", " ")))
    out = dict(ev)
    out.update({f"errors_{k}": v for k, v in run_error_analysis(last, sorted(names.values())).items()})
    out.update({f"bias_{k}": v for k, v in run_bias_analysis(s, last, resampled_train=resampled).items()})
    return out


def nb_gap_direction(corpus: DataFrame, source_lang: str | None, source_name: str, target_name: str) -> DataFrame:
    """One direction of C6 with the SQL naive Bayes (in = source test, cross = target)."""
    from .transfer import nb_cross_domain_split
    return nb_cross_domain_split(corpus, source_lang, source_name, target_name)


def run_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions, keyed by (source, target) so nothing overwrites."""
    corpus = cleaned_corpus(spark, sf_dir)  # preprocessed once for both directions
    a = nb_gap_direction(corpus, "en", "en", "other")
    b = nb_gap_direction(corpus, None, "other", "en")
    return a.unionByName(b)


# The whitespace class of the raw-token arm (ASCII whitespace).
RAW_WS_RUN = r"[ \t\n\x0B\f\r]+"


def run_transformer_arm(spark: SparkSession, sf_dir: str, max_length: int = 128) -> dict[str, DataFrame]:
    """C9 data flow: RAW text (lower-cased tokens, no cleaning rules), exact
    70/15/15 split, every window of every text.  The network itself is
    external (batch scorer)."""
    c = labelled_corpus(spark, sf_dir)
    s = sampling.stratified_split(c.select("doc_id", "label_id"), "label_id", "doc_id", 15, 15, SEED)
    # Java's \s spelled out, so the SQL oracle's regex means the same
    raw = c.select("doc_id", F.regexp_replace(F.lower("text"), RAW_WS_RUN, " ").alias("clean_text"))
    return {"split": s, "encoded": encode_fixed_length(raw, max_length=max_length),
            "weights": metrics.class_weights(s.where(F.col("split") == "train"))}
