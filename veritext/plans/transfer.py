"""Cross-corpus generalisation.

Source corpus = English labelled documents, target = the other languages.
Labels are harmonised to binary, the source is split 80/20 (exact,
stratified), TF-IDF is fitted on source-train only, and the in-domain test
rows and the whole target corpus are scored in ONE transform with a
``domain`` column, so both metric sets come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import harmonise_binary
from ..operators import metrics, models, nb, sampling
from ..operators.tfidf import fit_tfidf
from .common import SEED, cleaned_corpus


def _domains(corpus: DataFrame, source_lang: str | None = "en", pivot_lang: str = "en"):
    """source_lang=None means 'every language except pivot_lang' (reverse direction)."""
    c = harmonise_binary(corpus, "binary")
    is_pivot = F.col("lang") == pivot_lang
    src, tgt = (c.where(is_pivot), c.where(~is_pivot)) if source_lang else (c.where(~is_pivot), c.where(is_pivot))
    s = sampling.stratified_split(src, "label_id", "doc_id", 20, 0, SEED)
    return s, tgt


def nb_cross_domain(spark: SparkSession, d: str, source_lang: str = "en", target_name: str = "other") -> DataFrame:
    return nb_cross_domain_split(cleaned_corpus(spark, d), source_lang, source_lang, target_name)


def nb_cross_domain_split(corpus: DataFrame, source_lang: str | None, source_name: str,
                          target_name: str) -> DataFrame:
    """One direction over a preprocessed corpus."""
    s, tgt = _domains(corpus, source_lang)
    train = s.where(F.col("split") == "train")
    model = fit_tfidf(train, max_features=10000)
    tr_long = model.transform_long(train, keep=["label_id"])
    theta, prior = nb.nb_fit(tr_long, train, model.vocab)
    scored = (s.where(F.col("split") == "test").select("doc_id", "label_id", F.lit("in").alias("domain"), "clean_text")
               .unionByName(tgt.select("doc_id", "label_id", F.lit("cross").alias("domain"), "clean_text")))
    rows = model.sparse_rows(scored, keep=["label_id", "domain"])
    pred = nb.nb_predict(rows, nb.nb_parameters(theta, prior, model.vocab), keep=["label_id", "domain"])
    table = pred.select("domain", F.col("label_id").alias("true_label"), F.col("pred_id").alias("pred_label"))
    cnt = metrics.confusion_counts(table, group=["domain"])
    per_domain = metrics.summary_metrics(cnt, ["domain"]).withColumn("model", F.lit("multinomial_nb"))
    gap = metrics.generalization_gap(per_domain)
    return gap.select(
        "model", F.lit(source_name).alias("source"), F.lit(target_name).alias("target"),
        *[F.round(F.col(c), 6).alias(c) for c in
          ["in_dist_accuracy", "in_dist_f1_macro", "cross_accuracy", "cross_f1_macro", "generalization_gap_f1"]])


def cross_domain_models(spark: SparkSession, d: str, source_lang: str | None = "en", source_name: str = "en",
                        target_name: str = "other") -> DataFrame:
    """C6 with logistic regression and the calibrated SVM: both scored on the
    source's test rows and on the whole target, metrics of both models and
    domains from one aggregation; the gap per model."""
    s, tgt = _domains(cleaned_corpus(spark, d), source_lang)
    train = s.where(F.col("split") == "train")
    model = fit_tfidf(train, max_features=10000)
    label = F.col("label_id").cast("double")
    folded = sampling.kfold_assign(train, 3, "label_id", "doc_id", SEED)
    vectors = models.balanced_weights(model.transform_vectors(folded, keep=["label_id", "fold"]).withColumn("label", label))
    rows = (s.where(F.col("split") == "test").select("doc_id", "label_id", F.lit("in").alias("domain"), "clean_text")
             .unionByName(tgt.select("doc_id", "label_id", F.lit("cross").alias("domain"), "clean_text")))
    scored = model.transform_vectors(rows, keep=["label_id", "domain"])
    fitted = {"logistic_regression": models.make_lr(vectors.count()).fit(vectors),
              "linear_svm": models.fit_calibrated_svc(vectors)}
    parts = [m.transform(scored).select(F.lit(name).alias("model"), "domain", F.col("label_id").alias("true_label"),
                                        F.col("prediction").cast("int").alias("pred_label")) for name, m in fitted.items()]
    cnt = metrics.confusion_counts(parts[0].unionByName(parts[1]), group=["model", "domain"])
    gap = metrics.generalization_gap(metrics.summary_metrics(cnt, ["model", "domain"]))
    return gap.select("model", F.lit(source_name).alias("source"), F.lit(target_name).alias("target"),
                      *[F.round(F.col(c), 6).alias(c) for c in
                        ["in_dist_accuracy", "in_dist_f1_macro", "cross_accuracy", "cross_f1_macro", "generalization_gap_f1"]])
