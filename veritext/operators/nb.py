"""Multinomial naive Bayes as plain DataFrame/SQL over the long TF-IDF
table (M2), with balanced sample weights (B2) and Laplace/Lidstone alpha.

theta[c, t] = ln(F[c, t] + alpha) - ln(sum_t F[c, t] + alpha * V),
F[c, t] = sum over training docs d of class c of w_c * x[d, t],
log prior = ln(sum_{d in c} w_c / sum_d w_d) (uniform under balanced weights).

Scoring reads a row's sparse arrays (``TfidfModel.sparse_rows``) and one
parameter array per class (k * V numbers, V <= max_features), so it shuffles
nothing; ``predict_long`` scores a long table instead, with a (doc, class) sum
that is combined before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import array_argmax
from .tfidf import constant_array, generated


def nb_fit(train_long: DataFrame, train_docs: DataFrame, vocab: DataFrame, label_col: str = "label_id",
           id_col: str = "doc_id", alpha: float = 1.0, balanced: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (theta: label_id, term, theta) and (prior: label_id, log_prior).

    ``train_docs`` = all training rows (id, label) incl. rows without terms;
    ``train_long`` = (id, label, term, weight)."""
    cnt = train_docs.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    rows = cnt.collect()  # k rows, one job
    n, k = sum(int(r["n_c"]) for r in rows), len(rows)
    if balanced:
        w = {r[label_col]: n / (k * r["n_c"]) for r in rows}
    else:
        w = {r[label_col]: 1.0 for r in rows}
    mass = {c: w[c] * r["n_c"] for c, r in zip(w, rows)}
    total_mass = sum(mass.values())
    spark = train_long.sparkSession
    prior = spark.createDataFrame([(int(c), float(math.log(m / total_mass))) for c, m in mass.items()],
                                  f"{label_col} int, log_prior double")
    wdf = spark.createDataFrame([(int(c), float(v)) for c, v in w.items()], f"{label_col} int, _sw double")
    # the weight is constant in a class: sum first, weigh the k x V sums
    if {"term_index"} <= {*train_long.columns} & {*vocab.columns}:  # the k x V sums get their terms, not the rows
        sums = train_long.groupBy(label_col, "term_index").agg(F.sum("weight").alias("_f")).join(
            vocab.select("term", "term_index"), "term_index")
    else:
        sums = train_long.groupBy(label_col, "term").agg(F.sum("weight").alias("_f"))
    fc = (sums.join(F.broadcast(wdf), label_col).select(label_col, "term", (F.col("_sw") * F.col("_f")).alias("fc")))
    classes = sorted(int(c) for c in w)
    v_terms = vocab.select("term")
    grid = v_terms.select("term", F.explode(F.array(*[F.lit(c) for c in classes])).alias(label_col))
    full = grid.join(fc, [label_col, "term"], "left").withColumn("fc", F.coalesce("fc", F.lit(0.0)))
    vsize = F.count(F.lit(1)).over(Window.partitionBy(label_col))
    tot_fc = F.sum("fc").over(Window.partitionBy(label_col))
    theta = full.select(label_col, "term",
                        (F.log(F.col("fc") + alpha) - F.log(tot_fc + F.lit(alpha) * vsize)).alias("theta"))
    return theta, prior


def nb_parameters(theta: DataFrame, prior: DataFrame, vocab: DataFrame,
                  label_col: str = "label_id") -> list[tuple[int, float, list[float]]]:
    """(class, log prior, theta by term index) in class order: k x V numbers."""
    priors = {r[label_col]: r["log_prior"] for r in prior.collect()}
    index = vocab.select("term", "term_index")
    arrays = theta.join(index, "term").groupBy(label_col).agg(
        F.array_sort(F.collect_list(F.struct("term_index", "theta"))).alias("t"))
    by_class = {r[label_col]: [x["theta"] for x in r["t"]] for r in arrays.collect()}
    return [(int(c), float(priors[c]), by_class.get(c, [])) for c in sorted(priors)]


def nb_scores(parameters: list[tuple[int, float, list[float]]]) -> F.Column:
    """Array of log scores in class order, of a row with ``term_indices`` and
    ``weights``."""
    def score(log_prior: float, theta: list[float]) -> F.Column:
        by_index = constant_array(theta, "double")
        parts = F.zip_with("term_indices", "weights", lambda i, w: w * F.get(by_index, i))
        return F.lit(log_prior) + F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.array(*[score(p, t) for _, p, t in parameters])


def nb_predict(rows: DataFrame, parameters: list[tuple[int, float, list[float]]], id_col: str = "doc_id",
               keep: list[str] | None = None, pred_col: str = "pred_id") -> DataFrame:
    """Arg-max of log prior + sum_t x[d,t] * theta[c,t] for each of the
    ``sparse_rows``; first maximum wins (smallest class id), matching numpy
    ``argmax``.  (id, keep..., pred_id, scores, probabilities): one row per
    row, nothing is shuffled."""
    columns = [id_col, *(keep or [])]
    scored = generated(rows, nb_scores(parameters), "scores")
    classes = F.array(*[F.lit(c) for c, _, _ in parameters])
    best = F.array_max("scores")
    scored = generated(scored, F.transform("scores", lambda s: F.exp(s - best)), "_odds")
    total = F.aggregate("_odds", F.lit(0.0), lambda s, x: s + x)
    scored = generated(scored, total, "_total")
    return scored.select(*columns, F.get(classes, array_argmax("scores")).cast("int").alias(pred_col), "scores",
                         F.transform("_odds", lambda x: x / F.col("_total")).alias("probabilities"))


def predict_long(test_long: DataFrame, test_docs: DataFrame, theta: DataFrame, prior: DataFrame,
                 label_col: str = "label_id", id_col: str = "doc_id", pred_col: str = "pred_id") -> DataFrame:
    """``nb_predict`` of a long table (id, term, weight): (id, pred_id, score).
    Spark chooses how to join the parameters by their size."""
    th = theta.select(F.col(label_col).alias("_c"), "term", "theta")
    # sum per (doc, class) before anything is shuffled: the partial
    # aggregation turns terms x k rows into docs x k rows map-side
    contrib = (test_long.select(id_col, "term", "weight").join(th, "term")
                        .groupBy(id_col, "_c").agg(F.sum(F.col("weight") * F.col("theta")).alias("_s")))
    pr = prior.select(F.col(label_col).alias("_c"), "log_prior")
    classes = [r[0] for r in prior.select(label_col).collect()]  # k values
    base = test_docs.select(id_col, F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("_c"),
                            F.lit(0.0).alias("_s"))
    allrows = base.unionByName(contrib).repartition(id_col)
    per = (allrows.groupBy(id_col, "_c").agg(F.sum("_s").alias("_s"))
                  .join(F.broadcast(pr), "_c")
                  .withColumn("score", F.col("_s") + F.col("log_prior")))
    best = per.groupBy(id_col).agg(F.max(F.struct(F.col("score"), (-F.col("_c")).alias("_neg"))).alias("_b"))
    return best.select(id_col, (-F.col("_b._neg")).cast("int").alias(pred_col), F.col("_b.score").alias("score"))


def top_features(theta: DataFrame, n: int = 10, label_col: str = "label_id") -> DataFrame:
    """Top-n terms per class by theta (ties by term) (W3), via WindowGroupLimit."""
    # rank on theta rounded to 1e-9 so summation-order noise cannot reorder ties
    w = Window.partitionBy(label_col).orderBy(F.desc(F.round("theta", 9)), "term")
    return (theta.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))
