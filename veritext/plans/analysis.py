"""Registered composites: error and bias analysis of several models in one
scan, reports of all models, cross-corpus comparison, JSON of both shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import BINARY_NAMES, name_for_id
from ..functions.text import char_length, word_count
from ..operators import metrics, report
from ..operators.tfidf import generated
from ..sources.json_rows import articles, json_field
from ..sources.tables import read_table
from .queries import multi_model_predictions, query, r6, topic_filter


def rule_predictions(spark, d):
    """Three rule 'models' over the labelled documents, scored in one pass.
    Lengths are computed on the document side, before the join."""
    docs = read_table(spark, d, "documents").select("doc_id", char_length("text").alias("text_length"),
                                                    word_count("text").alias("word_count"))
    labels = read_table(spark, d, "labels").select("doc_id", "quality", "toxic").where(
        "quality is not null and toxic is not null")
    preds = F.array(*[F.struct(F.lit(name).alias("model"), p.cast("int").alias("pred_id")) for name, p in (
        ("toxic_rule", F.col("toxic")), ("length_rule", F.col("text_length") > 2000), ("always_true", F.lit(1)))])
    rows = docs.join(labels, "doc_id").select("doc_id", F.col("quality").cast("int").alias("true_id"), "text_length",
                                              "word_count", F.inline(preds))
    return rows.select("model", name_for_id(F.col("true_id"), BINARY_NAMES).alias("true_label"),
                       name_for_id(F.col("pred_id"), BINARY_NAMES).alias("pred_label"),
                       (F.col("true_id") == F.col("pred_id")).alias("correct"), "text_length", "word_count")


@query("prediction_report")
def q_prediction_report(spark, d):
    """C2 and C3 in one scan: every section of the report of three models."""
    out = report.prediction_report(rule_predictions(spark, d))
    return out.select("model", "section", "true_label", "pred_label", "correct", "n", "errors",
                      *[r6(c).alias(c) for c in ("words", "mean_length", "median_length", "std_length")])


@query("error_analysis_all")
def q_error_analysis_all(spark, d):
    """Summary and error rate per class of every model."""
    t = report.error_analysis(report.prediction_report(rule_predictions(spark, d)))
    total = t["summary"].select("model", F.lit("(all)").alias("true_label"), F.col("total").alias("n"), "errors",
                                r6(F.col("error_pct") / 100).alias("error_rate"))
    return total.unionByName(t["per_class"].withColumn("error_rate", r6("error_rate")))


@query("bias_analysis_all")
def q_bias_analysis_all(spark, d):
    """Per-class scores, the underserved flag and the length profile of every model."""
    t = report.bias_analysis(report.prediction_report(rule_predictions(spark, d)))
    lengths = t["length_profile"].select("model", F.col("true_label").alias("cls"), "mean_length", "median_length", "std_length")
    out = t["disparities"].join(lengths, ["model", "cls"], "left")
    return out.select("model", "cls", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support", "underserved",
                      *[r6(c).alias(c) for c in ("mean_length", "median_length", "std_length")])


@query("class_report_by_model")
def q_report_by_model(spark, d):
    """The class report of every model from one aggregation."""
    rep = metrics.class_report(metrics.confusion_counts(multi_model_predictions(spark, d), group=["model"]), ["model"])
    return rep.select("model", "row", *[r6(c).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


@query("confusion_by_model")
def q_confusion_by_model(spark, d):
    """Confusion matrices, counts and rates, of every model."""
    cnt = metrics.confusion_counts(multi_model_predictions(spark, d), group=["model"])
    cm = metrics.confusion_normalized(metrics.confusion_matrix(cnt, ["model"]), ["model"])
    return cm.select("model", "true_label", "pred_label", "n", r6("rate").alias("rate"))


@query("domain_comparison")
def q_domain_comparison(spark, d):
    """Metrics in long form, keyed by model and domain (in: shipped by air, cross: all others)."""
    li = read_table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_linestatus") == "F", "in").otherwise("cross").alias("domain"),
                     F.col("l_returnflag").alias("true_label"),
                     F.when(F.col("l_discount") >= 0.05, "R").otherwise("N").alias("pred_label"))
    s = metrics.summary_metrics(metrics.confusion_counts(rows, group=["domain"]), ["domain"])
    long = metrics.model_comparison(s.withColumn("model", F.lit("discount_rule")), ["model", "domain"])
    return long.select("model", "domain", "metric", r6("value").alias("value"))


@query("log_loss_weighted")
def q_log_loss_weighted(spark, d):
    """A24 with row weights (balanced class weights, as in the deep model's loss)."""
    e = read_table(spark, d, "embeddings").where("label is not null")
    # generated columns: the maximum and the sum are taken once a row, not once an element
    rows = generated(e, F.array_max("embedding").cast("double"), "m")
    rows = generated(rows, F.transform("embedding", lambda v: F.exp(v.cast("double") - F.col("m"))), "ex")
    rows = generated(rows, F.aggregate("ex", F.lit(0.0), lambda a, b: a + b), "total")
    rows = rows.select("label", F.transform("ex", lambda v: v / F.col("total")).alias("p"))
    rows = metrics.with_class_weight(rows, "label", "w")
    return metrics.log_loss(rows, "p", "label", "w").select(r6("log_loss").alias("log_loss"))


@query("labels_last_wins_join")
def q_labels_join(spark, d):
    """J2 as a join: orders labelled by their customer's last event type."""
    e = read_table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("label"))
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(e, F.col("o_custkey") == F.col("user_id")).select("o_orderkey", "label")


# lists that occur in the given tables (the fixed ones are of another corpus)
TOPIC_SOURCES, TOPIC_KEYWORDS = ["src3", "src7"], ["thing", "leaux", "schein"]


@query("topic_filter_lists")
def q_topic_lists(spark, d):
    """P3 with lists of its own: by source or by keyword."""
    t = read_table(spark, d, "documents")
    return topic_filter(t, "source", "text", TOPIC_SOURCES, TOPIC_KEYWORDS).select("doc_id", "source")


def props_json(event_id, props):
    """The events' JSON in four shapes: object, array of three, other keys, null value."""
    n = F.pmod(event_id, F.lit(4))
    return (F.when(n == 0, props).when(n == 1, F.concat(F.lit("["), props, F.lit(',{"k":null},{"x":1}]')))
            .when(n == 2, F.lit('{"x":2}')).otherwise(F.lit('{"k":null}')))


@query("json_variant")
def q_json_variant(spark, d):
    """T22 over objects and arrays: one row per element, an absent key told from a null one."""
    e = read_table(spark, d, "events")
    rows = e.select("event_id", F.posexplode(articles(props_json(F.col("event_id"), F.col("props")))).alias("pos", "v"))
    present, value = json_field(F.col("v"), "k")
    return rows.select("event_id", "pos", present.alias("present"), value.alias("k"))
