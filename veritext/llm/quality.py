"""Quality classifier by hierarchical empirical Bayes.

Document evidence: two logistic regressions (low quality, toxic) over style
ratios of the text and over the strongest words.  A word's evidence is its
shrunk log odds among labelled documents; words, and word beginnings of four
and five bytes, count.  Both are fitted on a bounded sample of the labelled rows
(``FIT_ROWS``), the word evidence on one half and the regression on the other,
so the regression sees evidence as it will be on new documents.

Site evidence: the classifier's probabilities of *all* documents are averaged
per host (``source``) and path (``source, lang``) by grouped aggregation.  A
host's posterior is shrunk toward the global mean, a path's toward its host's,
by prior strengths estimated from the spread between hosts and between paths
(moments), so a sparse site counts little.  A document's log odds are the
classifier's plus the path's log odds less the global ones.

A document is rejected when its posterior of being good is under one half, or
its posterior of being toxic over one half.

Defined results: a null text counts as empty, and a document without words has
no evidence of its own, so its path's posterior decides; null source or lang is a site of
its own; labels that are null, contradict each other or fit no document are not
used; without labels of both kinds that classifier says nothing (probability
one half, no site shift) and rejects nothing; repeated rows each give a row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import by_batch, unit, written

FIT_ROWS = 40_000  # labelled documents that are fitted on, about
WORDS = 20_000  # words of evidence kept per target
LEAST = 5  # documents a word of evidence must occur in
PRIOR = 10.0  # pseudo-documents of a word's shrinkage
TARGETS = ("low", "toxic")
STRONGEST = (1, 4)  # sums over so many strongest words are features


class Evidence:
    """Sorted token hashes and their log odds, for each target."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.tables = tables

    def of(self, target: str, hashes: np.ndarray) -> np.ndarray:
        keys, odds = self.tables[target]
        if not len(keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, odds[at], 0.0)


def word_tokens(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (columns: whole, first four, first five bytes) and
    of the words with letter case as written."""
    lower, columns = tk.LOWER[w.buffer], []
    for size in (None, 4, 5):
        end = w.end if size is None else np.minimum(w.start + size, w.end)
        columns.append(tk.hash_bytes(lower, w.start, end) + np.uint64(size or 0))
    return np.stack(columns, axis=1), columns[0]


def features(texts: list[bytes], evidence: Evidence | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Feature rows of the texts, and the distinct token hashes of each."""
    rows, tokens = [], []
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = letters[128:] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    digit = np.zeros(256, bool)
    digit[48:58] = True
    for a, b in tk.chunks(texts):
        w = tk.Words(texts[a:b])
        table, whole = word_tokens(w)
        odds = {t: evidence.of(t, table.reshape(-1)).reshape(table.shape) for t in TARGETS} if evidence else {}
        n = np.diff(w.first)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        size = np.diff(np.concatenate(([0], ends))) - 1
        sums = [np.diff(np.concatenate(([0], np.cumsum(kind[w.buffer])))[np.concatenate(([0], ends))])
                for kind in (letters, upper, digit)]
        for i in range(b - a):
            mine = slice(w.first[i], w.first[i + 1])
            words, count, length = whole[mine], max(1, int(n[i])), max(1, int(size[i]))
            tokens.append(np.unique(table[mine]) if evidence is None else np.empty(0, np.uint64))
            if evidence is None:
                continue
            unique, times = np.unique(words, return_counts=True)
            pairs = words[1:] * np.uint64(31) + words[:-1]
            row = [np.log1p(n[i]), len(unique) / count, (words[1:] == words[:-1]).sum() / count,
                   times.max(initial=0) / count, len(np.unique(pairs)) / count,
                   sums[0][i] / length, sums[1][i] / length, sums[2][i] / length,
                   (length - sums[0][i] - sums[2][i] - count) / count, length / count]
            for t in TARGETS:
                best = odds[t][mine].max(axis=1) if n[i] else np.zeros(1)
                best = np.sort(np.unique(best))[::-1]
                row += [float(best[:k].clip(min=0).sum()) for k in STRONGEST]
                row.append(float(odds[t][mine].mean()) if n[i] else 0.0)
            rows.append(row)
    return np.array(rows, float).reshape(len(rows), 10 + len(TARGETS) * (len(STRONGEST) + 1)), tokens


def word_evidence(sample: DataFrame, target: str, base: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of most evidence: at most ``WORDS`` rows reach the driver."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch["content"].cast(pa.binary()).to_pylist(), batch["mark"].to_numpy()
            found = features(texts, None)[1]
            flat = np.concatenate([np.empty(0, np.uint64), *found])
            mark = np.repeat(marks, [len(f) for f in found])
            keys, where = np.unique(flat, return_inverse=True)
            yield pa.record_batch({"token": keys.view(np.int64), "n": np.bincount(where, minlength=len(keys)),
                                   "k": np.bincount(where, mark, len(keys)).astype(np.int64)})

    counts = (sample.select("content", F.col(target).cast("int").alias("mark"))
              .mapInArrow(by_batch(tokens), "token long, n long, k long").groupBy("token")
              .agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= LEAST))
    rate = (F.col("k") + PRIOR * base) / (F.col("n") + PRIOR)
    odds = F.log(rate / (1 - rate)) - float(np.log(base / (1 - base)))
    weight = F.abs(odds) * F.sqrt("n")
    rows = counts.select("token", odds.alias("odds"), weight.alias("weight")).orderBy(
        F.desc("weight"), "token").limit(WORDS).collect()
    keys = np.array([r.token for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.odds for r in rows], float)[order]


class Classifier:
    """Fitted evidence and one linear model per target (None: nothing to
    tell the classes apart)."""

    def __init__(self, evidence: Evidence, models: dict[str, tuple[np.ndarray, float] | None]):
        self.evidence, self.models = evidence, models

    def odds(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        rows, _ = features(texts, self.evidence)
        empty = rows[:, 0] == 0 if len(rows) else np.zeros(0, bool)
        out = {}
        for t, model in self.models.items():
            value = rows @ model[0] + model[1] if model and len(rows) else np.zeros(len(rows))
            out[t] = np.where(empty & (model is not None), np.nan, np.clip(value, -30, 30))
        return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """From ``docs`` (id, content) and ``labels`` (id, low, toxic booleans)."""
    marks = labels.where("id is not null").groupBy("id").agg(*(
        x for t in TARGETS for x in (F.min(t).alias(t), F.max(t).alias(t + "_max"))))
    marks = marks.where(" and ".join(f"{t} = {t}_max" for t in TARGETS)).select("id", *TARGETS)
    n = marks.count()
    share = min(1.0, fit_rows / max(1, n))
    chosen = written(marks.where(unit("fit", "id") < share))
    # about fit_rows narrow rows, counted: the texts stay where they are read
    if chosen.count() <= 2 * fit_rows:
        chosen = F.broadcast(chosen)
    sample = written(docs.join(chosen, "id").select("id", "content", *TARGETS))
    half = unit("half", "id") < 0.5
    first, second = sample.where(half), sample.where(~half)
    tables, models = {}, dict.fromkeys(TARGETS)
    seen = first.agg(F.count("*").alias("n"), *(F.sum(F.col(t).cast("int")).alias(t) for t in TARGETS)).first()
    for t in TARGETS:
        k = seen[t] or 0
        mixed = 0 < k < seen["n"]
        tables[t] = word_evidence(first, t, k / seen["n"]) if mixed else (
            np.empty(0, np.uint64), np.empty(0))
    evidence = Evidence(tables)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = features(batch["content"].cast(pa.binary()).to_pylist(), evidence)
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), *(batch[t] for t in TARGETS)],
                                  ["x", *TARGETS])

    data = written(second.select("content", *TARGETS).mapInArrow(
        by_batch(rows), "x array<double>, low boolean, toxic boolean"))
    kinds = data.agg(F.count("*").alias("n"), *(F.sum(F.col(t).cast("int")).alias(t) for t in TARGETS)).first()
    for t in TARGETS:
        if len(tables[t][0]) and 0 < (kinds[t] or 0) < kinds["n"]:
            train = data.select(array_to_vector("x").alias("features"), F.col(t).cast("double").alias("label"))
            model = LogisticRegression(regParam=1e-3, maxIter=1000).fit(train)
            models[t] = (model.coefficients.toArray(), float(model.intercept))
    return Classifier(evidence, models)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``id, source, lang, low, toxic``: the document log odds, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classifier.odds(batch["content"].cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch["id"], batch["source"], batch["lang"],
                                   *(pa.array(found[t], pa.float64(), from_pandas=True) for t in TARGETS)],
                                  ["id", "source", "lang", *TARGETS])

    return docs.select("id", "source", "lang", "content").mapInArrow(
        by_batch(run), "id long, source string, lang string, low double, toxic double")


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def strength(rows: DataFrame, mean: Column, around: Column) -> float:
    """Pseudo-documents of a prior: the spread of the groups' means around
    their parents', less what chance gives (moments)."""
    r = rows.where("n > 0").agg(F.sum(F.col("n") * (mean - around) ** 2).alias("spread"), F.sum("n").alias("n"),
                 F.count("*").alias("groups"), F.sum(F.col("n") * around * (1 - around)).alias("v")).first()
    if not r["n"] or not r["v"]:
        return 1.0
    within = r["v"] / r["n"]
    between = max(r["spread"] / r["n"] - within * (r["groups"] - 1) / r["n"], within * 1e-6)
    return float(min(max(within / between - 1, 1.0), 1e6))


def site_shift(scores: DataFrame, target: str) -> DataFrame:
    """``source, lang, shift, base``: log odds of the path's posterior less the
    global ones, and these.  Documents without words don't count."""
    p = probability(F.col(target))
    paths = written(scores.groupBy("source", "lang").agg(
        F.coalesce(F.sum(p), F.lit(0.0)).alias("k"), F.count(target).alias("n")))
    total = paths.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    base = total["k"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("source").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    m = strength(hosts, F.try_divide("k", "n"), F.lit(base))
    hosts = hosts.select(F.col("source").alias("host"), ((F.col("k") + m * base) / (F.col("n") + m)).alias("host_p"))
    joined = paths.join(hosts, F.col("source").eqNullSafe(F.col("host"))).drop("host")
    m2 = strength(joined, F.try_divide("k", "n"), F.col("host_p"))
    post = (F.col("k") + m2 * F.col("host_p")) / (F.col("n") + m2)
    return joined.select(F.col("source").alias("s"), F.col("lang").alias("l"),
                         (log_odds(post) - log_odds(F.lit(base))).alias("shift_" + target),
                         log_odds(F.lit(base)).alias("base_" + target))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, p_document, p_quality, p_toxic, kept`` per row: the
    classifier's and the posterior probability of good quality, the posterior
    of toxicity, and the decision.  ``labels``: doc_id, quality 0/1, toxic 0/1."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("source"),
                       F.col(path_col).cast("string").alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 0).alias("low"),
                          (F.col("toxic") == 1).alias("toxic")).dropna()
    classifier = fit(rows, marks, fit_rows)
    scores = written(score(rows, classifier))
    out = scores
    for t in TARGETS:
        shift = site_shift(scores, t)
        if classifier.models[t] is None:
            shift = shift.withColumn("shift_" + t, F.lit(0.0))
        out = out.join(shift, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l"))
                       ).drop("s", "l").withColumn(t, F.coalesce(t, "base_" + t))
    low, toxic = (probability(F.col(t) + F.col("shift_" + t)) for t in TARGETS)
    return out.select(F.col("id").alias("doc_id"), (1 - probability(F.col("low"))).alias("p_document"),
                      (1 - low).alias("p_quality"), toxic.alias("p_toxic"),
                      ((low <= 0.5) & (toxic <= 0.5)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rejected documents, all columns as they were.
    Rows with one id stay if one of them does."""
    kept = classify(docs, labels, id_col, **options).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
