import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.operators import nb
from veritext.operators.tfidf import fit_tfidf

DOCS = [
    (1, "the cat sat on the mat", 0), (2, "the dog sat on the log", 1), (3, "cat and dog", 0),
    (4, "a cat a dog a bird", 1), (5, "the bird flew", 0), (6, "dog dog dog barks", 1),
    (7, "mat and log", 0), (8, "x", 1),
]


def _brute(train, max_features=10000, min_df=2, max_df=0.95):
    def terms(t):
        toks = [w for w in t.split(" ") if len(w) >= 2]
        return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    tfs = {d: Counter(terms(t)) for d, t, _ in train}
    df = Counter(t for c in tfs.values() for t in c)
    tot = Counter()
    for c in tfs.values():
        tot.update(c)
    n = len(train)
    keep = [t for t in df if df[t] >= min_df and df[t] <= max_df * n]
    keep = sorted(keep, key=lambda t: (-tot[t], t))[:max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in keep}
    out = {}
    for d, c in tfs.items():
        w = {t: (1 + math.log(v)) * idf[t] for t, v in c.items() if t in idf}
        nrm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(d, t): x / nrm for t, x in w.items()})
    return set(keep), out


def test_tfidf_matches_bruteforce(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, clean_text string, label_id int")
    m = fit_tfidf(df, max_features=10000)
    vocab, weights = _brute(DOCS)
    assert {r.term for r in m.vocab.collect()} == vocab
    got = {(r.doc_id, r.term): r.weight for r in m.transform_long(df).collect()}
    assert set(got) == set(weights)
    for k, v in weights.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def test_vector_face_equals_long_face(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, clean_text string, label_id int")
    m = fit_tfidf(df)
    idx = {r.term: r.term_index for r in m.vocab.collect()}
    long = {(r.doc_id, idx[r.term]): r.weight for r in m.transform_long(df).collect()}
    vecs = m.transform_vectors(df).collect()
    assert len(vecs) == len(DOCS)
    for r in vecs:
        v = r.features
        for i, x in zip(v.indices, v.values):
            assert long[(r.doc_id, int(i))] == pytest.approx(x, abs=1e-12)
        nrm = float(np.sqrt((v.values ** 2).sum()))
        assert nrm == pytest.approx(1.0) or nrm == 0.0


def test_in_row_tf_counts(spark):
    df = spark.createDataFrame([(1, "b a b c b"), (2, "bb aa bb cc bb"), (3, "")], "doc_id long, clean_text string")
    m = fit_tfidf(df, min_df=1, max_df=1.0)
    got = {}
    for r in m.transform_long(df).collect():
        got.setdefault(r.doc_id, {})[r.term] = r.tf
    assert got == {2: {"bb": 3, "aa": 1, "cc": 1, "bb aa": 1, "aa bb": 1, "bb cc": 1, "cc bb": 1}}  # no single letters
    assert {r.doc_id: len(r.weights) for r in m.sparse_rows(df).collect()} == {1: 0, 2: 7, 3: 0}
    none = fit_tfidf(df, min_df=3)
    assert none.vocab_size == 0 and none.transform_long(df).count() == 0 and none.transform_vectors(df).count() == 3
    with pytest.raises(ValueError):
        fit_tfidf(df, max_features=10 ** 9)


def test_transform_shuffles_nothing_and_runs_no_python(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, clean_text string, label_id int")
    m = fit_tfidf(df)
    theta, prior = nb.nb_fit(m.transform_long(df, keep=["label_id"]), df, m.vocab)
    parameters = nb.nb_parameters(theta, prior, m.vocab)
    for out in (m.transform_long(df), m.sparse_rows(df), nb.nb_predict(m.sparse_rows(df), parameters)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
    assert "Python" not in m.transform_vectors(df)._jdf.queryExecution().executedPlan().toString()


def test_sql_nb_matches_mllib(spark):
    from veritext.operators import models
    df = spark.createDataFrame(DOCS, "doc_id long, clean_text string, label_id int")
    m = fit_tfidf(df)
    long = m.transform_long(df, keep=["label_id"])
    theta, prior = nb.nb_fit(long, df, m.vocab)
    ours = {r.doc_id: r.pred_id for r in nb.predict_long(long, df, theta, prior).collect()}
    rows = {r.doc_id: r for r in nb.nb_predict(m.sparse_rows(df), nb.nb_parameters(theta, prior, m.vocab)).collect()}
    assert {d: r.pred_id for d, r in rows.items()} == ours
    vec = m.transform_vectors(df, keep=["label_id"]).withColumn("label", F.col("label_id").cast("double"))
    vec = models.balanced_weights(vec)
    ml = models.make_nb(1.0).fit(vec)
    theirs = {r.doc_id: int(r.prediction) for r in ml.transform(vec).collect()}
    assert ours == theirs
    for r in ml.transform(vec).collect():
        assert list(r.probability) == pytest.approx(rows[r.doc_id].probabilities, abs=1e-9)
    # closed form of theta equals MLlib's
    idx = {r.term: r.term_index for r in m.vocab.collect()}
    th = ml.theta.toArray()
    for r in theta.collect():
        assert th[r.label_id, idx[r.term]] == pytest.approx(r.theta, abs=1e-9)


EDGE = [(1, ""), (2, "x"), (3, "a b c"), (4, "word"), (5, "aa b aa aa b cc aa"), (6, "x yy x zz yy x yy zz"),
        (7, "the cat sat on the mat the cat"), (8, "aa aa aa aa")]


def _grams(text, n_max):
    toks = [w for w in text.split(" ") if len(w) >= 2]
    out = list(toks)
    for n in range(2, n_max + 1):
        out += [" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1)]
    return out


@pytest.mark.parametrize("n_max", [1, 2, 3])
def test_gram_array_and_term_stats_match_bruteforce(spark, n_max):
    """Sorted-array document frequencies (no doc-term shuffle) equal a
    brute-force count, and the per-row gram array equals the n-gram list."""
    from veritext.operators.tfidf import gram_array, term_stats
    df = spark.createDataFrame(EDGE, "doc_id long, clean_text string")
    arrs = {r.doc_id: [t for t in r.g if t != ""] for r in df.select("doc_id", gram_array("clean_text", n_max).alias("g")).collect()}
    for d, t in EDGE:
        assert sorted(arrs[d]) == sorted(_grams(t, n_max))
    want_df, want_tf = Counter(), Counter()
    for _, t in EDGE:
        g = _grams(t, n_max)
        want_tf.update(g)
        want_df.update(set(g))
    got = {r.term: (r.df, r.total_tf) for r in term_stats(df.repartition(3), n_max=n_max).collect()}
    assert got == {t: (want_df[t], want_tf[t]) for t in want_tf}


def test_token_table_document_frequency(spark):
    from veritext.operators.lemma import token_table
    df = spark.createDataFrame(EDGE, "doc_id long, clean_text string")
    want = Counter()
    for _, t in EDGE:
        want.update(set(w for w in t.split(" ") if w))
    got = {r.token: r.df for r in token_table(df).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("max_features", [1, 2, 3, 5, 8])
def test_vocabulary_cap_with_ties_matches_bruteforce(spark, max_features):
    """The top-N vocabulary (total_tf desc, term asc) with the total_tf cutoff
    equals the brute-force order, including cuts inside a tie group."""
    df = spark.createDataFrame(DOCS, "doc_id long, clean_text string, label_id int").repartition(4)
    m = fit_tfidf(df, max_features=max_features, min_df=1, max_df=1.0)
    vocab, _ = _brute(DOCS, max_features=max_features, min_df=1, max_df=1.0)
    assert {r.term for r in m.vocab.collect()} == vocab
