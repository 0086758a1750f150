"""Pruned k-NN and SMOTE against brute force, on dense and sparse rows."""
import numpy as np
import pytest

from veritext.operators import balance, neighbours
from veritext.operators.balance import smote, smote_sparse
from veritext.operators.neighbours import knn_within


def brute(points, groups, k, digits=None):
    out = {}
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        d = d if digits is None else np.round(d, digits)
        others = [j for j in range(len(points)) if j != i and groups[j] == groups[i]]
        out[i] = sorted(others, key=lambda j: (d[j], j))[:k]
    return out


def collected(knn):
    got = {}
    for r in knn.collect():
        got.setdefault(r.qid, {})[r.slot] = r.nid
    return {q: [s[i] for i in range(len(s))] for q, s in got.items()}


def clustered(n, seed, dim=4, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.choice(rng.normal(size=(max(2, n // 40), dim)), n) + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("block_bytes", [200, 2000, 10 ** 7])
def test_dense_neighbours_equal_brute_force(spark, block_bytes):
    points = np.concatenate([clustered(150, 1), np.zeros((40, 4)), clustered(10, 2)])  # equal rows, a small group
    groups = [0 if i < 185 else 1 if i < 199 else 2 for i in range(200)]
    ref = spark.createDataFrame([(i, g, p.tolist()) for i, (g, p) in enumerate(zip(groups, points))],
                                "rid long, grp int, val array<double>").repartition(5)
    odd = spark.createDataFrame([(900, None, [0.0] * 4)], ref.schema)
    asked = ref.withColumnRenamed("rid", "qid")
    got = collected(knn_within(asked, ref.unionByName(odd), 5, block_bytes, pivots=6))
    assert got == {q: n for q, n in brute(points, groups, 5).items() if n}  # group 2 has one row


@pytest.mark.parametrize("block_bytes", [400, 10 ** 7])
def test_sparse_neighbours_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(4)
    points = np.where(rng.random((120, 30)) < 0.2, rng.random((120, 30)), 0)
    points[50:70] = points[50]
    points[100:105] = 0
    rows = [(i, i % 2, [float(x) for x in p[p > 0]], np.flatnonzero(p > 0).tolist()) for i, p in enumerate(points)]
    ref = spark.createDataFrame(rows, "rid long, grp int, val array<double>, idx array<int>")
    got = collected(knn_within(ref.withColumnRenamed("rid", "qid"), ref, 4, block_bytes, pivots=5))
    assert got == brute(points, [i % 2 for i in range(120)], 4, 6)


def test_visits_grow_with_the_rows(spark):
    """Clustered rows: four times the rows cost about four times the visits."""
    visits = []
    for n in (400, 1600):
        points = clustered(n, 7, dim=3, spread=0.01)
        ref = spark.createDataFrame([(i, 0, p.tolist()) for i, p in enumerate(points)], "rid long, grp int, val array<double>")
        search = neighbours.Search(ref, 3, 64 * 40, n // 40, None)
        own, more = search.rounds(ref.withColumnRenamed("rid", "qid"))
        visits.append(more.count())
        assert collected(knn_within(ref.withColumnRenamed("rid", "qid"), ref, 3, 64 * 40, n // 40)) == brute(points, [0] * n, 3)
    assert 0 < visits[1] <= 6 * max(visits[0], 100), visits


def test_smote_of_small_and_single_classes(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(9)] + [(20, 1, [1.0, 2.0]), (30, 2, [0.0, 1.0]), (31, 2, [4.0, 1.0]), (99, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = smote(df, k=5).collect()
    assert {c: sum(r.label == c for r in out) for c in (0, 1, 2)} == {0: 0, 1: 8, 2: 7}
    assert all((r.base_id, r.nn_id, r.vec) == (20, 20, [1.0, 2.0]) for r in out if r.label == 1)
    assert all({r.base_id, r.nn_id} == {30, 31} and 0 <= r.vec[0] <= 4 for r in out if r.label == 2)
    assert smote(df.limit(0)).collect() == [] and smote(df.where("label = 0")).collect() == []


def test_sparse_smote_interpolates(spark):
    rows = [(i, 0, [0], [1.0]) for i in range(6)] + [(10, 1, [1, 3], [0.6, 0.8]), (11, 1, [2, 3], [0.8, 0.6]), (12, 1, [], [])]
    df = spark.createDataFrame(rows, "doc_id long, label_id int, term_indices array<int>, weights array<double>")
    vec = {r[0]: dict(zip(r[2], r[3])) for r in rows}
    for r in smote_sparse(df, k=2).collect():
        a, b = vec[r.base_id], vec[r.nn_id]
        want = {i: a.get(i, 0) + r.lam * (b.get(i, 0) - a.get(i, 0)) for i in sorted(a | b)}
        assert r.indices == list(want) and np.allclose(r["values"], list(want.values()))


def test_only_classes_that_grow_are_searched(spark, monkeypatch):
    seen = []
    search = balance.knn_within
    monkeypatch.setattr(balance, "knn_within", lambda asked, reference, *a, **k: seen.append(
        sorted(r.grp for r in reference.select("grp").collect())) or search(asked, reference, *a, **k))
    rows = [(i, 0, [float(i), 0.0]) for i in range(9)] + [(i, 1, [float(i), 1.0]) for i in range(20, 24)] + [(99, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert smote(df, k=2).count() == 5 and seen == [[1, 1, 1, 1]]


def test_postings_hold_common_and_rare_columns():
    rng = np.random.default_rng(2)
    points = np.where(rng.random((60, 40)) < np.linspace(0.02, 0.6, 40), rng.random((60, 40)), 0)
    rows = neighbours.Rows.of([np.flatnonzero(p).tolist() for p in points], [p[p > 0].tolist() for p in points])
    postings = neighbours.Postings(rows, 40)
    assert 0 < len(postings.common) < 40
    want = np.sqrt(((points[:7, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(postings.distances(points[:7]), want, atol=1e-7)
    assert np.allclose(neighbours.distances(rows, points[:7]).T, want, atol=1e-7)
