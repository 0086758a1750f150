import pytest

from veritext.functions import labels as L

RAW = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true", "bogus"]


@pytest.mark.parametrize("scheme,ids", [
    ("6way", [0, 1, 2, 3, 4, 5, -1]),
    ("3way", [0, 0, 1, 1, 2, 2, -1]),
    ("2way", [0, 0, 0, 1, 1, 1, -1]),
])
def test_liar_schemes(spark, scheme, ids):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "i int, raw string")
    out = L.remap_liar(df, "raw", scheme).orderBy("i").collect()
    assert [r.label_id for r in out] == ids
    assert out[-1].label == "unknown"


def test_liar_strips_raw(spark):
    df = spark.createDataFrame([(" true ",)], "raw string")
    assert L.remap_liar(df, "raw", "2way").first().label_id == 1


def _h(spark, ids, names=None):
    names = names or [str(i) for i in ids]
    return spark.createDataFrame(list(zip(ids, names)), "label_id int, label string")


def test_harmonise_auto_rules(spark):
    assert [r.label_id for r in L.harmonise_binary(_h(spark, [0, 1]), "auto").collect()] == [0, 1]
    six = _h(spark, list(range(6)), ["true", "satire/parody", "a", "b", "c", "d"])
    assert [r.label_id for r in L.harmonise_binary(six, "auto").collect()] == [1, 0, 0, 0, 0, 0]
    liar = _h(spark, list(range(6)))
    assert [r.label_id for r in L.harmonise_binary(liar, "auto").collect()] == [0, 0, 0, 1, 1, 1]
    tern = _h(spark, [0, 1, 2])
    assert [r.label_id for r in L.harmonise_binary(tern, "auto").collect()] == [1, 0, 0]
    with pytest.raises(ValueError):
        L.harmonise_binary(_h(spark, [0, 1, 2, 3, 4]), "auto")


def test_fakeddit_maps_name_only(spark):
    df = spark.createDataFrame([(3,)], "label_id int")
    r = L.remap_fakeddit(df, "label_id", "2way").first()
    assert r.label_id == 3 and r.label == "fake"
