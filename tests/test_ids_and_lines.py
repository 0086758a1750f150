"""Row ids from content, raw-line field counts, JSON of both shapes."""
import json

import pytest
from pyspark.sql import functions as F

from veritext.operators import sampling
from veritext.plans.analysis import articles, json_field
from veritext.sources.fakeddit import field_count, load_fakeddit, read_tsv_strict
from veritext.sources.ids import with_stable_id
from veritext.sources.liar import load_liar

ROWS = [(f"text {i % 90}", None if i % 7 == 0 else i % 3, "" if i % 5 else None) for i in range(300)] + [("same", 1, "x")] * 200


def ids_of(df):
    return sorted(((r.doc_id, r.text, r.n, r.extra) for r in df.collect()), key=str)


def test_ids_do_not_depend_on_the_packing(spark, tmp_path):
    found = []
    for parts in (1, 7, 50):
        path = str(tmp_path / f"p{parts}")
        spark.createDataFrame(ROWS, "text string, n int, extra string").repartition(parts).write.parquet(path)
        df = with_stable_id(spark.read.parquet(path))
        found.append(ids_of(df))
        assert df.select("doc_id").distinct().count() == len(ROWS)
        split = sampling.stratified_split(df.withColumn("label_id", F.lit(0)))
        found[-1].append(sorted((r.doc_id, r.split) for r in split.select("doc_id", "split").collect()))
    assert found[0] == found[1] == found[2]
    assert with_stable_id(spark.createDataFrame([], "a string")).collect() == []


def test_equal_rows_are_numbered_and_null_is_not_empty(spark):
    df = with_stable_id(spark.createDataFrame([("a", None), ("a", ""), ("a", None), (None, "a")], "x string, y string"))
    ids = sorted(r.doc_id for r in df.collect())
    assert len(set(ids)) == 4 and sum(i.endswith("-1") for i in ids) == 1
    assert len({i.split("-")[0] for i in ids}) == 3


def test_loaded_corpora_keep_ids_when_repacked(spark, tmp_path):
    lines = [f"the election {i % 40}\tnews\t{i % 2}\t{i % 3}\t{i % 6}" for i in range(120)]
    header = "clean_title\tsubreddit\t2_way_label\t3_way_label\t6_way_label"
    got = []
    for parts in (1, 7):
        folder = tmp_path / f"f{parts}" / "train.tsv"
        folder.mkdir(parents=True)
        for k in range(parts):
            (folder / f"part-{k}.tsv").write_text("\n".join([header, *lines[k::parts]]) + "\n")
        out = load_fakeddit(spark, str(tmp_path / f"f{parts}"), "2way", max_samples=30)["train"]
        got.append(sorted((r.doc_id, r.text, r.label_id) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 30 and len({g[0] for g in got[0]}) == 30


CASES = [("3\t4", 2), ("3\t4\t", 3), ("3", 1), ('"a\tb"\tc', 2), ('"a""\tb"\tc\t', 3), ('x"y\tz"\tw', 3), ('"open\tto the end', 1),
         ("\t\t", 3), ('a\t"b"\t"c\td"', 3), ('"a"b\tc', 2)]


def test_field_counts(spark):
    df = spark.createDataFrame([(line,) for line, _ in CASES], "value string")
    got = {r.value: r.n for r in df.select("value", field_count(F.col("value"), "\t", '"').alias("n")).collect()}
    assert got == dict(CASES)
    long = spark.createDataFrame([('"' + 'ab""' * 50_000 + '"\tx',)], "value string")
    assert long.select(field_count(F.col("value"), "\t", '"').alias("n")).first().n == 2


def test_long_rows_go_and_short_rows_stay(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('a\tb\n1\t2\n3\t4\t\n5\n\n"6\t6"\t7\n8\t"9""9"\n \t \n10\t11\t12\n')
    got = [tuple(r) for r in read_tsv_strict(spark, str(path)).collect()]
    assert got == [("1", "2"), ("5", None), ("6\t6", "7"), ("8", '9"9')]
    (tmp_path / "train.tsv").write_text("\t".join(["1", "true", 'a "lone quote here', *["x"] * 11]) + "\n"
                                        + "\t".join(["2", "true", "one field too many", *["x"] * 11, ""]) + "\n")
    assert [r.id for r in load_liar(spark, str(tmp_path)).collect()] == ["1"]


@pytest.mark.parametrize("text", ['{"k": 1}', '[{"k": null}, {"x": 2}, {"k": "t"}]', "[]", "not json", '{"k": {"a": 1}}', '"text"'])
def test_articles_of_objects_and_arrays(spark, text):
    df = spark.createDataFrame([(text,)], "j string").select(F.explode(articles(F.col("j"))).alias("v"))
    present, value = json_field(F.col("v"), "k")
    got = [(r.p, r.k) for r in df.select(present.alias("p"), value.alias("k")).collect()]
    try:
        parsed = json.loads(text)
    except ValueError:
        parsed = []
    parsed = parsed if isinstance(parsed, list) else [parsed]
    want = [("k" in a, a["k"] if not isinstance(a["k"], dict) else json.dumps(a["k"], separators=(",", ":")))
            if isinstance(a, dict) and "k" in a else (False, None) for a in parsed]
    assert got == [(p, None if k is None else str(k)) for p, k in want]
