from pyspark.sql import functions as F

from veritext.functions.text import (assemble_statement, assemble_title_content, clean_text, drop_stopwords,
                                     normalise_source_key, word_count)

CASES = [
    ("BREAKING: The president @POTUS signed a new bill https://t.co/example #politics",
     "breaking the president signed a new bill politics"),
    ("<p>Congress votes on <b>healthcare</b> reform TODAY!</p>", "congress votes on healthcare reform today"),
    ("Area Man Discovers Politicians Don't Actually Read Bills They Vote On 😂",
     "area man discovers politicians don t actually read bills they vote on"),
    (None, ""), ("", ""), ("   ", ""), ("123 !!", ""), ("@José", ""), ("#été", "t"),
    ("visit www.example.com/x now", "visit now"), ("tab\tand nbsp em", "tab and nbsp em"),
]


def test_clean_text_fixtures(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text("t").alias("c")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, (CASES[i][0], got[i])


def test_clean_text_is_pure_catalyst(spark):
    df = spark.createDataFrame([("a",)], "t string").select(clean_text("t").alias("c"), word_count("t").alias("w"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_word_count_matches_python_split(spark):
    texts = ["a b  c", " lead", "x y", "", None, "one\ntwo\tthree", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.w for r in df.select(word_count("t").alias("w")).collect()]
    assert got == [len((t or "").split()) for t in texts]


def test_stopwords_keep_order_and_duplicates(spark):
    df = spark.createDataFrame([("the cat and the cat don t sit",)], "t string")
    got = df.select(drop_stopwords("t").alias("s")).first().s
    assert got == "cat cat sit"


def test_assembly(spark):
    df = spark.createDataFrame([("stmt", "tax"), ("stmt", "  "), ("stmt", None)], "s string, sub string")
    got = [r.x for r in df.select(assemble_statement("s", "sub").alias("x")).collect()]
    assert got == ["stmt [tax]", "stmt", "stmt"]
    df2 = spark.createDataFrame([("T", "c" * 900), ("T", None), (None, "body")], "t string, c string")
    got2 = [r.x for r in df2.select(assemble_title_content("t", "c", 800).alias("x")).collect()]
    assert got2[0] == "T. " + "c" * 800 and got2[1] == "T" and got2[2] == ". body"


def test_source_key(spark):
    df = spark.createDataFrame([("  Fox News ",), ("USA\tToday",)], "s string")
    assert [r.k for r in df.select(normalise_source_key("s").alias("k")).collect()] == ["foxnews", "usatoday"]


def test_empty_removed_is_observed_in_the_same_job(spark):
    """Rows dropped as empty after cleaning are counted by observe()."""
    from pyspark.sql import Observation

    from veritext.functions.text import with_clean
    df = spark.createDataFrame([(1, "Hello world"), (2, "123 !!"), (3, None), (4, "   "), (5, "ok")],
                               "doc_id long, text string")
    obs = Observation("clean")
    kept = with_clean(df, observation=obs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 5]
    assert obs.get == {"rows": 5, "empty_removed": 3}
