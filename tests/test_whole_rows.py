"""Whole rows and texts: nothing is cut, merged or relabelled on the way."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veritext.functions.hashing import hash_key
from veritext.functions.labels import harmonise_binary
from veritext.operators import bias, errors, sampling
from veritext.operators.encode import encode_fixed_length
from veritext.sources.fakeddit import load_fakeddit
from veritext.sources.liar import load_liar
from veritext.sources.nela import load_nela_csv, load_nela_table
from veritext.sources.registry import load_corpus


def brute_id(token):
    return int(hashlib.md5(f"42:{token}".encode()).hexdigest()[:8], 16) % (2 ** 31 - 3) + 2


def test_encoding_keeps_every_token(spark):
    texts = {1: " ".join(f"w{i}" for i in range(300)), 2: "a b a", 3: "", 4: None,
             5: " ".join(["é"] * 128), 6: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, clean_text string")
    got = {}
    for r in encode_fixed_length(df).orderBy("doc_id", "chunk").collect():
        assert len(r.input_ids) == len(r.attention_mask) == 128
        ids = [i for i, m in zip(r.input_ids, r.attention_mask) if m]
        assert not any(i for i, m in zip(r.input_ids, r.attention_mask) if not m)
        got.setdefault(r.doc_id, []).append((r.chunk, r.n_tokens, ids))
    for doc, text in texts.items():
        tokens = (text or "").split()
        assert [c for c, _, _ in got[doc]] == list(range(max(1, -(-len(tokens) // 128))))
        assert {n for _, n, _ in got[doc]} == {len(tokens)}
        assert [i for _, _, ids in got[doc] for i in ids] == [brute_id(t) for t in tokens]


@pytest.mark.parametrize("bits", [0, 4, 16])
@pytest.mark.parametrize("cuts", [(20, 10), (15, 15), (20, 0), (60, 40), (0, 0)])
def test_threshold_split_equals_the_window(spark, bits, cuts):
    df = spark.range(0, 700, numPartitions=5).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 500, "big").when(F.col("id") < 698, "mid")
        .when(F.col("id") == 698, "one").alias("label"), F.lit("t").alias("text"))
    out = sampling.stratified_split(df, "label", "doc_id", *cuts, bits=bits)
    w = Window.partitionBy("label")
    rank = F.row_number().over(w.orderBy(hash_key(42, "doc_id"), "doc_id")) - 1
    rows = df.where("label is not null").select("doc_id", rank.alias("r"), F.count("*").over(w).alias("n")).collect()
    want = {x.doc_id: "test" if x.r < (x.n * cuts[0] + 99) // 100 else
            "val" if x.r < (x.n * sum(cuts) + 99) // 100 else "train" for x in rows}
    assert {r.doc_id: r.split for r in out.collect()} == want


def test_split_shuffles_no_text(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label_id"),
                                 F.lit("t").alias("text"))
    plan = sampling.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_every_class_and_every_bin_has_a_row(spark):
    df = spark.createDataFrame([("train", 0), ("train", 0), ("train", 1), ("val", 0)], "split string, label_id int")
    counts = bias.split_class_counts(df)
    assert {(r.split, r.label_id): r.n for r in counts.collect()} == {
        ("train", 0): 2, ("train", 1): 1, ("val", 0): 1, ("val", 1): 0}
    assert {r.split: r.imbalance_ratio for r in bias.imbalance_ratio(counts, ["split"]).collect()} == {
        "train": 2.0, "val": float("inf")}
    assert bias.split_class_counts(df, classes=[0, 1, 2]).count() == 6
    h = errors.histogram(spark.createDataFrame([("a", 0), ("a", 30)], "g string, v int"), "v", ["g"], 30).collect()
    assert {r.bin: r["count"] for r in h} == {b: int(b in (0, 29)) for b in range(30)}


def test_zero_is_true_schemes(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x")], "label_id int, label string")
    for scheme in ("fakeddit2", "fakeddit3", "fakeddit6", "sample2", "sample3", "ternary"):
        assert [(r.label_id, r.label) for r in harmonise_binary(df, scheme).collect()] == [
            (1, "true"), (0, "fake"), (0, "fake")]


def test_both_keeps_labels_and_repeated_rows(spark, tmp_path):
    fake, nela = tmp_path / "fakeddit", tmp_path / "nela"
    fake.mkdir()
    nela.mkdir()
    rows = ["clean_title\tsubreddit\t2_way_label\t3_way_label\t6_way_label", "the election\tnews\t0\t0\t0",
            "the election\tnews\t0\t0\t0", "a fake vote\tnews\t1\t2\t4"]
    (fake / "train.tsv").write_text("\n".join(rows) + "\n")
    (fake / "test.tsv").write_text("\n".join(rows) + "\n")
    (nela / "a.csv").write_text("source,title,content\nnpr,one,a long enough article of the day\n" * 1)
    for scheme in ("2way", "3way", "6way"):
        out = load_corpus(spark, "both", str(tmp_path), scheme).collect()
        found = [(r.text, r.label_id, r.label) for r in out if r.corpus == "fakeddit"]
        assert sorted(found) == [("a fake vote", 0, "fake")] * 2 + [("the election", 1, "true")] * 4
        ids = [(r.corpus, r.doc_id) for r in out]
        assert len(set(ids)) == len(ids)
    single = load_fakeddit(spark, str(fake), "2way", max_samples=2)["train"]
    assert single.count() == 2 and single.select("doc_id").distinct().count() == 2


def test_repeated_statements_keep_their_own_id(spark, tmp_path):
    line = "\t".join(["1.json", "true", "a statement long enough", "taxes", "someone"] + ["x"] * 9)
    (tmp_path / "train.tsv").write_text(line + "\n" + line + "\n")
    (tmp_path / "test.tsv").write_text(line + "\n")
    assert load_liar(spark, str(tmp_path)).select("doc_id").distinct().count() == 3


def test_newsdata_is_filtered_before_the_sample(spark, tmp_path):
    rows = [("nobody", "t", "unknown source text of some length")] * 30 + [
        ("Known", "title", f"{i} " + "word " * 300) for i in range(5)]
    spark.createDataFrame(rows, "source string, title string, content string").createOrReplaceTempView("news_rows")
    labels = spark.createDataFrame([("known", 2)], "source_key string, label_id int")
    out = load_nela_table(spark, labels, "news_rows", max_samples=4).collect()
    assert len(out) == 4 and {r.label for r in out} == {"unreliable"}
    assert all(r.text.startswith("title. ") and len(r.text) > 1500 for r in out)
    short = load_nela_table(spark, labels, "news_rows", max_content=800).collect()
    assert len(short) == 5 and {len(r.text) for r in short} == {807}
    path = tmp_path / "n.csv"
    path.write_text("Source,Title,Content\n" + "npr,one,a long enough article of the day\n" * 2)
    corpus, _ = load_nela_csv(spark, [str(path)])
    assert corpus.select("doc_id").distinct().count() == corpus.count() == 2
