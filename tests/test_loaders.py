import json
import os

from veritext.sources.fakeddit import load_fakeddit, union_splits
from veritext.sources.liar import load_liar
from veritext.sources.nela import detect_label_column, load_labels_file, load_nela, load_nela_csv


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_fakeddit_rows_and_missing_split(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "fakeddit")
    hdr = "id\tclean_title\tsubreddit\t2_way_label\t3_way_label\t6_way_label\n"
    rows = [
        "a\tthe president signed\tnews\t1\t2\t4\n",        # political by subreddit
        "b\tgardening tips\tplants\t0\t0\t0\n",             # not political: dropped
        "c\tnew tax law\tplants\t1\t2\t5\n",                 # political by keyword
        "d\tvote today\tplants\t1\t2\n",                     # short row: 6-way null -> dropped by dropna
        "e\tcongress\tnews\t1\t2\t3\textra\n",               # over-long row: skipped
    ]
    _w(os.path.join(d, "train.tsv"), hdr + "".join(rows))
    _w(os.path.join(d, "test.tsv"), hdr + rows[0])
    out = load_fakeddit(spark, d, "6way")
    assert set(out) == {"train", "test"}          # validate.tsv missing -> skipped
    got = sorted((r.text, r.label_id, r.label) for r in out["train"].collect())
    assert got == [("new tax law", 5, "manipulated content"), ("the president signed", 4, "false connection")]
    both = union_splits(out)
    assert both.count() == 3
    two = load_fakeddit(spark, d, "2way", filter_political=False)["train"]
    assert {(r.text, r.label_id, r.label) for r in two.collect()} >= {("gardening tips", 0, "true")}


def test_fakeddit_label_fallback_and_title(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "fk2")
    _w(os.path.join(d, "train.tsv"), "title\t6_way_label\nsomething\t3\n")
    out = load_fakeddit(spark, d, "2way", filter_political=True)["train"].collect()
    assert [(r.text, r.label_id, r.label) for r in out] == [("something", 3, "fake")]


def test_liar_quoting_off_and_schemes(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "liar")
    rows = [
        ["1.json", "half-true", 'He said "hello there friends', "economy", "bob", "", "", "", "0", "0", "0", "0", "0", "ctx"],
        ["2.json", "pants-fire", "short", "", "", "", "", "", "0", "0", "0", "0", "0", "ctx"],
        ["3.json", "bogus", "a long enough statement", "", "", "", "", "", "0", "0", "0", "0", "0", "ctx"],
        ["4.json", "false", "another long statement", "", "ann", "", "", "", "0", "0", "0", "0", "0", "ctx"],
    ]
    _w(os.path.join(d, "train.tsv"), "".join("\t".join(r) + "\n" for r in rows))
    df = load_liar(spark, d, "2way")
    got = {r.id: (r.text, r.label_id, r.label, r.source) for r in df.collect()}
    assert got["1.json"] == ('He said "hello there friends [economy]', 1, "true", "bob")
    assert "2.json" not in got and "3.json" not in got      # too short / unknown label
    assert got["4.json"][1:] == (0, "fake", "ann")


def test_nela_csv_join_and_unknown(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "nela")
    _w(os.path.join(d, "news.csv"),
       ' Source ,Title,Content\nReuters,Markets rise,"Stocks rose, a lot today"\n'
       'USA Today,Long headline here,body text that is long\nunknownsite,x,y and more text here\n')
    corpus, unknown = load_nela_csv(spark, os.path.join(d, "news.csv"))
    got = {r.source: (r.label_id, r.label, r.text) for r in corpus.collect()}
    assert got["Reuters"] == (0, "reliable", "Markets rise. Stocks rose, a lot today")
    assert got["USA Today"][0] == 1                # duplicate key: later entry wins
    assert {r.source: r.n for r in unknown.collect()} == {"unknownsite": 1}
    assert load_nela(spark, d).count() == 2       # auto-detect picks the CSV


def test_nela_json_and_label_detection(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "nelaj")
    _w(os.path.join(d, "labels.csv"), "source,score,aggregated_label\nsiteA,9,0\nsiteB,1,2\nsiteA,3,1\n")
    _w(os.path.join(d, "articles", "siteA", "a.json"),
       json.dumps([{"title": "t", "content": "content of article number one is long"},
                   {"title": "only a title that is quite long enough"}]))
    _w(os.path.join(d, "articles", "siteB", "b.json"),
       json.dumps({"source": "siteB", "content": "another article with enough text"}))
    lab = {r.source_key: r.label_id for r in load_labels_file(spark, os.path.join(d, "labels.csv")).collect()}
    assert lab == {"sitea": 1, "siteb": 2}       # last row wins
    df = load_nela(spark, d)
    got = sorted((r.source, r.label_id, r.label) for r in df.collect())
    assert got == [("siteA", 1, "mixed"), ("siteA", 1, "mixed"), ("siteB", 2, "unreliable")]


def test_nela_json_absent_and_null_keys(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "nelak")
    _w(os.path.join(d, "labels.csv"), "source,aggregated_label\nsiteA,0\nother,2\n")
    long = "a text that is long enough to stay"
    rows = [{"title": "no content key, " + long}, {"content": None, "title": "null content, " + long},
            {"source": None, "content": "null source, " + long}, {"source": "other", "content": "own source, " + long},
            {"content": "short"}, "no object", {"content": "folder, " + long}, {"content": "folder, " + long}]
    _w(os.path.join(d, "articles", "siteA", "a.json"), json.dumps(rows))
    _w(os.path.join(d, "articles", "siteA", "broken.json"), "{not json")
    _w(os.path.join(d, "articles", "siteA", "one.json"), json.dumps({"content": "object, " + long}))
    out = load_nela(spark, d).collect()
    assert sorted((r.source, r.text.split(",")[0], r.label) for r in out) == [
        ("other", "own source", "unreliable"), ("siteA", "folder", "reliable"), ("siteA", "folder", "reliable"),
        ("siteA", "no content key", "reliable"), ("siteA", "object", "reliable")]
    assert len({r.doc_id for r in out}) == 5


def test_corpus_csv_round_trip(spark, tmpdir_path):
    from veritext.sources.sinks import write_corpus
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, ""), (4, None)]
    path = os.path.join(tmpdir_path, "corpus")
    write_corpus(spark.createDataFrame(rows, "doc_id long, text string"), path, fmt="csv")
    back = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    assert sorted((int(r.doc_id), r.text or "") for r in back.collect()) == [(i, t or "") for i, t in rows]


def test_detect_label_column_numeric_fallback(spark):
    from pyspark.sql import types as T
    s = T.StructType([T.StructField("src", T.StringType()), T.StructField("a", T.IntegerType()),
                      T.StructField("b", T.DoubleType())])
    assert detect_label_column(s) == "b"
