"""Line dedup against brute force, odd rows included."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.util import documents, rows_of
from veritext.llm import line_dedup

BLANKS = " \t\n\x0b\f\r"
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, min_docs, min_chars=1):
    found = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= max(1, min_chars):
                found[key].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(found.get(x.strip(BLANKS).translate(LOWER), ())) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force_on_odd_rows(spark):
    rnd = random.Random(3)
    pool = ["Common line", "common LINE", " common line\t", "Über", "über", "ÜBER", "", "  ", "x", "\x0bx\f", "\xa0x", "y" * 300]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.6 else f"own {rnd.randint(0, 400)}"
                          for _ in range(rnd.randint(0, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n"), (104, "x\n" * 5000 + "end"), (105, "Common line"),
             (106, "common line"), (106, "common line"), (106, "other\ncommon line"), (None, "common line\nx"), (None, None),
             (107, "a\r\ncommon line\r\nb")]
    docs = documents(spark, rows).withColumns({c: F.lit("common line") for c in
                                               ("print", "id", "version", "pos", "line", "key", "lines", "word", "bits")})
    for least, chars in ((2, 1), (5, 1), (10, 3), (100, 1)):
        out = line_dedup.kept_texts(docs, min_docs=least, min_chars=chars)
        assert rows_of(out) == brute(rows, least, chars)


def test_documents_count_not_lines(spark):
    rows = [(1, "again\n" * 50), (2, "again"), (3, "once\nagain")]
    assert rows_of(line_dedup.kept_texts(documents(spark, rows), min_docs=4)) == brute(rows, 4)
    assert rows_of(line_dedup.kept_texts(documents(spark, rows), min_docs=3)) == brute(rows, 3)
    # one id twice is one document
    rows = [(1, "l"), (1, "l"), (1, "l\nm"), (2, "l")]
    assert rows_of(line_dedup.kept_texts(documents(spark, rows), min_docs=3)) == brute(rows, 3)


def test_bitmaps_are_sparse_and_empty_table(spark):
    rows = [(i, "\n" * 1000 + "shared\n" + "\n" * 70 + "shared") for i in range(3)]
    out = line_dedup.line_dedup(documents(spark, rows), min_docs=3).collect()
    assert [(r.n_dropped, [(w.word, w.bits) for w in r.dropped]) for r in out] == [
        (2, [(15, 1 << 40), (16, 1 << (1071 - 1024))])] * 3
    empty = documents(spark, [])
    assert line_dedup.line_dedup(empty).collect() == [] and line_dedup.kept_texts(empty).collect() == []


def test_no_python_and_no_second_shuffle_for_the_window(spark):
    docs = documents(spark, [(1, "a\nb"), (2, "a")])
    lines = line_dedup.prints(docs, "doc_id", "text", 1)
    plan = line_dedup.common_prints(lines, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "rangepartitioning(print" in plan
    assert plan.count("Exchange") == 2  # the ranges, and the partial counts by print
