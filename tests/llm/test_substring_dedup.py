"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF001, documents, rows_of
from veritext.llm.queries import op5_substring_dedup
from veritext.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, width):
    docs = sorted(docs, key=lambda d: ((0, 0) if d[0] is None else (1, d[0]), (d[1] or "").encode()))
    seen, out = set(), []
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i:i + width])
            if window in seen:
                gone[i:i + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        starts = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        ends = [i + 1 for i, g in enumerate(gone) if g and (i + 1 == len(gone) or not gone[i + 1])]
        out.append((doc_id, len(words), sum(gone), starts, ends, kept))
    return sorted(out, key=str)


def test_whole_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    expected = sorted((d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, _, _, k in brute(docs, 20))
    assert sum(e[2] for e in expected) > 0
    got = op5_substring_dedup(spark, SF001)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_odd_texts(spark, seed):
    rnd = random.Random(seed)
    docs = [(None, "a b c a b c a b c"), (5, None), (5, ""), (7, " \t\n"), (8, "a b c a b c"), (8, "a b c a b c"),
            (-3, "é ß a b c"), (9, "x " * 3000)]
    docs += [(100 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    rnd.shuffle(docs)
    got = substring_dedup(documents(spark, docs).repartition(5), width=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 4)


def test_empty_table_and_clashing_columns(spark):
    assert substring_dedup(documents(spark, [])).collect() == []
    clash = documents(spark, [(1, "a b c d e")]).withColumns(
        {c: F.lit(1) for c in ("slice", "id", "content", "owner", "bucket")})
    assert rows_of(substring_dedup(clash, width=2).select("doc_id", "kept_text")) == [(1, "a b c d e")]
