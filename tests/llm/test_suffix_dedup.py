"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF001, documents
from veritext.llm import suffix_dedup as sd
from veritext.llm.queries import op1_suffix_dedup


def brute(docs, width):
    least = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        key = (0, 0) if doc_id is None else (1, doc_id)
        for i in range(len(data) - width + 1):
            s = data[i:i + width]
            least[s] = min(least.get(s, key), key)
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        key = (0, 0) if doc_id is None else (1, doc_id)
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - width + 1):
            if least[data[i:i + width]] < key:
                gone[i + 1:i + width + 1] = True
        starts = np.flatnonzero(gone[1:] & ~gone[:-1])
        kept = bytes(b for b, g in zip(data, gone[1:], strict=False) if not g)
        out.append((doc_id, len(data), int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    expected = brute(docs, 50)
    assert sum(e[3] for e in expected) > 0
    got = op1_suffix_dedup(spark, SF001)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_odd_texts(spark, seed):
    rnd = random.Random(seed)
    docs = [(None, "abcabcabcabc"), (5, None), (5, ""), (8, "abcabcabc"), (8, "abcabcabc"), (-3, "éßabcabcabc"),
            (9, "x" * 3000), (10, "yx" * 2000 + "x" * 900), (11, "x" * 700 + "\x00" * 40), (12, "\x00" * 40)]
    docs += [(100 + i, "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rnd.shuffle(docs)
    clash = documents(spark, docs).repartition(5).withColumns({c: F.lit(1) for c in ("slice", "id", "content")})
    out = sd.suffix_dedup(clash, width=6, gram=3)
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.span_starts),
            hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == brute(docs, 6)


def test_empty_table(spark):
    assert sd.suffix_dedup(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_and_prefixes(seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("ab" if seed % 2 else "aaab") for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    symbols = np.frombuffer(b"\xff".join(p.encode() for p in parts) + b"\xff" * 72, np.uint8) + np.uint8(1)
    wanted = np.array([rnd.random() < 0.6 for _ in symbols]) & (symbols > 0)
    order = sd.suffix_order(symbols, wanted, 40)
    keys = [symbols[i:i + 40].tobytes() for i in order]
    inside = [k.split(b"\0")[0] for k in keys]  # order counts up to a fragment's end
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and inside == sorted(inside)
    common = sd.common_prefixes(symbols, order, 40)
    for k in range(1, len(order)):
        a, b = keys[k - 1], keys[k]
        assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), 40)
