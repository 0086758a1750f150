"""Periodic runs against brute force: every stretch, every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import SF001, documents, rows_of
from veritext.llm import periodic_runs, queries

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        words = [rnd.choice("abcdef"[:rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 12))]
            at = rnd.randint(0, len(words))
            words[at:at] = (unit * rnd.randint(2, 9))[:rnd.randint(4, 60)]
        out.append(" ".join(words))
    return out


def test_runs_equal_brute_force():
    cases = texts(1, 1500) + ["a " * 500, "a b " * 200 + "a", ("x " * 40 + "y ") * 12, "", " \n", "a b c " * 4 + "d " + "a b c " * 3]
    for t, (words, runs) in zip(cases, periodic_runs.runs_of([t.encode() for t in cases], 4, 6), strict=True):
        plain = t.split()
        assert [w.decode() for w in words] == plain and runs == brute(plain)
        assert periodic_runs.collapsed(words, runs).decode() == brute_collapsed(plain, runs)


def test_long_and_poor_texts_are_quick():
    rng = np.random.default_rng(2)
    words = rng.choice([b"a", b"b", b"c"], 60_000).tolist()
    words[20_000:20_000] = words[:700] * 9  # a long period among few words
    text = b" ".join(words + [b"z"] * 200_000)
    (_, runs), = periodic_runs.runs_of([text], 4, 6)
    assert (len(words), 200_000, 1) in runs
    assert any(q == 700 and n >= 6300 for _, n, q in runs)
    ids = np.array([ord(w) for w in words])
    for s, n, q in runs[:-1]:
        assert n >= max(6, 4 * q) and (ids[s:s + n - q] == ids[s + q:s + n]).all()


def test_odd_rows(spark):
    rows = [(1, "a b " * 6), (1, "a b " * 6), (2, None), (3, ""), (None, "x " * 7), (4, "x" * 100_000 + " é" * 6), (5, "a a " * 6)]
    docs = documents(spark, rows).withColumns({c: F.lit(7) for c in ("id", "runs", "n_words", "collapsed_text")})
    out = periodic_runs.periodic_runs(docs)
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        runs = brute(words)
        want.append((i, len(words), [tuple(r) for r in runs], brute_collapsed(words, runs)))
    assert sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in out.collect()), key=str) \
        == sorted(want, key=str)
    assert periodic_runs.periodic_runs(documents(spark, [])).collect() == []


def test_query_equals_brute_force(spark):
    want = []
    for r in spark.read.parquet(f"{SF001}/documents.parquet").collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()))
    out = queries.op13_periodic_runs(spark, SF001)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint",
                                "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string",
                                "collapsed_sha256": "string"}
    assert rows_of(out) == sorted(want, key=str) and sum(w[1] for w in want) > 10
