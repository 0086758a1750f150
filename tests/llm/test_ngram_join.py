"""N-gram Jaccard join against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF01, documents, rows_of
from veritext.llm import ngram_join as module
from veritext.llm.ngram_join import ngram_join
from veritext.llm.queries import op3_ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    group = {d: d for d, _ in docs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (d, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            e, other = sets[j]
            if 100 * both >= 80 * (len(s) + len(other) - both):
                a, b = find(d), find(e)
                group[max(a, b)] = min(a, b)
    return sorted(((d, len(s), find(d)) for d, s in sets), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    expected = brute(docs)
    assert len({c for _, _, c in expected}) < len(docs)
    got = op3_ngram_join(spark, SF01)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_and_odd_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "HOT", [2, 5, 48][seed - 1])
    monkeypatch.setattr(module, "BLOCK", 4)
    monkeypatch.setattr(module, "ROUNDS", [0, 4, 1][seed - 1])
    rnd = random.Random(seed)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "a b c d e"),
            (8, "É b c d e"), (9, "é b c d e"), (10, "x " * 5000)]
    for base in range(4):
        words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.choice([12, 60, 200]))]
        for _ in range(15):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                copy[rnd.randrange(len(copy))] = "z" + str(rnd.random())
            docs.append((100 + len(docs), " ".join(copy)))
            words = copy if rnd.random() < 0.3 else words
    rnd.shuffle(docs)
    clash = documents(spark, docs).repartition(4).withColumns({c: F.lit(1) for c in ("slice", "id", "content", "key")})
    assert rows_of(ngram_join(clash)) == brute(docs)


def test_nulls_repeats_and_empty_table(spark):
    docs = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "q r s t u v")]
    assert rows_of(ngram_join(documents(spark, docs))) == sorted(
        [(None, 2, None), (7, 2, None), (7, 2, None), (9, 2, 9)], key=str)
    assert ngram_join(documents(spark, [])).collect() == []


def test_rows_of_one_id_are_one_node(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "only one of its kind here it is"
    docs = [(3, a), (7, a), (7, b), (5, b), (7, c), (9, c + " not"), (2, "no partner in the whole table"), (2, None), (1, "")]
    got = rows_of(ngram_join(documents(spark, docs).repartition(3)))
    assert got == sorted([(3, 4, 3), (7, 4, 3), (7, 4, 3), (5, 4, 3), (7, 4, 3), (9, 5, 3), (2, 2, 2), (2, 0, 2),
                          (1, 0, 1)], key=str)
    assert sorted(r.doc_id for r in module.kept_rows(documents(spark, docs)).collect()) == [1, 2, 2, 3]
