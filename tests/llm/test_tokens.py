"""Hashes of words and windows: long words of few letters, brute force."""

import random

import numpy as np

from tests.llm.test_ngram_join import brute
from tests.llm.util import documents, rows_of
from veritext.llm import tokens as tk
from veritext.llm.ngram_join import ngram_join
from veritext.llm.substring_dedup import substring_dedup


def thue(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits[:n])


def test_words_of_two_letters_differ():
    for n in (1024, 4096):
        w = tk.Words([" ".join([thue(n, "a", "b"), thue(n, "b", "a"), thue(n, "a", "b")]).encode()])
        for seed in (0, 1):
            h = w.hashes(seed)
            assert h[0] != h[1] and h[0] == h[2]
        assert (w.hashes(0) != w.hashes(1)).all()


def test_hashes_depend_on_the_bytes_alone():
    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(1, 40))) for _ in range(5000)]
    buffer = np.frombuffer(b" ".join(words), np.uint8)
    w = tk.Words([b" ".join(words)])
    found = {}
    for word, h in zip(words, w.hashes().tolist(), strict=True):
        assert found.setdefault(word, h) == h
    assert len(set(found.values())) == len(found)
    for width in (1, 7, 8, 9, 24):
        seen = {}
        for i, h in enumerate(tk.grams(buffer, width)[:4000].tolist()):
            assert seen.setdefault(bytes(buffer[i:i + width]), h) == h
        assert len(set(seen.values())) == len(seen)
    for width in (1, 2, 5, 20, 31):
        seen = {}
        for i, h in enumerate(tk.windows(w.hashes(), width).tolist()):
            assert seen.setdefault(tuple(words[i:i + width]), h) == h
        assert len(set(seen.values())) == len(seen)
    assert len(tk.windows(w.hashes()[:3], 5)) == 0 and len(tk.grams(buffer[:3], 5)) == 0


def test_long_words_are_neither_linked_nor_removed(spark):
    x, y = thue(4096, "a", "b"), thue(4096, "b", "a")
    docs = [(1, " ".join([x, *"bcdefg"])), (2, " ".join([y, *"bcdefg"])), (3, " ".join([x, *"bcdefg"])), (4, x), (5, y)]
    assert rows_of(ngram_join(documents(spark, docs))) == brute(docs)
    pad = [f"w{i}" for i in range(19)]
    docs = [(1, " ".join([x, *pad])), (2, " ".join([y, *pad])), (3, " ".join([x, *pad]))]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup(documents(spark, docs)).collect()}
    assert got == {1: (0, docs[0][1]), 2: (0, docs[1][1]), 3: (20, "")}
