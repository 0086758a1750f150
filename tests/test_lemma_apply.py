"""Lemmas mapped back into the rows: brute force, odd rows, plan."""
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veritext.operators import lemma


def brute_lemmas(texts, min_df=2):
    df = Counter(t for x in texts for t in set(x.split()))
    lexicon = {t for t, n in df.items() if n >= min_df}
    out = {}
    for t in df:
        forms = [(len(t), 0, t)] + [(len(t) - len(s) + len(r), i, t[:-len(s)] + r)
                                    for i, (s, r) in enumerate(lemma.NOUN_RULES, 1) if t.endswith(s) and len(t) > len(s)]
        best = min((f for f in forms if f[2] in lexicon), default=(0, 0, t))
        out[t] = lemma.IRREGULAR.get(t, best[2])
    return out


def texts(n, seed=5):
    rnd = random.Random(seed)
    pool = ["cat", "cats", "bus", "buses", "class", "classes", "wolf", "wolves", "women", "data", "city", "cities", "s",
            "news", "box", "boxes", "tree"] + [f"w{i}s" for i in range(30)] + [f"w{i}" for i in range(0, 30, 2)]
    return [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_lemmas_equal_brute_force(spark):
    rows = list(enumerate(texts(80))) + [(900, ""), (901, None), (None, "cats cat"), (7, "wolves"), (7, "boxes box")]
    df = spark.createDataFrame(rows, "doc_id long, clean_text string").withColumn("token", F.lit("clash"))
    want = brute_lemmas([t or "" for _, t in rows])
    table = lemma.fit_lemmas(df)
    assert {r.token: r.lemma for r in table.collect()} == {t: x for t, x in want.items() if t != x}
    out = lemma.lemmatise_text(df, table)
    assert out.columns == ["doc_id", "clean_text", "token", "lemma_text"]
    for r in out.collect():
        assert (r.clean_text, r.lemma_text) == (r.clean_text, r.clean_text and " ".join(want[t] for t in r.clean_text.split()))
    assert out.count() == len(rows)
    assert lemma.lemmatise_text(df.limit(0), table).collect() == []


def test_hot_tokens_and_a_given_table(spark, monkeypatch):
    docs = texts(60, 8)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, clean_text string")
    given = spark.createDataFrame([("tree", "plant"), ("cats", "cat"), ("bus", "bus")], "token string, lemma string")
    for share in (1, 1000, 10 ** 9):  # none, some, all of the tokens are matched by the broadcast
        monkeypatch.setattr(lemma, "HOT_TOKENS", share)
        got = {r.doc_id: r.lemma_text for r in lemma.lemmatise_text(df, given, candidate=None).collect()}
        assert got == {i: re.sub(r"\btree\b", "plant", re.sub(r"\bcats\b", "cat", t)) for i, t in enumerate(docs)}


def test_no_exchange_per_occurrence(spark):
    df = spark.createDataFrame(list(enumerate(texts(20))), "doc_id long, clean_text string")
    plan = lemma.lemmatise_text(df, lemma.fit_lemmas(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("array_distinct") == plan.count("Generate explode")
