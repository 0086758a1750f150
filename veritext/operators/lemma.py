"""Rule-based noun lemmatiser (T9, J6) re-aimed as joins.

Distinct tokens x detachment rules -> candidate forms; candidates are kept
when they occur in a lexicon table; the shortest accepted form wins (the
token itself counts when it is in the lexicon), ties by rule order.  An
exception table overrides everything.  The lexicon is a parameter; the
default is the corpus's own tokens with document frequency >= ``min_df``.
All steps are equi-joins/aggregates keyed by token, so the work scales with
the vocabulary, not with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_clean
from ..session import staged

HOT_TOKENS = 1000

# Noun detachment rules (suffix, replacement) in order.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
              ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]
# Irregular plurals (standard English).
IRREGULAR = {
    "children": "child", "men": "man", "women": "woman", "people": "person",
    "mice": "mouse", "feet": "foot", "teeth": "tooth", "geese": "goose",
    "data": "datum", "media": "medium", "criteria": "criterion",
    "phenomena": "phenomenon", "analyses": "analysis", "crises": "crisis",
    "theses": "thesis",
}


def token_table(df: DataFrame, clean_col: str = "clean_text", id_col: str = "doc_id") -> DataFrame:
    """(token, df): document frequency of every token of a cleaned text."""
    # one row = one document: the per-document distinct happens inside the
    # row (array_distinct), so only the token-keyed count is shuffled
    toks = df.select(F.explode(F.array_distinct(split_clean(clean_col))).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def lemma_table(tokens: DataFrame, lexicon: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, lemma) for every distinct token."""
    spark = tokens.sparkSession
    t = F.col(token_col)
    cands = [F.struct(F.lit(0).alias("ord"), t.alias("cand"))]
    for i, (suf, rep) in enumerate(NOUN_RULES, start=1):
        cands.append(F.when(t.endswith(suf) & (F.length(t) > len(suf)),
                            F.struct(F.lit(i).alias("ord"),
                                     F.concat(F.expr(f"substring({token_col}, 1, length({token_col}) - {len(suf)})"),
                                              F.lit(rep)).alias("cand"))))
    ex = tokens.select(token_col, F.explode(F.filter(F.array(*cands), lambda c: c.isNotNull())).alias("c"))
    ex = ex.select(token_col, "c.ord", "c.cand")
    lex = lexicon.select(F.col(lexicon.columns[0]).alias("cand")).distinct()
    acc = ex.join(lex, "cand", "left_semi")
    best = acc.groupBy(token_col).agg(
        F.min(F.struct(F.length("cand").alias("l"), F.col("ord"), F.col("cand"))).alias("b"))
    exc = spark.createDataFrame(list(IRREGULAR.items()), f"{token_col} string, _exc string")
    return (tokens.select(token_col)
                  .join(best, token_col, "left")
                  .join(F.broadcast(exc), token_col, "left")
                  .select(token_col, F.coalesce("_exc", "b.cand", token_col).alias("lemma")))


def may_change(token: Column) -> Column:
    """Tokens that a detachment rule or the exception table can change."""
    rules = [token.endswith(suffix) for suffix, _ in NOUN_RULES]
    return reduce(or_, rules) | token.isin(list(IRREGULAR))


def fit_lemmas(df: DataFrame, clean_col: str = "clean_text", lexicon: DataFrame | None = None,
               min_df: int = 2) -> DataFrame:
    """(token, lemma, df) of the tokens of ``df`` that change.  The default
    lexicon is the tokens of ``df`` that ``min_df`` documents hold."""
    tokens = staged(token_table(df, clean_col))  # grows with the vocabulary, not with the corpus
    if lexicon is None:
        lexicon = tokens.where(F.col("df") >= min_df).select("token")
    open_tokens = tokens.where(may_change(F.col("token")))
    lemmas = lemma_table(open_tokens.select("token"), lexicon)
    return staged(lemmas.where("lemma <> token").join(open_tokens, "token"))


def lemmatise_text(df: DataFrame, lemmas: DataFrame, clean_col: str = "clean_text",
                   id_col: str = "doc_id", out_col: str = "lemma_text",
                   candidate: Callable[[Column], Column] | None = may_change) -> DataFrame:
    """Apply a (token, lemma[, df]) table to a cleaned text column, keeping
    order.  No row per token occurrence is made: a document sends its distinct
    tokens that pass ``candidate`` (None: all), gets back the few that change,
    and replaces them inside its row.

    A token in many documents does not gather in one task: those that could
    hold a thousandth of all pairs (a thousand tokens at most, by their
    document frequency) are matched by a broadcast, the others by a join on
    the token.  Rows that share an id get the union of their answers, which is
    the same for each token; a null id is an id."""
    changes = lemmas.where("lemma <> token")
    pairs = df.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(split_clean(clean_col))).alias("token"))
    if candidate is not None:  # on rows: compiled, where a lambda over the array is interpreted
        pairs = pairs.where(candidate(F.col("token")))
    if "df" not in changes.columns:
        changes = changes.join(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    total = changes.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("df") * HOT_TOKENS >= F.lit(total)
    hot = changes.where(is_hot).select(F.col("token").alias("_hot"), F.col("lemma").alias("_hot_lemma"))
    seen = pairs.join(F.broadcast(hot), F.col("token") == F.col("_hot"), "left")  # HOT_TOKENS rows at most
    rest = seen.where("_hot is null").select("_id", "token").join(
        changes.where(~is_hot).select("token", "lemma"), "token").select("_id", "token", "lemma")
    found = seen.where("_hot is not null").select("_id", "token", F.col("_hot_lemma").alias("lemma")).unionByName(rest)
    answers = found.groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_map"))
    back = df.join(answers, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    replaced = F.transform(F.split(clean_col, " "), lambda t: F.coalesce(F.try_element_at("_map", t), t))
    out = F.when(F.col("_map").isNull(), F.col(clean_col)).otherwise(F.array_join(replaced, " "))
    return back.withColumn(out_col, out).drop("_id", "_map")
