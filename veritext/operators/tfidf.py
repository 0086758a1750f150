"""TF-IDF in two faces (F1-F8).

* long form ``(doc_id, term, tf, weight)`` for SQL-style work (NB, top
  features, oracle checks);
* MLlib sparse ``features`` vectors for the classifiers.

Semantics: tokens of >= 2 letters from cleaned text, 1..n-grams built on
that token list, vocabulary fitted on the training rows only (min_df
documents, drop df > max_df * n_docs, then the ``max_features`` terms with
the highest raw corpus count, ties by term), sublinear tf ``1 + ln(tf)``,
smooth idf ``ln((1 + n) / (1 + df)) + 1``, L2-normalised rows.

Scale: the vocabulary statistics (df, total_tf) need no (doc, term) rows
at all: each document's term array is sorted inside its row, so a term's
first occurrence in the sorted array marks its document-frequency
contribution; one map-side-combined ``groupBy(term)`` then yields both
counts (a hot term costs one row per partition, one shuffle keyed by term).

The transform shuffles nothing.  A row's term array is counted against the
fitted vocabulary by MLlib's ``CountVectorizerModel`` (a JVM hash map, held
once per task), the counts are weighted and normalised as arrays inside the
row, and both faces are read off these arrays: the long face explodes them,
the vector face stores them in the form in which a sparse vector is stored.
The fitted vocabulary is bounded by ``max_features`` <= ``MAX_VOCABULARY``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

MAX_VOCABULARY = 2_000_000  # terms that one task may hold


def token_string(clean_col: str = "clean_text") -> F.Column:
    """Cleaned text (single-spaced [a-z ]) without its one-letter words: one
    regex (codegen)."""
    padded = F.concat(F.lit(" "), F.col(clean_col), F.lit(" "))
    return F.trim(F.regexp_replace(padded, " (?:[a-z] )+", " "))


def token_array(clean_col: str = "clean_text") -> F.Column:
    """Tokens of >= 2 letters of a cleaned text."""
    return F.split(token_string(clean_col), " ")


def gram_array(clean_col: str = "clean_text", n_max: int = 2) -> F.Column:
    """All 1..n_max-grams of a row as one array (built-in functions only).
    An n-gram starts at every token start: a zero-width match (start of
    string or after a space) whose look-ahead captures n tokens."""
    s = token_string(clean_col)
    parts = [F.split(s, " ")]
    for n in range(2, n_max + 1):
        pattern = "(?<![^ ])(?=([^ ]+" + "(?: [^ ]+)" * (n - 1) + "))"
        parts.append(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def constant_array(values: list, kind: str) -> Column:
    """A list as one folded array literal, held once per task (an array of
    literals would be planned node by node).  No value holds a comma."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def generated(df: DataFrame, column: Column, name: str) -> DataFrame:
    """``df`` with ``column`` as a generated column: later lambdas read its
    value, the optimiser cannot copy its expression into them."""
    return df.select("*", F.explode(F.array(column)).alias(name))


@dataclass
class TfidfModel:
    vocab: DataFrame          # term, term_index, df, total_tf, idf  (<= max_features rows)
    terms: list[str]          # by term_index
    idf: list[float]
    n_docs: int
    n_max: int = 2
    clean_col: str = "clean_text"

    @property
    def vocab_size(self) -> int:
        return len(self.terms)

    def sparse_rows(self, df: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
        """(id, keep..., term_indices, tf, weights): one row per row of ``df``,
        three aligned arrays by term index; out-of-vocabulary terms vanish (J7)
        and a row without terms has empty arrays.  Nothing is shuffled."""
        columns = [id_col, *(keep or [])]
        grams = df.select(*columns, gram_array(self.clean_col, self.n_max).alias("_grams"))
        if not self.terms:
            none = F.array()
            return grams.select(*columns, none.cast("array<int>").alias("term_indices"),
                                none.cast("array<int>").alias("tf"), none.cast("array<double>").alias("weights"))
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_grams", outputCol="_counts")
        rows = counter.transform(grams).select(*columns, F.unwrap_udt("_counts").alias("_v"))
        idf = constant_array(self.idf, "double")
        raw = F.zip_with("_v.indices", "_v.values", lambda i, n: (1.0 + F.log(n)) * F.get(idf, i))
        rows = generated(rows, raw, "_raw")
        squares = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x * x)
        rows = generated(rows, F.sqrt(squares), "_norm")
        return rows.select(*columns, F.col("_v.indices").alias("term_indices"),
                           F.col("_v.values").cast("array<int>").alias("tf"),
                           F.transform("_raw", lambda x: x / F.col("_norm")).alias("weights"))

    def transform_long(self, df: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
        """(id, keep..., term, term_index, tf, weight), one row per row and vocabulary term."""
        rows = self.sparse_rows(df, id_col, keep)
        parts = F.arrays_zip(F.col("term_indices").alias("term_index"), F.col("tf").alias("tf"),
                             F.col("weights").alias("weight"))
        long = rows.select(id_col, *(keep or []), F.inline(parts))
        term = F.get(constant_array(self.terms, "string"), F.col("term_index"))
        return long.select(id_col, *(keep or []), term.alias("term"), "term_index", "tf", "weight")

    def transform_vectors(self, df: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None,
                          features_col: str = "features") -> DataFrame:
        """One row per input row with an MLlib SparseVector (all-zero when no
        vocabulary term occurs), written once and read back: training iterates
        over the stored vectors, never over the text."""
        rows = self.sparse_rows(df, id_col, keep)
        columns = [id_col, *(keep or [])]
        return staged_vectors(rows, columns, self.vocab_size, "term_indices", "weights", features_col)


def staged_vectors(rows: DataFrame, columns: list[str], size: int, indices_col: str, values_col: str,
                   features_col: str = "features") -> DataFrame:
    """``columns`` and a sparse vector of two arrays, staged in the vector's
    stored form (kind 0: sparse)."""
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      F.col(indices_col).alias("indices"), F.col(values_col).alias("values"))
    out = rows.select(*columns, stored.alias(features_col))
    schema = T.StructType([f for f in out.schema if f.name != features_col] + [T.StructField(features_col, VectorUDT())])
    return staged(out, schema)


def term_stats(df: DataFrame, id_col: str = "doc_id", clean_col: str = "clean_text", n_max: int = 2) -> DataFrame:
    """(term, df, total_tf) without any (doc, term) shuffle: sort each row's
    term array, flag the first element of every run (that is the row's one
    document-frequency contribution), explode, and aggregate by term.  The
    partial aggregation caps a hot term at one row per partition before the
    single shuffle keyed by term.  Correct for any input row that is one
    document (``id_col`` unique)."""
    # sort_array compares the strings themselves, array_sort would call its lambda for every comparison
    srt = df.select(F.sort_array(gram_array(clean_col, n_max)).alias("_s"))
    # pair every element with its predecessor (the array shifted by one) so
    # the generator emits (term, prev) and never carries the array itself
    prev = F.concat(F.array(F.lit(None).cast("string")),
                    F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))))
    ex = (srt.select(F.inline(F.arrays_zip(F.col("_s").alias("term"), prev.alias("prev"))))
             .where(F.col("term") != ""))
    first = F.col("prev").isNull() | (F.col("prev") != F.col("term"))
    return (ex.groupBy("term")
              .agg(F.sum(first.cast("long")).alias("df"), F.count(F.lit(1)).alias("total_tf")))


def top_by_count(df: DataFrame, n: int, count_col: str, key_col: str) -> DataFrame:
    """The n rows with the largest ``count_col`` (ties by ``key_col``).

    A plain ``orderBy().limit(n)`` merges up to n rows from every partition
    in one task.  Instead the cutoff (the n-th largest count) is read from a
    small count of rows per count value, and only rows at or above it reach
    the top-n merge: about n rows (+ ties at the cutoff)."""
    rows = staged(df)  # read by the histogram and the top-n
    hist = rows.groupBy(count_col).agg(F.count(F.lit(1)).alias("_c"))
    cum = F.sum("_c").over(Window.orderBy(F.desc(count_col)).rowsBetween(Window.unboundedPreceding, 0))
    cut = hist.select(count_col, cum.alias("_cum")).where(F.col("_cum") >= n).agg(F.max(count_col)).first()[0]
    cand = rows if cut is None else rows.where(F.col(count_col) >= F.lit(cut))
    return cand.orderBy(F.desc(count_col), key_col).limit(n)


def fit_tfidf(df: DataFrame, clean_col: str = "clean_text", id_col: str = "doc_id",
              max_features: int = 10000, n_max: int = 2, min_df: int = 2, max_df: float = 0.95) -> TfidfModel:
    """Fit on the given (training) rows.  Two small actions: the document
    count and the bounded vocabulary (<= max_features rows)."""
    if max_features > MAX_VOCABULARY:
        raise ValueError(f"max_features is above {MAX_VOCABULARY}, the terms that a task may hold")
    spark: SparkSession = df.sparkSession
    n_docs = df.count()
    stats = term_stats(df, id_col, clean_col, n_max)
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    rows = top_by_count(kept, max_features, "total_tf", "term").collect()  # bounded by max_features
    rows.sort(key=lambda r: r["term"])
    idf = [math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in rows]
    data = [(r["term"], i, int(r["df"]), int(r["total_tf"]), idf[i]) for i, r in enumerate(rows)]
    vocab = spark.createDataFrame(data, "term string, term_index int, df long, total_tf long, idf double")
    return TfidfModel(vocab, [r["term"] for r in rows], idf, n_docs, n_max, clean_col)
