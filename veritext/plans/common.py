"""Shared bindings of the driver tables used by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ml import TextPreprocessor
from ..operators.sampling import stratified_split
from ..session import staged
from ..sources.tables import labelled_corpus

SEED = 42
# The credibility dimension bound to the driver's sources:
# src0..src17 -> id mod 3 (0 reliable, 1 mixed, 2 unreliable); src18, src19
# stay unmapped so the anti-join has rows.
CRED_SOURCES = {f"src{i}": i % 3 for i in range(18)}


def preprocessor(**options) -> TextPreprocessor:
    """The default preprocessing (T10): clean, drop stop words, lemmatise, drop
    rows that end up empty."""
    return TextPreprocessor(inputCol="clean_text", **options)


def prepared(df: DataFrame, pre: TextPreprocessor | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with ``clean_text`` in place of its text.  Written once: splits,
    vocabulary and transforms read the stored rows."""
    return staged((pre or preprocessor()).transform(df.withColumnRenamed(text_col, "clean_text")))


def cleaned_corpus(spark: SparkSession, d: str, scheme: str = "binary", pre: TextPreprocessor | None = None) -> DataFrame:
    """Labelled corpus, preprocessed."""
    return prepared(labelled_corpus(spark, d, scheme), pre)


def split_corpus(spark: SparkSession, d: str, test_pct: int = 20, val_pct: int = 10,
                 pre: TextPreprocessor | None = None) -> DataFrame:
    """Preprocessed corpus with its exact split."""
    return stratified_split(cleaned_corpus(spark, d, pre=pre), "label_id", "doc_id", test_pct, val_pct, SEED)


def credibility_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CRED_SOURCES.items()), "source_key string, label_id int")
