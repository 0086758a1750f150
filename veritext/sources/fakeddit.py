"""Fakeddit TSV loader.

Per existing split file (or folder of parts): header TSV with pandas-style
quoting; rows with MORE fields than the header are dropped (counted on the raw
line), shorter rows are null-padded and kept.  Text = ``clean_title``
if that column exists, else ``title``; label column ``{n}_way_label`` with
fallback 6 -> 3 -> 2; only the label *name* follows the scheme, the id stays
the raw id.  Topic filter when ``subreddit`` exists; then null rows are
dropped; ``max_samples`` is an exact hash sample taken *after* filtering.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import FAKEDDIT_SCHEMES, map_expr
from ..operators.sampling import hash_sample
from . import fs
from .ids import with_stable_id

# File and column names of the corpus.
SPLIT_FILES = {"train": "train.tsv", "val": "validate.tsv", "test": "test.tsv"}
KEEP = ["clean_title", "title", "subreddit", "2_way_label", "3_way_label", "6_way_label"]


def field_count(line: Column, sep: str, quote: str) -> Column:
    """Fields of a raw line: separators outside quoted fields, plus one.  A
    quote opens a field only at its start, a doubled quote inside is data, and
    an unclosed one runs to the end of the line."""
    if quote:
        s, q = re.escape(sep), re.escape(quote)
        line = F.regexp_replace(line, f"(^|{s}){q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+(?:{q}|$)", "$1")
    return F.regexp_count(line, F.lit(re.escape(sep))) + 1


def read_tsv_strict(spark: SparkSession, path: str, sep: str = "\t", quote: str = '"',
                    header: bool = True, names: list[str] | None = None) -> DataFrame:
    """All-string read, one record per line.  Lines with more fields than the
    header/names are dropped, also when the surplus fields are empty; shorter
    lines are kept, padded with nulls; blank lines and (with ``header``) lines
    equal to the header are no records."""
    options = {"sep": sep, "quote": quote, "escape": quote or "\\", "mode": "PERMISSIVE"}
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    if header:
        first = lines.first()
        if first is None:
            return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names or KEEP))
        lines = lines.where(F.col("value") != first["value"])
        if names is None:
            names = spark.read.options(**options).option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    kept = lines.where(field_count(F.col("value"), sep, quote) <= len(names))
    return kept.select(F.from_csv("value", schema.toDDL(), options).alias("r")).select("r.*")


def topic_mask(sub_col, text_col):
    from ..plans.queries import topic_predicate
    return topic_predicate(sub_col, text_col)


def load_fakeddit(spark: SparkSession, data_dir: str, label_scheme: str = "6way",
                  filter_political: bool = True, max_samples: int | None = None,
                  seed: int = 42) -> dict[str, DataFrame]:
    scheme_map = FAKEDDIT_SCHEMES[label_scheme]
    out: dict[str, DataFrame] = {}
    for split, fname in SPLIT_FILES.items():
        path = f"{data_dir.rstrip('/')}/{fname}"
        if not fs.exists(spark, path):
            continue  # a missing split is skipped
        raw = read_tsv_strict(spark, path)
        cols = set(raw.columns)
        if "clean_title" in cols:
            text = F.col("clean_title")
        elif "title" in cols:
            text = F.col("title")
        else:
            continue
        want = f"{label_scheme.replace('way', '')}_way_label"
        label_col = want if want in cols else next(
            (c for c in ["6_way_label", "3_way_label", "2_way_label"] if c in cols), None)
        if label_col is None:
            continue
        raw = raw.select(*[c for c in KEEP if c in cols]).withColumn("split", F.lit(split))
        df = with_stable_id(raw).withColumn("text", text)
        df = df.withColumn("label_id", F.expr(f"try_cast(`{label_col}` AS INT)"))
        df = df.withColumn("label", F.element_at(map_expr(scheme_map), F.col("label_id")))
        if filter_political and "subreddit" in cols:
            df = df.where(topic_mask(F.col("subreddit"), F.col("text")))
        df = df.select("doc_id", "text", "label", "label_id").dropna()
        if max_samples:
            df = hash_sample(df, max_samples, "doc_id", seed)
        out[split] = df.withColumn("split", F.lit(split))
    return out


def union_splits(splits: dict[str, DataFrame]) -> DataFrame | None:
    dfs = list(splits.values())
    if not dfs:
        return None
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
