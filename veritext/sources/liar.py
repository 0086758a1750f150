"""LIAR TSV loader (S6, S7, T13, L2-L4, P5-P7): header-less, quoting off
(a lone double quote is data), fixed 14 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import remap_liar
from ..functions.text import WS, assemble_statement
from ..operators.sampling import hash_sample
from . import fs
from .fakeddit import read_tsv_strict
from .ids import with_stable_id

# The LIAR column layout.
LIAR_COLUMNS = ["id", "label", "statement", "subject", "speaker", "speaker_job", "state", "party",
                "barely_true_ct", "false_ct", "half_true_ct", "mostly_true_ct", "pants_fire_ct", "context"]
SPLIT_FILES = {"train": "train.tsv", "validation": "valid.tsv", "test": "test.tsv"}


def load_liar(spark: SparkSession, data_dir: str, label_scheme: str = "2way", split: str = "all",
              max_samples: int | None = None, seed: int = 42) -> DataFrame:
    splits = list(SPLIT_FILES) if split == "all" else [split]
    parts = []
    for s in splits:
        path = f"{data_dir.rstrip('/')}/{SPLIT_FILES[s]}"
        if fs.exists(spark, path):
            parts.append(read_tsv_strict(spark, path, quote="", header=False, names=LIAR_COLUMNS)
                         .withColumn("split", F.lit(s)))
    if not parts:
        raise FileNotFoundError(f"{data_dir} holds none of {', '.join(SPLIT_FILES.values())}")
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    # a statement that repeats keeps its own id
    df = with_stable_id(raw).withColumn("text", assemble_statement("statement", "subject"))
    df = remap_liar(df, "label", label_scheme, "label_id", "label")
    df = df.withColumn("source", F.coalesce(F.col("speaker"), F.lit("unknown")))
    stripped = F.regexp_replace(F.col("text"), rf"^[{WS}]+|[{WS}]+$", "")
    df = (df.select("doc_id", "id", "split", "text", "label", "label_id", "source")
            .where(F.col("text").isNotNull() & F.col("label_id").isNotNull())
            .where(F.col("label_id") >= 0)
            .where(F.length(stripped) > 10))
    if max_samples:
        df = hash_sample(df, max_samples, "doc_id", seed)
    return df
