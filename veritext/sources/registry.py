"""Dataset dispatch (S14): one entry point for every corpus family.

``both`` concatenates Fakeddit and NELA with ``unionByName(allowMissing)``
after both are harmonised to binary (ids mean different things otherwise,
D3) and uses whatever exists (D4); ``data_dir`` then holds the folders
``fakeddit`` and ``nela``.  ``doc_id`` is unique within a corpus, so keys of
``both`` are (corpus, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import harmonise_binary


def load_corpus(spark: SparkSession, dataset: str, data_dir: str | None = None, label_scheme: str = "2way",
                max_samples: int | None = None, seed: int = 42, n_samples: int = 2000) -> DataFrame:
    if dataset == "fakeddit":
        from .fakeddit import load_fakeddit, union_splits
        out = union_splits(load_fakeddit(spark, data_dir or "data/fakeddit", label_scheme,
                                         max_samples=max_samples, seed=seed))
        if out is None:
            raise FileNotFoundError("no Fakeddit split files found")
        return out
    if dataset == "liar":
        from .liar import load_liar
        return load_liar(spark, data_dir or "data/liar", label_scheme, max_samples=max_samples, seed=seed)
    if dataset == "nela":
        from .nela import load_nela
        return load_nela(spark, data_dir or "data/nela", max_samples, seed)
    if dataset == "sample":
        from .synthetic import generate_corpus
        return generate_corpus(spark.range(n_samples).withColumnRenamed("id", "doc_id"), "doc_id",
                               label_scheme, seed)
    if dataset == "both":
        parts = []
        for name, scheme in (("fakeddit", "fakeddit" + label_scheme.replace("way", "")), ("nela", "ternary")):
            try:
                df = load_corpus(spark, name, f"{data_dir.rstrip('/')}/{name}" if data_dir else None, label_scheme,
                                 max_samples, seed)
            except FileNotFoundError:
                continue
            parts.append(harmonise_binary(df, scheme).withColumn("corpus", F.lit(name)))
        if not parts:
            raise FileNotFoundError("neither Fakeddit nor NELA data found")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    raise ValueError(f"unknown dataset {dataset!r}")
