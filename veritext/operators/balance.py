"""Class balancing: balanced weights (A18, B1-B3 live in metrics.py) and
SMOTE oversampling (B4), on dense vectors and on sparse rows.

SMOTE (Chawla et al., 2002): every class is raised to the majority count;
synthetic row i of class c is ``x + lam * (nn - x)`` where x is a base row of
c drawn with replacement, nn one of x's k nearest same-class neighbours and
lam ~ U(0, 1).  All draws are ``hash_key(seed, ...)`` of (class, i), so the
result does not depend on partitioning.  A class of one row has no neighbour:
its synthetic rows are copies (nn is the row itself).

Only the distinct base rows that were drawn are queried, by the pruned exact
search of ``neighbours.py``.  Draws and ranks are thin rows; vectors are joined
to the finished draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, unit_hash
from ..session import staged
from .neighbours import BLOCK_BYTES, knn_within
from .sampling import exact_rank
from .tfidf import constant_array


def draws(rows: DataFrame, k: int, seed: int, block_bytes: int, digits: int | None) -> DataFrame:
    """(label, syn_idx, base_id, nn_id, lam) of ``rows`` (rid, label, val[, idx])."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["label"]
    counts = sorted(rows.where("label is not null").groupBy("label").count().collect())  # one row per class
    target = max((n for _, n in counts), default=0)
    small = [(c, n) for c, n in counts if n < target]
    # a class that gets no rows needs no neighbours
    rows = rows.where(F.col("label").isin([c for c, _ in small])) if small else rows.limit(0)
    starts = [0]
    for _, n in small:
        starts.append(starts[-1] + target - n)
    # one range over all classes: a row finds its class by the classes' starts
    at = F.size(F.filter(constant_array(starts[:-1], "long"), lambda s: s <= F.col("id"))) - 1
    syn = spark.range(starts[-1]).withColumn("_at", at).select(
        F.get(constant_array([c for c, _ in small], kind), "_at").alias("label"),
        F.get(constant_array([n for _, n in small], "long"), "_at").alias("n_c"),
        (F.col("id") - F.get(constant_array(starts[:-1], "long"), "_at")).alias("syn_idx"))
    name = F.col("label").cast("string")
    syn = syn.select(
        "label", "syn_idx", F.pmod(hash_key(seed, F.lit("base"), name, "syn_idx"), F.col("n_c")).alias("_rank"),
        F.pmod(hash_key(seed, F.lit("nn"), name, "syn_idx"),
               F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_c") - 1))).cast("int").alias("slot"),
        unit_hash(seed, F.lit("lam"), name, "syn_idx").alias("lam"))
    ranks = exact_rank(rows.select("rid", "label"), ["label"], "rid", seed, size_col=None)
    drawn = staged(syn.join(ranks, ["label", "_rank"]).select("label", "syn_idx", F.col("rid").alias("base_id"), "slot", "lam"))
    sparse = ["idx"] if "idx" in rows.columns else []
    reference = rows.select("rid", F.col("label").alias("grp"), "val", *sparse)
    asked = reference.join(drawn.select(F.col("base_id").alias("rid")).distinct(), "rid").withColumnRenamed("rid", "qid")
    near = knn_within(asked, reference, k, block_bytes, digits=digits).select(
        F.col("qid").alias("base_id"), "slot", F.col("nid").alias("nn_id"))
    out = drawn.join(near, ["base_id", "slot"], "left")
    return out.select("label", "syn_idx", "base_id", F.coalesce("nn_id", "base_id").alias("nn_id"), "lam")


def _with_rows(found: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``found`` with the columns of the base row (a_) and of its neighbour (b_)."""
    for key, mark in (("base_id", "a_"), ("nn_id", "b_")):
        side = rows.select(F.col("rid").alias("_rid"), *[F.col(c).alias(mark + c) for c in columns])
        found = found.join(side, F.col(key) == F.col("_rid")).drop("_rid")
    return found


def smote(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
          k: int = 5, seed: int = 42, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Synthetic rows only: (label, syn_idx, base_id, nn_id, lam, vec).
    Union them with the original rows for the resampled training set."""
    rows = staged(df.select(F.col(id_col).cast("long").alias("rid"), F.col(label_col).alias("label"),
                            F.col(vec_col).cast("array<double>").alias("val")))
    s = _with_rows(draws(rows, k, seed, block_bytes, None), rows, ["val"])
    vec = F.zip_with("a_val", "b_val", lambda a, b: a + F.col("lam") * (b - a))
    return s.select("label", "syn_idx", "base_id", "nn_id", "lam", vec.alias("vec"))


def smote_sparse(df: DataFrame, id_col: str = "doc_id", label_col: str = "label_id", indices_col: str = "term_indices",
                 values_col: str = "weights", k: int = 5, seed: int = 42, block_bytes: int = BLOCK_BYTES,
                 digits: int = 6) -> DataFrame:
    """``smote`` of sparse rows (ascending indices beside values): (label,
    syn_idx, base_id, nn_id, lam, indices, values).  An interpolated row holds
    the indices of both its rows; distances are compared to ``digits`` places."""
    rows = staged(df.select(F.col(id_col).cast("long").alias("rid"), F.col(label_col).alias("label"),
                            F.col(indices_col).cast("array<int>").alias("idx"),
                            F.col(values_col).cast("array<double>").alias("val")))
    s = _with_rows(draws(rows, k, seed, block_bytes, digits), rows, ["idx", "val"])
    zero = F.lit(0.0)
    mixed = F.map_zip_with(F.map_from_arrays("a_idx", "a_val"), F.map_from_arrays("b_idx", "b_val"),
                           lambda _, a, b: F.coalesce(a, zero) + F.col("lam") * (F.coalesce(b, zero) - F.coalesce(a, zero)))
    s = s.withColumn("_e", F.array_sort(F.map_entries(mixed)))
    return s.select("label", "syn_idx", "base_id", "nn_id", "lam", F.col("_e.key").alias("indices"),
                    F.col("_e.value").alias("values"))
