"""Deterministic sampling and exact stratified splitting.

Every random choice is ``hash_key(seed, key)``: independent of partitioning
and reproducible in SQL.  Splits, folds and samples are all a selection of
ranks in (hash, key) order inside a class, and a selection is a comparison of
each row, where it is, with a few thresholds of its class:

1. bucket = top ``bits`` of the 32-bit hash; count rows per (class, bucket)
   -- a map-side-combined aggregate of at most 2^bits * k rows;
2. running sums place each wanted rank in one bucket;
3. only the (class, key) of those buckets are ranked, which gives the
   (hash, key) at each wanted rank.

No text is shuffled and no task holds a class, at any size.  ``exact_rank``
numbers all rows instead (two-level: offset of the bucket plus the rank inside
it) where a rank itself is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import staged


def with_hash(df: DataFrame, key: str, seed: int = 42, name: str = "_h") -> DataFrame:
    return df.withColumn(name, hash_key(seed, key))


def exact_rank(df: DataFrame, strata: list[str], key: str, seed: int = 42,
               bits: int = 16, rank_col: str = "_rank", size_col: str | None = "_n") -> DataFrame:
    """0-based rank of each row inside its stratum, ordered by (hash, key).
    Adds ``size_col`` = stratum size when requested.

    ``key`` should be unique: rows sharing a key share a hash and therefore
    a bucket.  With 16 bits a class of 3e11 rows yields ~5e6 rows per
    ranking window group."""
    if bits < 0 or bits > 24:
        raise ValueError("bits must be in [0, 24]")
    h = df.withColumn("_h", hash_key(seed, key)).withColumn(
        "_b", F.shiftright(F.col("_h"), 32 - bits) if bits else F.lit(0))
    cells = h.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wcum = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*strata)
    # written once: Spark broadcasts the table or not by its size
    offsets = staged(cells.select(
        *strata, "_b",
        F.coalesce(F.sum("_cnt").over(wcum), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(wall).alias("_stratum_n"),
    ))
    joined = h.join(offsets, [*strata, "_b"])
    w = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    out = joined.withColumn(rank_col, (F.row_number().over(w) - 1 + F.col("_off")).cast("long"))
    if size_col:
        out = out.withColumnRenamed("_stratum_n", size_col)
    else:
        out = out.drop("_stratum_n")
    return out.drop("_b", "_off", "_h")


def _ceil_pct(n, pct: int):
    """ceil(n * pct / 100) in exact integer arithmetic."""
    return F.floor((n * F.lit(pct) + F.lit(99)) / F.lit(100)).cast("long")


def thresholds(df: DataFrame, class_col: str | Column, key: str, ranks: list[Callable[[Column], Column]],
               seed: int = 42, bits: int = 16) -> DataFrame:
    """One row per class: for rank number i (a function of the class size)
    ``_cut_i`` is the (hash, key) of the row at that 0-based rank, null when
    the class ends before it.

    Only (class, key) is read.  Bucket counts place each rank in one bucket, and
    only those buckets' rows (n / 2^bits of a class) are ranked."""
    cls = F.col(class_col) if isinstance(class_col, str) else class_col
    ids = df.select(cls.alias("_class"), F.col(key).alias("_key"), hash_key(seed, key).alias("_h")) \
        .withColumn("_b", F.shiftright(F.col("_h"), 32 - bits) if bits else F.lit(0)).where("_class is not null")
    cells = ids.groupBy("_class", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    one = Window.partitionBy("_class")
    upto = one.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_off", F.sum("_cnt").over(upto) - F.col("_cnt")).withColumn("_n", F.sum("_cnt").over(one))
    at = F.array(*[F.struct(F.lit(i).alias("_i"), rank(F.col("_n")).cast("long").alias("_at"))
                   for i, rank in enumerate(ranks)])
    # a row per class and rank, and the class itself where no rank falls inside
    cells = cells.select("_class", "_b", "_off", F.filter(
        at, lambda x: (x["_at"] >= F.col("_off")) & (x["_at"] < F.col("_off") + F.col("_cnt"))).alias("_in"))
    bounds = staged(cells.where((F.size("_in") > 0) | (F.col("_off") == 0))
                    .select("_class", "_b", "_off", F.explode_outer("_in").alias("_x"))
                    .select("_class", "_b", "_off", "_x._i", "_x._at"))
    rank = F.row_number().over(Window.partitionBy("_class", "_b", "_i").orderBy("_h", "_key")) - 1 + F.col("_off")
    first = (ids.join(bounds.where("_i is not null"), ["_class", "_b"]).withColumn("_rank", rank)
                .where(F.col("_rank") == F.col("_at")).select("_class", "_i", F.struct("_h", "_key").alias("_first")))
    cols = [F.max(F.when(F.col("_i") == i, F.col("_first"))).alias(f"_cut_{i}") for i in range(len(ranks))]
    return staged(bounds.select("_class").distinct().join(first, "_class", "left").groupBy("_class").agg(*cols))


def _pieces(df: DataFrame, class_col: str | Column, key: str, ranks: list[Callable[[Column], Column]],
            names: list[str] | list[int], seed: int, bits: int, out_col: str) -> DataFrame:
    """``out_col`` = ``names[i]`` for rows before rank i (and not before an
    earlier one), the last name for the others."""
    cls = F.col(class_col) if isinstance(class_col, str) else class_col
    cuts = thresholds(df, class_col, key, ranks, seed, bits)
    me = F.struct(hash_key(seed, key).alias("_h"), F.col(key).alias("_key"))
    piece = F.lit(names[-1])
    for i in reversed(range(len(ranks))):
        piece = F.when(F.col(f"_cut_{i}").isNull() | (me < F.col(f"_cut_{i}")), F.lit(names[i])).otherwise(piece)
    return (df.join(cuts, cls == F.col("_class")).withColumn(out_col, piece)
              .drop("_class", *[f"_cut_{i}" for i in range(len(ranks))]))


def stratified_split(df: DataFrame, label_col: str = "label_id", key: str = "doc_id",
                     test_pct: int = 20, val_pct: int = 10, seed: int = 42,
                     bits: int = 16, split_col: str = "split") -> DataFrame:
    """Exact per-class split: the first ceil(n_c*test%) rows of a class (in
    hash order) are test, the next up to ceil(n_c*(test+val)%) are val, the
    rest train.  Percentages are integers so the cut is exact.  ``key`` is
    unique (rows that share one fall on the same side); rows without a class
    are dropped."""
    ranks = [lambda n, p=p: _ceil_pct(n, p) for p in (test_pct, test_pct + val_pct)]
    return _pieces(df, label_col, key, ranks, ["test", "val", "train"], seed, bits, split_col)


def kfold_assign(df: DataFrame, k: int = 3, label_col: str = "label_id", key: str = "doc_id",
                 seed: int = 42, bits: int = 16, fold_col: str = "fold") -> DataFrame:
    """Stratified k-fold: fold = floor(rank * k / n) of each class in hash
    order, so a class's fold sizes differ by one at most.  Like the split: a
    comparison with k - 1 thresholds, ``key`` unique, rows without a class
    dropped."""
    ranks = [lambda n, i=i: F.floor((n * F.lit(i) + F.lit(k - 1)) / F.lit(k)) for i in range(1, k)]
    return _pieces(df, label_col, key, ranks, list(range(k)), seed, bits, fold_col)


def hash_split(df: DataFrame, key: str = "doc_id", test_frac: float = 0.2,
               val_frac: float = 0.1, seed: int = 42, split_col: str = "split") -> DataFrame:
    """Approximate (Bernoulli) split by hash threshold: no shuffle at all."""
    u = hash_key(seed, key)
    t1 = int(test_frac * 2 ** 32)
    t2 = int((test_frac + val_frac) * 2 ** 32)
    return df.withColumn(split_col, F.when(u < t1, "test").when(u < t2, "val").otherwise("train"))


def hash_sample(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42,
                strata: list[str] | None = None, bits: int = 16) -> DataFrame:
    """Exact-size sample without replacement: the n rows (of each stratum) with
    the smallest (hash, key), all rows where there are fewer.  ``key`` is
    unique; rows that share one are taken or left together."""
    cls = F.struct(*strata) if strata else F.lit(0)
    cut = thresholds(df, cls, key, [lambda _: F.lit(n)], seed, bits)
    me = F.struct(hash_key(seed, key).alias("_h"), F.col(key).alias("_key"))
    taken = F.col("_cut_0").isNull() | (me < F.col("_cut_0"))
    return df.join(cut, cls == F.col("_class")).where(taken).drop("_class", "_cut_0")


def shuffle_key(df: DataFrame, key: str = "doc_id", seed: int = 42, name: str = "shuffle_key") -> DataFrame:
    """Deterministic shuffle order (W8) without sorting: order by this column
    only where an order is actually consumed."""
    return df.withColumn(name, hash_key(seed, key))
