"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. One scan makes a small table: id, 64-bit fingerprint and SHA-256 of the
   (normalised) text, and a slice number.
2. Every slice sends its sorted, Golomb-coded fingerprints to the owners of
   the hash ranges and receives for each one how often it occurs
   (:mod:`exchange`); those that occur twice or more mark suspects.
3. Only the suspects' texts are shuffled, grouped by the bytes themselves
   (with partial aggregation, so a text that a third of all rows share costs
   one row per task), which verifies equality.
4. The groups are joined back to the ids by SHA-256 (rows of some 60 bytes;
   AQE splits a hot one).

Defined results: a null text counts as empty; a null id is smaller than any
other; of repeated rows with one id and one text exactly one is kept, whichever;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as ex
from .common import by_group, by_groups, shuffle_partitions, slice_of, written

BITS = 64
SUSPECT = "id long, print long"
SUSPECT_ARROW = pa.schema([("id", pa.int64()), ("print", pa.int64())])


def prints_of(group: pa.Table) -> np.ndarray:
    return group["print"].to_numpy().view(np.uint64)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``;
    of equal (normalised) texts the row with the largest id stays.  The id
    column must be integral and is returned as ``doc_id``."""
    spark = docs.sparkSession
    slices = owners = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("content"))
    ids = written(rows.select("id", F.xxhash64("content").alias("print"),
                              F.sha2("content", 256).alias("sha"), slice_of("id", slices).alias("slice")))

    def send(group: pa.Table) -> pa.Table:
        values, counts = np.unique(prints_of(group), return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        parcels = ex.parcels(group["slice"][0].as_py(), values, counts, owners, BITS)
        return ex.to_table(list(parcels), ex.SENT_ARROW)

    def receive(group: pa.Table, replies: pa.Table) -> pa.Table:
        values, where = np.unique(prints_of(group), return_inverse=True)
        twice = pa.array((ex.answers(replies) >= 2)[where]) if len(values) else pa.array([], pa.bool_())
        return group.select(["id", "print"]).filter(twice).cast(SUSPECT_ARROW)

    prints = ids.select("slice", "id", "print")
    replies = ex.exchange(prints.groupBy("slice").applyInArrow(by_group(send), ex.SENT), "count", "u1")
    suspects = written(prints.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(by_groups(receive), SUSPECT))

    # byte verification: the text itself is the grouping key.  A null id can't
    # be looked up by equality, hence the null-safe join.
    wanted = suspects.select(F.col("id").alias("suspect_id")).distinct()
    checked = rows.join(wanted, F.col("id").eqNullSafe(F.col("suspect_id")), "left_semi")
    groups = (checked.groupBy("content").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
              .where("group_size > 1").select(F.sha2("content", 256).alias("sha"), "keep_id", "group_size"))
    # before the join: the window must not make it deal the rows by text
    same_row = Window.partitionBy("id", "sha").orderBy("print")
    found = ids.withColumn("copy", F.row_number().over(same_row)).join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((alone | F.col("id").eqNullSafe(F.col("keep_id"))) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped copies, all columns as they were."""
    columns = docs.columns
    decided = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    rows = docs.withColumn("__sha", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    same = F.col(id_col).eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha"))
    return (rows.join(decided, same, "left_semi")
            .withColumn("__id", F.col(id_col)).dropDuplicates(["__id", "__sha"]).select(*columns))
