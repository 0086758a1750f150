"""Row ids that depend on the rows alone.

``doc_id`` is the first half of the SHA-256 of the row's content and the row's
number among equal rows: ``<32 hex digits>-<n>``.  Equal rows are
interchangeable, so packing the same rows into other files, or reading them
with another number of tasks, gives the same set of (id, row) pairs, and what
is hashed from the ids (samples, splits, folds) stays the same.

The rows are written once with their position; a lost task re-reads files, it
cannot number the rows anew.  Only contents that occur more than once are
numbered, in two levels: the rank among the equal rows of one written part,
plus the number of equal rows in the parts before it, so rows that a third of
the table shares are numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def with_stable_id(raw: DataFrame, columns: list[str] | None = None, name: str = "doc_id") -> DataFrame:
    """``raw`` with ``name``; ``columns`` are the content (default: all).  Null
    and empty values are different content."""
    # json leaves out null fields and names the others: no two contents agree
    content = F.sha2(F.to_json(F.struct(*(columns or raw.columns))), 256)
    rows = staged(raw.withColumn("_content", F.substring(content, 1, 32))
                     .withColumn("_row", F.monotonically_increasing_id()))
    thin = rows.select("_content", "_row", F.shiftright("_row", 33).alias("_part"))
    parts = thin.groupBy("_content", "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_content")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_content", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                         F.sum("_n").over(whole).alias("_all")).where("_all > 1").drop("_all")
    rank = F.row_number().over(Window.partitionBy("_content", "_part").orderBy("_row")) - 1
    equal = staged(thin.join(parts, ["_content", "_part"]).select("_row", (F.col("_off") + rank).alias("_ordinal"))
                   .where("_ordinal > 0"))
    out = rows.join(equal, "_row", "left")
    ordinal = F.coalesce("_ordinal", F.lit(0)).cast("string")
    return out.withColumn(name, F.concat("_content", F.lit("-"), ordinal)).drop("_content", "_row", "_ordinal")
