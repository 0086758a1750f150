"""Mixing sources to target weights by Pareto order sampling (DataFrame
functions only).

Each source gets a target in words.  A document of a source with target ``T``
and size ``S`` is due ``T / S`` copies: the whole part is certain, the rest
``f`` is its inclusion probability.  Documents are ranked by their random odds
over their inclusion odds, ``u/(1-u) / (f/(1-f))``, and taken in that order as
long as the source's remaining words last.  The last place of a source goes to
the document, of those not reached, whose size comes nearest to the words
still missing, if taking it brings the source nearer.

The cut of a source's order is found from word sums per bucket of the rank (a
coarse pass, a fine pass inside one coarse bucket, then exact inside one fine
bucket), all pre-aggregated, so no task orders a whole source.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; randomness is md5(seed:id), so reruns and partitionings agree;
rows with one id and one size share a rank and are taken or left together; a
null id is the id ''; an empty table gives an empty result; an empty source
has target 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit, written

COARSE, FINE = 256, 256 * 256


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size`` -> with ``target``: sources by code point, null
    last, weigh ``weights`` in turn and share ``share`` of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again.

    With the sources in order of cap / weight, the shared level is that of the
    first source that it doesn't cap: one pass over the (few) sources."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    rows = rows.withColumn("level", (total - before) / onward)
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def boundary(rows: DataFrame, bucket: str, before: Column) -> DataFrame:
    """Per source the bucket in which its words run out, and the words in the
    buckets before it (no row for a source whose words never run out)."""
    sums = rows.groupBy("source", "budget", before.alias("start"), bucket).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(bucket)
    sums = sums.withColumn("upto", F.col("start") + F.sum("words").over(order))
    return (sums.where(F.col("upto") > F.col("budget")).groupBy("source")
            .agg(F.min(F.struct(F.col(bucket).alias("bucket"), (F.col("upto") - F.col("words")).alias("words")))
                 .alias("cut")).select("source", F.col("cut.bucket").alias("cut"), F.col("cut.words").alias("words")))


def with_source(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null with null.  ``small`` has one row per source;
    Spark broadcasts it or splits the hot source by its measured size."""
    small = small.withColumnRenamed("source", "source_2")
    return rows.join(small, F.col("source").eqNullSafe(F.col("source_2")), how).drop("source_2")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` per row; sizes in
    words ``[^\\x20\\x09-\\x0D]+``."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                size.cast("long").alias("size")))
    sources = written(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))

    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = with_source(sizes, sources).withColumn("due", due).withColumn("certain", F.floor("due"))
    rows = rows.withColumn("f", F.col("due") - F.col("certain"))
    rows = rows.withColumn("budget", F.col("target") - F.col("certain") * F.col("source_size"))
    rows = rows.withColumn("u", unit(seed, "id"))
    rows = rows.withColumn("odds", F.when(F.col("f") > 0, F.col("u") / (1 - F.col("u"))
                                          / (F.col("f") / (1 - F.col("f")))))
    rank = F.col("odds") / (1 + F.col("odds"))
    rows = rows.withColumn("coarse", F.floor(rank * COARSE)).withColumn("fine", F.floor(rank * FINE))
    drawn = rows.where("f > 0")

    first = written(boundary(drawn, "coarse", F.lit(0)))  # one row per source at most, read more than once
    inside = with_source(drawn, first).where("coarse = cut").drop("cut").withColumnRenamed("words", "start")
    second = written(boundary(inside, "fine", F.col("start")))
    order = Window.partitionBy("source").orderBy("odds", "id").rangeBetween(Window.unboundedPreceding, 0)
    exact = with_source(inside, second).where("fine = cut")
    exact = exact.withColumn("upto", F.col("words") + F.sum("size").over(order))
    # the first rank that is not taken any more, and the words still missing
    ends = written(exact.where(F.col("upto") > F.col("budget")).groupBy("source").agg(
        F.min(F.struct("odds", "id")).alias("end"), F.min("budget").alias("end_budget"),
        F.min(F.col("upto")).alias("first_over")).join(
        exact.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("full"),
                                    F.min("words").alias("words"))
        .withColumnRenamed("source", "source_2"), F.col("source").eqNullSafe(F.col("source_2"))).select(
        "source", F.col("end.odds").alias("end_odds"), F.col("end.id").alias("end_id"),
        (F.col("end_budget") - F.coalesce("full", "words")).alias("missing")))

    rows = with_source(rows, ends, "left")
    reached = (F.col("f") > 0) & (F.col("end_odds").isNull() | (F.col("odds") < F.col("end_odds")) | (
        (F.col("odds") == F.col("end_odds")) & (F.col("id") < F.col("end_id"))))
    rows = rows.withColumn("reached", F.coalesce(reached, F.lit(False)))
    off = F.abs(F.col("size") - F.col("missing"))
    last = written(rows.where(~F.col("reached") & (F.col("f") > 0) & (off < F.col("missing"))).groupBy("source")
                   .agg(F.min(F.struct(off.alias("off"), "odds", "id")).alias("last"))
                   .select("source", F.col("last.odds").alias("last_odds"), F.col("last.id").alias("last_id")))
    rows = with_source(rows, last, "left")
    is_last = (F.col("odds") == F.col("last_odds")) & F.col("id").eqNullSafe(F.col("last_id")) & ~F.col("reached")
    copies = F.col("certain") + F.when(F.col("reached") | is_last, 1).otherwise(0)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    columns = docs.columns
    copies = mix(docs, id_col, **options).groupBy(F.col("doc_id").alias("__id")).agg(
        F.max("copies").alias("__copies")).where("__copies > 0")
    out = docs.join(copies, F.col(id_col).eqNullSafe(F.col("__id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)
