"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353))
    return tuple(row.first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` hold both directions (large) or a > b (small).  Every node's
    neighbours are tied to its smallest one; a hub's rows meet their minimum
    in a join (split by AQE when skewed), never in one group."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a2"),
                                                                 F.least("a", "m").alias("m"))
    tied = links.join(least, F.col("a") == F.col("a2"))
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("a2").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest reachable id) for every id in ``edges``
    (long columns a, b).  Alternating large and small stars until nothing
    changes; each round is written, so a lost executor costs one round."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = _star(both, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(_star(wide, False))
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    # a star per component: the hub is its smallest id
    hubs = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(hubs)
