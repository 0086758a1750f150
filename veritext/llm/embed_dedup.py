"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated by a fixed random orthogonal matrix; its code is the
signs, its correction factor ``a`` the inner product of the rotated vector with
the unit vector ``o`` along the signs.  For a query ``q`` rotated alike,
``<o, q> / a`` estimates the cosine without bias, and since the angles
of q, o and the vector obey the triangle inequality, the cosine lies within
``a s -+ sqrt((1 - a^2)(1 - s^2))``, ``s = <o, q>``: a bound of full confidence.
Pairs whose upper bound reaches the threshold are computed again exactly, in
double precision; no link is lost.

Equal vectors of a label are one node first.  A label's nodes are dealt into
blocks by a hash; a cell compares the full vectors of one block with the codes
(an eighth of a byte per dimension) and factors of another, so a label that holds
a third of all rows becomes many cells of one size, and only pairs that pass the
bound leave a cell.

Defined results: a row with a null label, or a vector that is null, empty, zero
or holds null or non-finite components, links with nothing; vectors of
different length don't link; a null id is smaller than any other; rows with one
id are one node; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

BLOCK = 2048  # nodes of a block
NULL_ID = -2 ** 63
PAIR = "a long, b long"
PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, packed sign codes and correction factors."""
    dim = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(dim).T
    return turned, np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def passing(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> tuple:
    """Pairs (query, code) whose cosine can reach the threshold."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float64) * 2 - 1
    s = np.clip(turned @ signs.T / np.sqrt(dim), -1, 1)
    a = np.minimum(factors, 1)
    upper = a * s + np.sqrt((1 - a * a) * (1 - s * s))
    # s and a are off by 1e-11 at most (dim 10,000); next to 1 the root makes 5e-6 of it
    return np.nonzero(upper >= threshold - 1e-5)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def embed_dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    rows = written(vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                                  F.col(vector_col).cast("array<double>").alias("v"),
                                  F.col(label_col).alias("label")))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))
              & F.exists("v", lambda x: x != 0))
    sound = rows.where(usable).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0 is 0
    nodes = written(sound.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
                    .withColumn("dim", F.size("v")))
    counts = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = nodes.join(counts, ["label", "dim"]).withColumn(
        "block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    queries = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).select(
        "label", "dim", F.col("block").alias("i"), F.col("other").alias("j"), "node", "v")

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(t["dim"].to_pylist()):
                part = t.filter(pa.compute.equal(t["dim"], dim))
                _, codes, factors = encode(matrix(part["v"]))
                part = part.drop_columns(["v"]).append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))
                yield from part.append_column("factor", pa.array(factors)).to_batches()

    label_type = dict(rows.dtypes)["label"]
    coded = dealt.select("label", "dim", "block", "blocks", "node", "v").mapInArrow(
        codes_of, f"label {label_type}, dim int, block int, blocks int, node long, code binary, factor double")
    codes = coded.withColumn("i", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(
        "label", "dim", "i", F.col("block").alias("j"), "node", "code", "factor")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return PAIR_ARROW.empty_table()
        turned, _, _ = encode(matrix(left["v"]))
        code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
        x, y = passing(turned, code, right["factor"].to_numpy(), threshold)
        a, b = left["node"].to_numpy()[x], right["node"].to_numpy()[y]
        if left["i"][0].as_py() == left["j"][0].as_py():  # a block with itself
            a, b = np.maximum(a, b), np.minimum(a, b)
            pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
            a, b = pairs[0], pairs[1]
        return pa.table({"a": pa.array(a), "b": pa.array(b)}, schema=PAIR_ARROW)

    cell = ["label", "dim", "i", "j"]
    pairs = queries.groupBy(cell).cogroup(codes.groupBy(cell)).applyInArrow(compare, PAIR)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keep = [float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))) >= threshold
                    for x, y in zip(map(np.asarray, t["x"].to_pylist()), map(np.asarray, t["y"].to_pylist()), strict=True)]
            yield from t.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).to_batches()

    one = nodes.select(F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("v").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("v").alias("y"))
    links = written(pairs.join(one, "a").join(two, "b").where((F.size("x") == F.size("y")) & (
        F.col("label_a") == F.col("label_b"))).select("a", "b", "x", "y").mapInArrow(exact, PAIR).distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = nodes.select(F.col("node").alias("b"), "copies")
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    parts = components(links).withColumnRenamed("id", "node")
    state = nodes.join(degree, "node", "left").join(parts, "node", "left").select(
        "label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    found = sound.select("id", "label", "v").join(state, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    known = lambda c: F.when(c != NULL_ID, c)
    return found.unionByName(alone).select(
        known(F.col("id")).alias("vec_id"), "n_links", known(F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"))
