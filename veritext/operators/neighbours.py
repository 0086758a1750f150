"""Exact k nearest neighbours inside groups, pruned by pivot distances.

A few rows of each group are pivots.  Every reference row belongs to the cell
of its nearest pivot, and each cell is cut into rings by the distance to it;
rings of many rows (equal rows cannot be told apart by a distance) are dealt
into blocks by a hash.  A query first searches the block it would lie in, which
bounds the distance of its k-th neighbour.  By the triangle inequality a ring
can hold a nearer row only if

    |d(query, pivot) - d(row, pivot)| and (d(query, pivot) - d(query, nearest pivot)) / 2

do not exceed that bound for some of its rows; only those blocks are visited.
A reference row is shuffled once per round, a query once per visited block, and
no pair is emitted: a visit returns at most k rows.  What the driver and every
task hold is the pivots and one line per ring: groups x ``PIVOTS`` x ``RINGS``
at most, however many rows there are.  How many blocks a query visits depends
on the data: a constant number where the rows cluster, all where distances are
alike (rows of high dimension without structure), which is the cost of a plain
comparison in blocks, by postings where rows are sparse.  Queries are dealt into
slices, so that a task holds a block and ``QUERY_BLOCKS`` times its bytes of them.

Rows are arrays ``val`` of one length, or sparse: ``idx`` (ascending) beside
``val``.  Neighbours are ordered by (distance, id); with ``digits`` (6 for
sparse rows) distances are rounded first, so that rows whose distances differ
by rounding errors are ordered by id.  Rows without a group have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .sampling import hash_sample
from .solvers import pieces, times

PIVOTS = 32  # of a group
RINGS = 64  # of a cell
BLOCK_BYTES = 16 * 1024 * 1024  # of the reference rows of a block
WORK_BYTES = 64 * 1024 * 1024  # temporaries of a visit
QUERY_BLOCKS = 4  # blocks that the queries of one task may fill
COMMON = 8  # a column is kept dense where more than one of so many rows hold it
SLACK = 1e-6  # covers the rounding of distances that bounds are taken from


@dataclass
class Rows:
    """Rows of a block: dense matrix, or values, indices and row bounds."""

    val: np.ndarray
    idx: np.ndarray | None
    bounds: np.ndarray

    @staticmethod
    def of(idx, val) -> Rows:
        sizes = np.array([len(v) for v in val], np.int64)
        flat = np.concatenate([np.empty(0), *val]).astype(np.float64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        if idx is None:
            return Rows(flat.reshape(len(sizes), -1) if len(sizes) else flat.reshape(0, 0), None, bounds)
        return Rows(flat, np.concatenate([np.empty(0, np.int64), *idx]).astype(np.int64), bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def dense(self, i: int, size: int) -> np.ndarray:
        if self.idx is None:
            return self.val[i]
        out = np.zeros(size)
        mine = slice(self.bounds[i], self.bounds[i + 1])
        out[self.idx[mine]] = self.val[mine]
        return out

    def width(self) -> int:
        return int(self.idx.max(initial=-1)) + 1 if self.idx is not None else self.val.shape[1] if len(self) else 0

    def squares(self) -> np.ndarray:
        if self.idx is None:
            return (self.val * self.val).sum(axis=1)
        row = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        return np.bincount(row, self.val * self.val, len(self))

    def products(self, x: np.ndarray) -> np.ndarray:
        """Inner products (row, point) with the rows of the dense matrix ``x``."""
        if self.idx is None:
            return self.val @ x.T
        return times(pieces(self.bounds, self.idx, self.val), np.ascontiguousarray(x.T), len(self))


def distances(rows: Rows, points: np.ndarray) -> np.ndarray:
    """Distances (row, point) to the rows of a dense matrix, up to rounding."""
    square = rows.squares()[:, None] + (points * points).sum(axis=1)[None, :] - 2 * rows.products(points)
    return np.sqrt(np.maximum(square, 0))


class Postings:
    """Sparse rows by column.  A product of two rows needs the columns that
    both hold: those of many rows are kept as a dense matrix, the others as
    lists of (row, value), of which a query reads its own columns' only."""

    def __init__(self, r: Rows, width: int):
        n, row = len(r), np.repeat(np.arange(len(r)), np.diff(r.bounds))
        common = np.bincount(r.idx, minlength=width) * COMMON > n
        place = np.cumsum(common) - 1
        self.common, self.rare, often = np.flatnonzero(common), ~common, common[r.idx]
        k = len(self.common)
        self.dense = np.bincount(row[often] * k + place[r.idx[often]], r.val[often], n * k).reshape(n, k)
        idx = r.idx[~often]
        order = np.argsort(idx, kind="stable")
        self.row, self.val = row[~often][order], r.val[~often][order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(idx, minlength=width))))
        self.squares = r.squares()

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances (point, row) to the rows of a dense matrix, up to rounding."""
        dot = x[:, self.common] @ self.dense.T
        for i, point in enumerate(x):
            cols = np.flatnonzero((point != 0) & self.rare)
            sizes = self.starts[cols + 1] - self.starts[cols]
            at = np.repeat(self.starts[cols] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            dot[i] += np.bincount(self.row[at], self.val[at] * np.repeat(point[cols], sizes), dot.shape[1])
        return np.sqrt(np.maximum(self.squares[None, :] + (x * x).sum(axis=1)[:, None] - 2 * dot, 0))


def nearest(qid: np.ndarray, q: Rows, rid: np.ndarray, r: Rows, k: int, digits: int | None) -> pd.DataFrame:
    """The k nearest rows of every query, itself excluded."""
    width = max(q.width(), r.width())
    found: list[tuple] = []
    step = max(1, WORK_BYTES // (8 * max(len(rid), width, 1)))
    postings = None if r.idx is None else Postings(r, width)
    for lo in range(0, len(qid), step):
        ids = qid[lo:lo + step]
        x = np.stack([q.dense(i, width) for i in range(lo, lo + len(ids))])
        near = distances(r, x).T if postings is None else postings.distances(x)
        near[ids[:, None] == rid[None, :]] = np.inf
        last = np.partition(near, min(k, len(rid)) - 1, axis=1)[:, min(k, len(rid)) - 1]
        for i, far in enumerate(near):
            # everything that rounding may have put behind the k-th
            cand = np.flatnonzero((far <= last[i] + 2e-6 * (1 + last[i])) & np.isfinite(far))
            if digits is None:
                diff = r.val[cand] - x[i]
                dist = np.sqrt((diff * diff).sum(axis=1))
            else:
                dist = np.round(far[cand], digits)
            order = np.lexsort((rid[cand], dist))[:k]
            found.append((np.full(len(order), ids[i]), rid[cand][order], dist[order]))
    parts = list(zip(*found, strict=True)) or [[], [], []]
    return pd.DataFrame({"qid": np.concatenate([np.empty(0, np.int64), *parts[0]]).astype(np.int64),
                         "nid": np.concatenate([np.empty(0, np.int64), *parts[1]]).astype(np.int64),
                         "dist": np.concatenate([np.empty(0), *parts[2]]).astype(np.float64)})


def rows_of(t: pa.Table | pa.RecordBatch, sparse: list[str]) -> Rows:
    """Rows of Arrow lists, without Python objects for their values."""
    lists = {c: t[c].combine_chunks() if isinstance(t, pa.Table) else t[c] for c in ("val", *sparse)}
    if any(x.null_count for x in lists.values()):
        raise TypeError("a row without values has no neighbours")
    flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
    sizes = pc.list_value_length(lists["val"]).to_numpy(zero_copy_only=False).astype(np.int64)
    val, bounds = flat["val"].astype(np.float64), np.concatenate(([0], np.cumsum(sizes)))
    if sparse:
        return Rows(val, flat["idx"].astype(np.int64), bounds)
    return Rows(val.reshape(len(sizes), -1) if len(sizes) else val.reshape(0, 0), None, bounds)


def pivot_points(reference: DataFrame, pivots: int, sparse: list[str]) -> dict:
    """Per group the dense matrix of its pivots: the rows of smallest hash."""
    chosen = hash_sample(reference, pivots, "rid", strata=["grp"]).orderBy("grp", "rid").collect()
    width = max([max(r["idx"], default=-1) + 1 if sparse else len(r["val"]) for r in chosen], default=0)
    groups: dict = {}
    for row in chosen:
        groups.setdefault(row["grp"], []).append(row)
    out = {}
    for g, rows in groups.items():
        part = Rows.of([r["idx"] for r in rows] if sparse else None, [r["val"] for r in rows])
        out[g] = np.stack([part.dense(i, width) for i in range(len(part))])
    return out


def measured(df: DataFrame, id_col: str, points: dict, sparse: list[str]) -> DataFrame:
    """``df`` with its distances to the group's pivots (``far``), the nearest
    one (``cell``) and the distance to it (``dist``); rows of groups without
    pivots are dropped."""
    df = df.select(F.col(id_col).cast("long").alias(id_col), "grp", F.col("val").cast("array<double>").alias("val"),
                   *[F.col(c).cast("array<int>").alias(c) for c in sparse])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch["grp"].to_pylist(), object)
            out: list = [[]] * len(groups)
            for g in set(groups.tolist()) & set(points):
                mine = np.flatnonzero(groups == g)
                rows, p = rows_of(batch.take(pa.array(mine)), sparse), points[g]
                if rows.width() > p.shape[1]:
                    p = np.pad(p, ((0, 0), (0, rows.width() - p.shape[1])))
                for i, d in zip(mine.tolist(), distances(rows, p).tolist(), strict=True):
                    out[i] = d
            yield batch.append_column("far", pa.array(out, pa.list_(pa.float64())))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    least = F.array_min("far")
    out = df.mapInArrow(far, f"{columns}, far array<double>").where("size(far) > 0")
    return out.withColumn("dist", least).withColumn("cell", F.array_position("far", least) - 1)


class Search:
    """The index of the reference rows, and the two rounds of a search in it."""

    def __init__(self, reference: DataFrame, k: int, block_bytes: int, pivots: int, digits: int | None):
        self.k, self.sparse = k, ["idx"] if "idx" in reference.columns else []
        self.digits = 6 if self.sparse and digits is None else digits  # products of sparse rows, not differences
        self.kind = dict(reference.dtypes)["grp"]
        reference = reference.where("grp is not null")
        self.points = pivot_points(reference, pivots, self.sparse)
        rows = staged(measured(reference, "rid", self.points, self.sparse).drop("far"))

        # rings: equal shares of a cell's bytes, by approximate percentiles of the distance
        shares = [i / RINGS for i in range(1, RINGS)]
        self.block_bytes = block_bytes
        size = self.size = F.size("val") * 8 + (F.size("idx") * 4 if self.sparse else 0) + 32
        cells = rows.groupBy("grp", "cell").agg(F.sum(size).alias("bytes"), F.percentile_approx("dist", shares).alias("q"))
        rings = F.least(F.lit(RINGS), F.ceil(F.col("bytes") / block_bytes)).cast("int")
        edges = F.when(rings > 1, F.transform(F.sequence(F.lit(1), rings - 1), lambda i: F.get(
            "q", F.floor(i * F.lit(RINGS) / rings).cast("int") - 1)))
        self.edges = staged(cells.select("grp", "cell", F.coalesce(
            F.array_distinct(edges), F.array().cast("array<double>")).alias("edges")))
        found = self.in_ring(rows).groupBy("grp", "cell", "ring").agg(
            F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"),
            F.ceil(F.sum(size) / block_bytes).cast("int").alias("blocks"))
        self.lines = staged(found)  # groups x PIVOTS x RINGS at most
        self.blocks = self.in_block(rows, "rid").select(*CELL, "rid", "val", *self.sparse)

    def in_ring(self, df: DataFrame) -> DataFrame:
        out = df.join(self.edges, ["grp", "cell"])
        return out.withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("dist")))).drop("edges")

    def in_block(self, df: DataFrame, id_col: str) -> DataFrame:
        out = self.in_ring(df).join(self.lines.select("grp", "cell", "ring", "blocks"), ["grp", "cell", "ring"], "left")
        return out.withColumn("block", F.pmod(F.xxhash64(id_col), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")

    def visit(self, visits: DataFrame, slices: int = 1) -> DataFrame:
        """(qid, nid, dist): at most k rows per visited block and query.  The
        queries of a block are dealt to ``slices`` tasks, each with the block."""
        k, digits, sparse = self.k, self.digits, self.sparse

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return FOUND.empty_table()
            frame = nearest(left["qid"].to_numpy(), rows_of(left, sparse), right["rid"].to_numpy(),
                            rows_of(right, sparse), k, digits)
            return pa.Table.from_pandas(frame, FOUND, preserve_index=False)

        blocks, key = self.blocks, CELL
        if slices > 1:
            key = [*CELL, "slice"]
            visits = visits.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int"))
            blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return visits.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(search, "qid long, nid long, dist double")

    def rounds(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the queries find in their own blocks, and their visits to others."""
        k, sparse = self.k, self.sparse
        asked = staged(self.in_block(measured(queries.where("grp is not null"), "qid", self.points, sparse), "qid"))
        # where all queries visit all blocks, a block meets a group's queries
        most = asked.groupBy("grp").agg(F.sum(self.size).alias("bytes")).agg(F.max("bytes")).first()[0] or 0
        self.slices = max(1, -(-most // (QUERY_BLOCKS * self.block_bytes)))
        own = staged(self.visit(asked.select(*CELL, "qid", "val", *sparse)))
        bound = own.groupBy("qid").agg(F.count("*").alias("seen"), F.max("dist").alias("reach"))
        index: dict = {}  # per group: cell, ring, n, low, high, blocks
        for line in self.lines.select("grp", "cell", "ring", "n", "low", "high", "blocks").collect():
            index.setdefault(line["grp"], []).append(tuple(line)[1:])
        index = {g: np.array(x, np.float64) for g, x in index.items()}

        def to_visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The blocks, besides its own, that can hold a neighbour of a query."""
            for batch in batches:
                out = []
                for g, far, c, r, b, seen, reach in zip(*(batch[x].to_pylist() for x in (
                        "grp", "far", "cell", "ring", "block", "seen", "reach")), strict=True):
                    x, far = index[g], np.array(far)
                    to = far[x[:, 0].astype(int)]
                    if (seen or 0) < k:  # from the rings' sizes: k rows (and itself) lie within
                        order = np.argsort(to + x[:, 4])
                        enough = np.flatnonzero(np.cumsum(x[order, 2]) > k)
                        reach = (to + x[:, 4])[order][enough[0]] if len(enough) else np.inf
                    least = np.maximum(np.maximum(to - x[:, 4], x[:, 3] - to), (to - far.min()) / 2)
                    near = x[least <= reach + SLACK][:, [0, 1, 5]].astype(int).tolist()
                    out.append([{"cell": i, "ring": j, "block": m} for i, j, n in near for m in range(n) if (i, j, m) != (c, r, b)])
                yield batch.select(["qid", "grp", "val", *sparse]).append_column("v", pa.array(out, VISITS))

        columns = f"qid long, grp {self.kind}, val array<double>" + (", idx array<int>" if sparse else "")
        more = asked.join(bound, "qid", "left").mapInArrow(
            to_visit, f"{columns}, v array<struct<cell: long, ring: int, block: int>>")
        more = more.select("grp", "qid", "val", *sparse, F.explode("v").alias("v"))
        return own, more.select("grp", "v.cell", "v.ring", "v.block", "qid", "val", *sparse)


CELL = ["grp", "cell", "ring", "block"]
FOUND = pa.schema([("qid", pa.int64()), ("nid", pa.int64()), ("dist", pa.float64())])
VISITS = pa.list_(pa.struct([("cell", pa.int64()), ("ring", pa.int32()), ("block", pa.int32())]))


def knn_within(queries: DataFrame, reference: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES,
               pivots: int = PIVOTS, digits: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean) of each query row among the
    ``reference`` rows of its group, excluding the row with its own id.
    queries: (qid, grp, val[, idx]); reference: (rid, grp, val[, idx]), ids
    unique.  Returns (qid, slot 0..k-1, nid, dist); fewer slots where a group
    has fewer other rows."""
    search = Search(reference, k, block_bytes, pivots, digits)
    own, more = search.rounds(queries)
    order = Window.partitionBy("qid").orderBy("dist", "nid")  # at most k rows of a visit
    ranked = own.unionByName(search.visit(more, search.slices)).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    return ranked.select("qid", (F.col("_rn") - 1).cast("int").alias("slot"), "nid", "dist")
