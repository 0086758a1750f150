"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes (64 bits) of its distinct shingles.  All sets
are ordered by how many documents hold a shingle (then by hash), rare first.
Two sets that overlap in ``need = ceil(t * n)`` of the larger one share at
least ``l`` members among the first ``n - need + l`` of each: the longer the
prefix, the more shared members it asks for before a pair is verified.  Each
document takes the ``l`` of least estimated cost; a pair must share as many
prefix members as the smaller of its two ``l``.

1. Slices of the documents (hash of the id) send their distinct shingles,
   Golomb-coded (:mod:`exchange`), and receive how many documents hold each.
   A document of which fewer than ``need`` shingles are held twice is alone.
2. Documents with one and the same set (128-bit hash) become one node.
3. Rounds of pivots: in the list of each prefix member, every node meets the
   list's most central node (whose shingles are held most often); each node
   verifies the one it meets most often.  Verified links make components, and
   lists that lie in one component are done.  A group of thousands of near
   copies melts to a few components, with one verification per node and round.
   The rounds end when the pairs left across components are no more than the
   list entries, when a round gains little, or after ``ROUNDS``.
4. The rest, exactly, where links inside a component can't change it.  Lists of
   fewer than ``HOT`` nodes: their pairs across components, counted, filtered by
   ``l`` and size, verified.  Longer lists: nodes that such lists tie together
   form a bundle, dealt into blocks; a cell counts the common members of all
   pairs of two blocks and returns the links that join components there, at
   most one per node, so no pairs are emitted.

Defined results: a null text counts as empty and is linked with nothing; a null
id is smaller than any other; rows with one id are one node, whatever their
texts (each row reports its own set's size); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import tokens as tk
from .common import by_batch, by_group, by_groups, shuffle_partitions, slice_of, written
from .graph import components

BITS = 48  # of the hashes that are counted; sets keep 64
MOST_MATCHES = 8
ROUNDS = 4
HOT = 48  # nodes of a list that is compared in blocks
BLOCK = 512  # nodes of a block
COLUMNS = 4096  # members counted at a time
NULL_ID = -2 ** 63
SKETCH = "id long, n long, key binary, matches int, central double, members array<long>, hashes binary"
SKETCH_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("matches", pa.int32()),
                          ("central", pa.float64()), ("members", pa.list_(pa.int64())), ("hashes", pa.binary())])


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words
    has one shingle, the whole sequence."""
    out = []
    for a, b in tk.chunks(texts):
        w = tk.Words(texts[a:b], lower=True)
        n, words = np.diff(w.first), w.hashes()
        every = tk.windows(words, width)
        for i in range(b - a):
            first, count = int(w.first[i]), int(n[i])
            if count >= width:
                out.append(np.unique(every[first:first + count - width + 1]))
            elif count:
                whole = tk.windows(words[first:first + count], count)
                out.append(tk.mix(whole + np.uint64(count)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def need(n: np.ndarray | int, t: Fraction):
    return -(-n * t.numerator // t.denominator)


def choose_matches(counts: np.ndarray, n: int, t: Fraction) -> int:
    """Matches to ask for, by estimated cost: ``counts`` are the numbers of
    documents of the set's members, ascending.  A prefix costs its list
    entries; sharing l of them leaves about 1/l of the met documents, each
    costing a verification of n members."""
    least = int(need(n, t))
    best, chosen = math.inf, 1
    for matches in range(1, min(MOST_MATCHES, least) + 1):
        met = counts[:n - least + matches]
        met = met[met > 1].astype(np.float64) - 1
        cost = len(met) * 4 + met.sum() / matches * (1 + n / 64)
        if cost < best:
            best, chosen = cost, matches
    return chosen


def sketches(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Per row: id, set size, key of the set; where the set can have a
    partner also matches, prefix members held twice, and the set."""
    slices = owners = shuffle_partitions(docs.sparkSession)
    rows = docs.withColumn("slice", slice_of("id", slices))

    def read(group: pa.Table) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids, sets, all counted hashes (with repeats), number of the set."""
        pairs = sorted(zip(group["id"].to_pylist(), group["content"].cast(pa.binary()).to_pylist(), strict=True))
        sets = shingle_sets([p[1] for p in pairs], width)
        flat = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - BITS)
        return [p[0] for p in pairs], sets, flat, np.array([len(s) for s in sets], np.int64)

    def send(group: pa.Table) -> pa.Table:
        _, _, flat, _ = read(group)
        values, counts = np.unique(flat, return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        return ex.to_table(list(ex.parcels(group["slice"][0].as_py(), values, counts, owners, BITS)),
                           ex.SENT_ARROW)

    def sketch(group: pa.Table, replies: pa.Table) -> pa.Table:
        ids, sets, flat, sizes = read(group)
        held = ex.answers(replies)[np.unique(flat, return_inverse=True)[1]]
        out, at = [], 0
        for i, hashes, n in zip(ids, sets, sizes.tolist(), strict=True):
            counts = held[at:at + n]
            at += n
            key = np.concatenate((np.bitwise_xor.reduce(tk.mix(hashes + np.uint64(1)), keepdims=True),
                                  np.add.reduce(tk.mix(hashes ^ np.uint64(77)), keepdims=True))).tobytes()
            row = (i, n, key, None, None, None, None)
            least = int(need(n, t))
            if n and (counts > 1).sum() >= least:
                order = np.lexsort((hashes, counts))
                ranked = counts[order]
                matches = choose_matches(ranked, n, t)
                first = order[:n - least + matches]
                members = hashes[first[counts[first] > 1]]
                row = (i, n, key, matches, float(counts.mean()), members.view(np.int64).tolist(), hashes.tobytes())
            out.append(row)
        return ex.to_table(out, SKETCH_ARROW)

    replies = ex.exchange(rows.groupBy("slice").applyInArrow(by_group(send), ex.SENT), "count", "u1")
    return rows.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(by_groups(sketch), SKETCH)


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose sets are similar enough: exact."""
    columns = pairs.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(t.denominator * both >= t.numerator * (len(x) + len(y) - both))
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select(*columns, "x", "y")
    return joined.mapInArrow(by_batch(check), pairs.schema).distinct()


def open_lists(lists: DataFrame) -> DataFrame:
    """The lists whose nodes lie in several components."""
    several = lists.groupBy("member").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return written(lists.join(several.where("lo < hi").select("member"), "member"))


def pairs_left(lists: DataFrame) -> tuple[int, float]:
    """Entries of the lists, and pairs across components in them."""
    each = lists.groupBy("member", "component").agg(F.count("*").cast("double").alias("n"))
    each = each.groupBy("member").agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("inside"))
    row = each.agg(F.sum("n").alias("n"), F.sum((F.col("n") ** 2 - F.col("inside")) / 2).alias("pairs")).first()
    return int(row["n"] or 0), float(row["pairs"] or 0)


def pivot_pairs(lists: DataFrame, turn: int, t: Fraction) -> DataFrame:
    """``a, b, ca, cb``: every node with the pivot it meets most often in
    another component.  Later rounds vary the choice among central nodes."""
    vary = 1 - F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1000)) / 10000 if turn else F.lit(1.0)
    pivots = lists.groupBy("member").agg(F.max(F.struct(
        (F.col("central") * vary).alias("rank"), "id", "n", "component")).alias("p")).select(
        "member", F.col("p.id").alias("b"), F.col("p.n").alias("n2"), F.col("p.component").alias("cb"))
    met = (lists.join(pivots, "member").where((F.col("component") != F.col("cb")) & fits(t))
           .groupBy(F.col("id").alias("a"), F.col("component").alias("ca"), "b", "cb")
           .agg(F.count("*").alias("times")))
    best = met.groupBy("a", "ca").agg(F.max(F.struct("times", "b", "cb")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"), "ca", F.col("best.cb").alias("cb"))


def joining_links(ids: list, parts: list, sets: list[np.ndarray], split: int, t: Fraction) -> list[tuple]:
    """Similar pairs between the first ``split`` sets and all others (the same
    set twice where a block meets itself) that join two components."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row, both = np.repeat(np.arange(len(sets)), sizes), np.zeros((split, len(sets) - split), np.float32)
    common = np.flatnonzero(times > 1)  # others are in no intersection
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    for start in range(0, len(common), COLUMNS):
        mine = (column >= start) & (column < start + COLUMNS)
        held = np.zeros((len(sets), min(COLUMNS, len(common) - start)), np.float32)
        held[row[mine], column[mine] - start] = 1
        both += held[:split] @ held[split:].T
    union = sizes[:split, None] + sizes[None, split:] - both
    x, y = np.nonzero(t.denominator * both >= t.numerator * union)
    group: dict[int, int] = {}

    def find(c: int) -> int:
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    out = []
    for i, j in zip(x.tolist(), (y + split).tolist(), strict=True):
        a, b = find(parts[i]), find(parts[j])
        if a != b:
            group[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def bundle_links(lists: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Links that join components among the nodes of long lists."""
    first = lists.groupBy("member").agg(F.min("id").alias("b")).select("member", "b")
    tied = components(lists.join(first, "member").select(F.col("id").alias("a"), "b"))
    nodes = lists.select("id", F.col("component").alias("part")).distinct()
    bundles = nodes.join(tied, "id").select("id", "part", F.col("component").alias("bundle"))
    blocks = bundles.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = written(bundles.join(blocks, "bundle").join(sets, "id").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    left = dealt.select("bundle", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), "block")).alias("j"),
                        "id", "part", "hashes")
    right = dealt.select("bundle", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("i"),
                         F.col("block").alias("j"), "id", "part", "hashes")

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if one.num_rows and two.num_rows:
            both = pa.concat_tables([one.select(["id", "part", "hashes"]), two.select(["id", "part", "hashes"])])
            sets = [np.frombuffer(h, np.uint64) for h in both["hashes"].to_pylist()]
            out = joining_links(both["id"].to_pylist(), both["part"].to_pylist(), sets, one.num_rows, t)
        return ex.to_table(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    cell = ["bundle", "i", "j"]
    return left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(by_groups(compare), "a long, b long")


def fits(t: Fraction, a: str = "n", b: str = "n2"):
    """Sizes whose ratio allows the similarity."""
    least, most = F.least(a, b), F.greatest(a, b)
    return least * t.denominator >= most * t.numerator


def ngram_join(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row."""
    t = Fraction(threshold)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    found = written(sketches(rows, width, t))
    classes = written(found.where("matches is not null").groupBy("key").agg(F.min("id").alias("node")))
    chosen = found.where("matches is not null").join(
        classes.select("key", F.col("node").alias("id")), ["key", "id"], "left_semi")
    nodes = written(chosen.dropDuplicates(["key", "id"]))
    sets = nodes.select("id", "hashes")
    lists = open_lists(nodes.select("id", "n", "matches", "central", F.col("id").alias("component"),
                                    F.explode("members").alias("member")))
    found_links = []
    entries, left = pairs_left(lists)
    for turn in range(ROUNDS):
        if left <= entries:
            break
        new = written(verified(pivot_pairs(lists, turn, t), sets, t))
        found_links.append(new.select("a", "b"))
        moved = components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
            F.col("id").alias("component"), F.col("component").alias("moved"))
        lists = open_lists(lists.join(moved, "component", "left")
                           .withColumn("component", F.coalesce("moved", "component")).drop("moved"))
        before = left
        entries, left = pairs_left(lists)
        if left > 0.8 * before:
            break
    # exactly the rest: pairs across components
    lengths = lists.groupBy("member").agg(F.count("*").alias("length"))
    lists = written(lists.join(lengths, "member"))
    short = lists.where(F.col("length") < HOT)
    other = short.select("member", F.col("id").alias("b"), F.col("n").alias("n2"),
                         F.col("matches").alias("matches2"), F.col("component").alias("component2"))
    rest = (short.join(other, "member")
            .where((F.col("component") < F.col("component2")) & fits(t))
            .groupBy(F.col("id").alias("a"), "b", "matches", "matches2").agg(F.count("*").alias("times"))
            .where(F.col("times") >= F.least("matches", "matches2")).select("a", "b"))
    # a pair that shares a long list is compared there, any other is counted in full above
    long = lists.where(F.col("length") >= HOT)
    links = written(verified(rest, sets, t).unionByName(bundle_links(long, sets, t)).distinct())
    for more in found_links:
        links = links.unionByName(more)
    # a node is the smallest id that holds its set, so nodes and ids are one kind of vertex:
    # rows that share an id but not a set tie their sets to that id
    placed = found.select("id", "n", "key", "matches").join(classes, "key", "left").select(
        "id", "n", "key", F.when(F.col("matches").isNotNull(), F.col("node")).otherwise(F.col("id")).alias("node"))
    several = placed.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    links = links.unionByName(placed.join(several.select("id"), "id").where("id <> node").select(
        F.col("id").alias("a"), F.col("node").alias("b")))
    parts = components(links).select(F.col("id").alias("node"), "component")
    out = placed.join(parts, "node", "left")
    component = F.coalesce("component", "node")
    known = lambda c: F.when(c != NULL_ID, c)
    return out.select(known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      known(component).alias("component_id"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component (the smallest id), all
    columns as they were."""
    found = ngram_join(docs, id_col=id_col, **options)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
