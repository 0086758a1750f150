"""Substring dedup over word windows.

Every window of ``width`` consecutive words of a document gets a rolled hash
(:mod:`tokens`).  Documents are dealt into slices by ranges of their id.
A slice sends its distinct window hashes, sorted and Golomb-coded, to the
owners of the hash ranges (:mod:`exchange`) and learns which of them a slice
of smaller ids holds as well; together with the order inside the slice that
says of every window whether its words also start earlier.  Such windows are
merged into maximal intervals, whose words go.

Two windows count as equal when 64 + 32 independent hash bits agree: among n
windows some n**2 / 2**97 pairs do so by chance (0.002 pairs among the 1.6e13
windows of 100 TB).  Texts are shuffled once (the exchange by slice is reused) and only
coded hashes besides; a window that many documents share costs one code per
slice.  A slice is what one task holds: its size is that of the table over
``spark.sql.shuffle.partitions``.

Defined results: a null text has no words; a null id is smaller than any
other; of rows with one id the text that sorts first counts as earlier; a
document shorter than a window keeps all words; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import tokens as tk
from .common import by_group, by_groups, shuffle_partitions

BITS = 64
OUT = ("doc_id long, n_words long, n_removed long, span_starts array<int>, span_ends array<int>, "
       "kept_text string")
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                       ("span_starts", pa.list_(pa.int32())), ("span_ends", pa.list_(pa.int32())),
                       ("kept_text", pa.string())])
NULL_ID = -2 ** 63


def id_slices(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` with ``slice``: ranges of ``id`` of about equal row counts,
    increasing with the id (bounds from Spark's approximate percentiles; at
    most one number per slice reaches the driver)."""
    steps = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx("id", steps or [0.5], 100 * max(slices, 100)).alias("q")).first()["q"] or []
    splits = [-float("inf"), *sorted({float(q) for q in found}), float("inf")]
    if len(splits) < 3:  # no rows, or one id
        return rows.withColumn("slice", F.lit(0))
    bucket = Bucketizer(splits=splits, inputCol="id_number", outputCol="bucket", handleInvalid="keep")
    rows = bucket.transform(rows.withColumn("id_number", F.col("id").cast("double")))
    return rows.withColumn("slice", F.col("bucket").cast("int")).drop("id_number", "bucket")


def ordered(group: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a slice in their order."""
    pairs = sorted(zip(group["id"].to_pylist(), group["content"].cast(pa.binary()).to_pylist(), strict=True))
    return [p[0] for p in pairs], [p[1] for p in pairs]


def hashed(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and check bits of all windows of the texts in order, and the
    number of words of every text."""
    prints, checks, words = [], [], []
    for a, b in tk.chunks(texts):
        w = tk.Words(texts[a:b])
        n = np.diff(w.first)
        words.append(n)
        total = int(w.first[-1])
        if total < width:
            continue
        inside = np.arange(total) + width <= np.repeat(w.first[1:], n)
        inside = inside[:total - width + 1]
        prints.append(tk.windows(w.hashes(), width)[inside])
        checks.append((tk.windows(w.hashes(1), width)[inside] >> np.uint64(32)).astype(np.uint32))
    empty = np.empty(0, np.uint64)
    return (np.concatenate([empty, *prints]), np.concatenate([empty.astype(np.uint32), *checks]),
            np.concatenate([np.empty(0, np.int64), *words]))


def distinct(prints: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the windows, where a new value begins in it, and
    that first window of each value."""
    order = np.argsort(prints, kind="stable")
    p, c = prints[order], checks[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    return order, new, order[new]


def removals(texts: list[bytes], n_words: np.ndarray, again: np.ndarray, width: int) -> list[tuple]:
    """Per text: words, removed words, interval starts and ends, kept text;
    ``again`` says of every window whether it goes."""
    out, at = [], 0
    for a, b in tk.chunks(texts):
        w = tk.Words(texts[a:b])
        n, total = n_words[a:b], int(w.first[-1])
        per_text = np.maximum(n - width + 1, 0)
        starts = np.arange(per_text.sum()) + np.repeat(w.first[:-1] - np.cumsum(per_text) + per_text, per_text)
        go = starts[again[at:at + len(starts)]]
        at += len(starts)
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, go, 1)
        np.add.at(change, go + width, -1)
        gone = np.cumsum(change)[:total] > 0
        # intervals: windows do not cross texts, but neighbours may touch
        first_word = np.zeros(total + 1, bool)
        first_word[w.first] = True
        begin = np.flatnonzero(gone & (first_word[:total] | ~np.concatenate(([False], gone[:-1]))))
        end = np.flatnonzero(gone & (first_word[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        span_of = np.searchsorted(begin, w.first)
        # kept words, each with the byte after it made a space
        buffer = w.buffer.copy()
        keep_start, keep_end = w.start[~gone], w.end[~gone]
        buffer[keep_end] = 32
        mark = np.zeros(len(buffer) + 1, np.int8)
        mark[keep_start] += 1
        mark[keep_end + 1] -= 1
        keep = np.cumsum(mark[:-1]).astype(bool)
        kept = buffer[keep].tobytes()
        size = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[a:b]])))
        upto = np.concatenate(([0], np.cumsum(keep)))[size]
        removed = np.concatenate(([0], np.cumsum(gone)))[w.first]
        for i in range(b - a):
            spans = slice(span_of[i], span_of[i + 1])
            out.append((int(n[i]), int(removed[i + 1] - removed[i]), begin[spans] - w.first[i],
                        end[spans] - w.first[i], kept[upto[i]:max(upto[i], upto[i + 1] - 1)]))
    return out


def substring_dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, span_starts, span_ends, kept_text`` per
    row: words covered by a window that starts earlier as well are removed;
    intervals are in words, ends exclusive; kept words are joined by a space."""
    slices = owners = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    rows = id_slices(rows, slices)

    def send(group: pa.Table) -> pa.Table:
        prints, checks, _ = hashed(ordered(group)[1], width)
        _, _, first = distinct(prints, checks)
        parcels = ex.parcels(group["slice"][0].as_py(), prints[first], checks[first], owners, BITS)
        return ex.to_table(list(parcels), ex.SENT_ARROW)

    def receive(group: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = ordered(group)
        prints, checks, n_words = hashed(texts, width)
        order, new, first = distinct(prints, checks)
        del prints, checks
        again = np.ones(len(order), bool)
        again[first] = ex.answers(replies).astype(bool)
        found = [(None if i == NULL_ID else i, *r)
                 for i, r in zip(ids, removals(texts, n_words, again, width), strict=True)]
        return ex.to_table(found, OUT_ARROW)

    replies = ex.exchange(rows.groupBy("slice").applyInArrow(by_group(send), ex.SENT), "first", "<u4")
    return rows.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(by_groups(receive), OUT)
