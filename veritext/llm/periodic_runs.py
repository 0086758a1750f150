"""Periodic run detection: stretches of words that repeat with a fixed period.

A run is a stretch with smallest period ``q`` and length at least
``max(least, exponent * q)`` that no neighbouring word extends.  Each word of
a run occurs at least ``exponent`` times in it, so a word that occurs less
often in its segment is in no run there and splits the segment; the parts are
counted again, with fewer words, until every word of a segment is frequent
enough (or the segment is too short).  No run is cut: it lies inside one
segment at every step.

A surviving segment of ``m`` words is scanned lag by lag.  A run of period
``q`` covers three whole blocks ``[kq, kq + 3q)``, so only the words at ``kq``
(and a few offsets into the blocks) are compared for each lag: ``m log m``
comparisons over all lags, not ``m * m``.  What is left is extended word by
word, which decides.  Multiples of a run's period are known beforehand and
skipped inside it, so the smallest period is the one that is found.

Each document is a row of its own: nothing is shuffled, and a task holds a few
megabytes of text besides the longest document.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; a null or
empty text has no words and no runs; rows are judged one by one, so repeated
rows and ids give repeated results and a null id is kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 22  # bytes of text whose words are counted together

Run = tuple[int, int, int]  # start, length, period


def segments(ids: np.ndarray, bounds: np.ndarray, exponent: int, least: int) -> Iterator[tuple[int, int]]:
    """Stable segments (start, end) of the documents ``bounds[i]:bounds[i+1]``
    of ``ids``: every word of a segment occurs ``exponent`` times in it."""
    start, end = bounds[:-1], bounds[1:]
    width = int(ids.max(initial=0)) + 1
    while True:
        long = end - start >= least
        start, end = start[long], end[long]
        if not len(start):
            return
        size = end - start
        no = np.repeat(np.arange(len(start)), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        _, word, count = np.unique(no * width + ids[pos], return_inverse=True, return_counts=True)
        rare = count[word] < exponent
        split = np.zeros(len(start), bool)
        split[no[rare]] = True
        yield from zip(start[~split].tolist(), end[~split].tolist(), strict=True)
        # what is left of the split segments: stretches of frequent words
        kept = ~rare & split[no]
        pos, no = pos[kept], no[kept]
        if not len(pos):
            return
        new = np.flatnonzero((np.diff(pos) != 1) | (np.diff(no) != 0)) + 1
        start = pos[np.concatenate(([0], new))]
        end = pos[np.concatenate((new - 1, [len(pos) - 1]))] + 1


def extent(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """Bounds of the stretch of ``i`` with ``w[i] == w[i + q]`` around ``at``."""
    high, step = at, 256
    while high < len(w) - q:
        stop = min(high + step, len(w) - q)
        other = np.flatnonzero(w[high:stop] != w[high + q:stop + q])
        if len(other):
            high += int(other[0])
            break
        high, step = stop, step * 2
    low, step = at, 256
    while low > 0:
        stop = max(low - step, 0)
        other = np.flatnonzero(w[stop:low] != w[stop + q:low + q])
        if len(other):
            low = stop + int(other[-1]) + 1
            break
        low, step = stop, step * 2
    return low, high


def lag_scan(w: np.ndarray, exponent: int, least: int) -> list[Run]:
    """Runs of one segment (start inside the segment)."""
    found: dict[tuple[int, int], int] = {}  # bounds -> period
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # lag -> runs whose period divides it
    for q in range(1, len(w) // exponent + 1):
        blocks = len(w) // q
        heads = w[:blocks * q:q]
        same = heads[1:] == heads[:-1]
        at = np.flatnonzero(same[1:] & same[:-1]) * q
        if len(at) and q in known:
            inside = np.array(sorted(known[q]))
            reach = np.concatenate(([-1], np.maximum.accumulate(inside[:, 1])))
            at = at[reach[np.searchsorted(inside[:, 0], at, "right")] < at + 3 * q]
        known.pop(q, None)
        for r in sorted({q // 2, q // 4, q - 1, q // 3, q // 8, 2 * q // 3} - {0}):
            if not len(at):
                break
            at = at[(w[at + r] == w[at + q + r]) & (w[at + q + r] == w[at + 2 * q + r])]
        done = -1
        for a in at.tolist():
            if a <= done:
                continue
            low, high = extent(w, a, q)
            done, length = high, high + q - low
            # a stretch with a smaller period has the bounds of that period's run
            if length >= max(least, exponent * q) and (low, low + length) not in found:
                found[low, low + length] = q
                for multiple in range(2 * q, length // 3 + 1, q):
                    known[multiple].append((low, low + length))
    return [(low, end - low, q) for (low, end), q in found.items()]


def runs_of(texts: list[bytes], exponent: int, least: int) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words and runs (by start, then period) of each text."""
    words = [t.split() for t in texts]  # bytes.split() cuts at exactly [\x20\x09-\x0D]+
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy().astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(ws) for ws in words]))).astype(np.int64)
    runs: list[list[Run]] = [[] for _ in texts]
    for a, b in segments(ids, bounds, exponent, least):
        doc = int(np.searchsorted(bounds, a, "right")) - 1
        offset = a - int(bounds[doc])
        runs[doc] += [(offset + s, n, q) for s, n, q in lag_scan(ids[a:b], exponent, least)]
    for ws, rs in zip(words, runs, strict=True):
        yield ws, sorted(rs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, space-joined."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4,
                  least: int = 6) -> DataFrame:
    """``id, n_words, runs, collapsed_text`` per row: the runs by start, then
    period, and the text without their repetitions."""
    if exponent < 4:
        raise ValueError("the block test of the lag scan needs runs of four periods or more")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                stop, size = start, 0
                while stop < batch.num_rows and (stop == start or size < CHUNK):
                    size += len(batch["text"][stop].as_buffer())
                    stop += 1
                part = batch.slice(start, stop - start)
                texts = part["text"].cast(pa.binary()).to_pylist()
                n, runs, kept = [], [], []
                for ws, rs in runs_of(texts, exponent, least):
                    n.append(len(ws))
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in rs])
                    kept.append(collapsed(ws, rs).decode())
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(kept, pa.string())],
                    names=["id", "n_words", "runs", "collapsed_text"])
                start = stop

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {id_type}, n_words long, "
                                 "runs array<struct<start: long, length: long, period: long>>, collapsed_text string")
