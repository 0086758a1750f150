"""Compact fingerprint exchange.

Each slice of the rows (a group of a Spark shuffle) sends its distinct
fingerprints, sorted and Golomb-coded, to the owners of the hash ranges; an
owner sees every slice's values of its range and answers each slice with one
byte per fingerprint, in the slice's own order.  Only coded values and answers
are shuffled, never rows.  A fingerprint counts once per slice on the wire, so
a value that a third of all rows share is no hot key.

Answers
  ``count``  how often the value occurs in all slices together, as a class:
             exact below 200, then four classes per doubling
  ``first``  1 where a slice with a smaller number holds the value as well
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import golomb
from .common import by_group

SENT = "slice int, owner int, prints binary, extra binary"
ANSWERED = "slice int, owner int, answer binary"


def owner_of(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Owner of each fingerprint: equal ranges of the hash space (monotone)."""
    top = values >> np.uint64(max(0, bits - 32))
    return ((top * np.uint64(owners)) >> np.uint64(min(32, bits))).astype(np.int64)


def count_class(n: np.ndarray) -> np.ndarray:
    big = 200 + 4 * np.log2(np.maximum(n, 200) / 200)
    return np.where(n < 200, n, np.minimum(255, big)).astype(np.uint8)


def parcels(slice_no: int, values: np.ndarray, extra: np.ndarray, owners: int, bits: int) -> Iterator[tuple]:
    """(slice, owner, prints, extra) of one slice's sorted distinct
    ``values``; ``extra`` is a fixed-width array beside them."""
    at = np.searchsorted(owner_of(values, owners, bits), np.arange(owners + 1))
    for owner in range(owners):
        a, b = at[owner], at[owner + 1]
        if a < b:
            part = values[a:b]
            yield slice_no, owner, golomb.encode(part, int(part[0])), zlib.compress(extra[a:b].tobytes(), 1)


def to_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SENT_ARROW = pa.schema([("slice", pa.int32()), ("owner", pa.int32()), ("prints", pa.binary()), ("extra", pa.binary())])
ANSWERED_ARROW = pa.schema([("slice", pa.int32()), ("owner", pa.int32()), ("answer", pa.binary())])


def answer(group: pa.Table, kind: str, width: str) -> pa.Table:
    """One owner: decode all parcels of its range, answer each of them."""
    slices = group["slice"].to_numpy()
    owner = group["owner"][0].as_py()
    prints = [golomb.decode(b) for b in group["prints"].to_pylist()]
    extras = [np.frombuffer(zlib.decompress(b), width) for b in group["extra"].to_pylist()]
    sizes = np.array([len(p) for p in prints])
    values, extra = np.concatenate(prints), np.concatenate(extras)
    del prints, extras
    if kind == "count":  # extra: occurrences inside the slice
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint64(1)))
        total = np.add.reduceat(extra[order].astype(np.int64), new)
        out = np.empty(len(values), np.uint8)
        out[order] = np.repeat(count_class(total), np.diff(new, append=len(values)))
    else:  # extra: more hash bits, which must agree too
        which = np.repeat(slices, sizes)
        order = np.lexsort((which, extra, values))
        v, e, w = values[order], extra[order], which[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (e[1:] != e[:-1])
        first = w[new][np.cumsum(new) - 1]
        out = np.empty(len(values), np.uint8)
        out[order] = w > first
    ends = np.cumsum(sizes)
    rows = [(int(s), owner, zlib.compress(out[e - n:e].tobytes(), 1))
            for s, n, e in zip(slices, sizes, ends, strict=True)]
    return to_table(rows, ANSWERED_ARROW)


def exchange(sent: DataFrame, kind: str, width: str) -> DataFrame:
    """Answers (slice, owner, answer) to the parcels ``sent``; ``width`` is
    the numpy type of the parcels' extra array."""

    def owner(group: pa.Table) -> pa.Table:
        return answer(group, kind, width)

    return sent.groupBy("owner").applyInArrow(by_group(owner), ANSWERED)


def answers(group: pa.Table) -> np.ndarray:
    """All answers of one slice in the order of its sorted values."""
    if group.num_rows == 0:
        return np.empty(0, np.uint8)
    order = np.argsort(group["owner"].to_numpy())
    blobs = group["answer"].to_pylist()
    return np.frombuffer(b"".join(zlib.decompress(blobs[i]) for i in order), np.uint8)

