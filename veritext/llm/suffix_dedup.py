"""Suffix-array dedup of byte strings across documents.

A string of ``width`` bytes goes if it also starts in a document with a
smaller id.  All occurrences of one string must meet; the route is the
smallest hash among its ``gram``-byte substrings, which depends on its bytes
alone.  Neighbouring windows (starts of strings) with one route form a
fragment: the bytes of its windows.

1. A slice of the documents (hash of the id) sends the distinct routes of its
   windows, Golomb-coded (:mod:`exchange`), and learns which of them two or
   more documents hold.  The others can't repeat and are done.
2. It sends the distinct fragments of the repeated routes to the routes'
   owners, each once with its smallest id, so a passage that many documents
   share costs one fragment per slice.
3. An owner builds the suffix array of its fragments, some MB at a time, in two
   stages (:func:`suffix_order`): suffixes smaller than their successors are
   sorted directly, the others are induced by scanning the buckets in order.
   Adjacent common prefixes of at least ``width`` bytes (:func:`common_prefixes`)
   group equal strings; the smallest id of each group goes back to the
   fragments' windows.
4. The slice removes the bytes of every window whose string has a smaller id
   than the window's document.

Equality rests on compared bytes; hashes only route.  Texts are shuffled once
(the exchange by slice is reused).

Defined results: a null text is empty; a null id is smaller than any other;
rows with one id do not remove each other's bytes; a document shorter than
``width`` stays whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import tokens as tk
from .common import shuffle_partitions, slice_of, written

BITS = 48
LONGEST = 512  # windows of a fragment
BATCH = 1 << 20  # bytes of fragments in one suffix array
NULL_ID = -2 ** 63
OUT = "doc_id long, n_bytes long, span_starts array<int>, span_ends array<int>, kept binary"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("span_starts", pa.list_(pa.int32())),
                       ("span_ends", pa.list_(pa.int32())), ("kept", pa.binary())])
FRAGMENTS = "slice int, owner int, bytes binary, sizes binary, ids binary, routes binary"
FRAGMENTS_ARROW = pa.schema([("slice", pa.int32()), ("owner", pa.int32()), *(
    (c, pa.binary()) for c in ("bytes", "sizes", "ids", "routes"))])


# --- windows and their routes ------------------------------------------------

def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i."""
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


@dataclass
class Fragments:
    """Number of the text, first byte in it, number of windows, route and
    content hash of each fragment."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    route: np.ndarray
    content: np.ndarray

    def __getitem__(self, which) -> Fragments:
        return Fragments(*(getattr(self, f.name)[which] for f in fields(self)))


def fragments(texts: list[bytes], width: int, gram: int) -> Fragments:
    """All fragments of the texts, in order."""
    none = np.empty(0, np.int64)
    found = [Fragments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))]
    for a, b in tk.chunks(texts):
        part = chunk_fragments(texts[a:b], width, gram)
        part.text += a
        found.append(part)
    return Fragments(*(np.concatenate([getattr(p, f.name) for p in found]) for f in fields(Fragments)))


def chunk_fragments(texts: list[bytes], width: int, gram: int) -> Fragments:
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    text_start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    n = len(buffer) - width + 1
    none = np.empty(0, np.int64)
    if n <= 0 or size.max(initial=0) < width:
        return Fragments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    least = sliding_min(tk.grams(buffer, gram), width - gram + 1)
    valid = np.zeros(n + 1, np.int8)  # windows that lie inside one text
    long = size >= width
    valid[text_start[long]] += 1
    np.add.at(valid, text_start[long] + size[long] - width + 1, -1)
    valid = np.cumsum(valid[:n]).astype(bool)
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(begin)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begin[1:]
    windows = np.flatnonzero(ends) + 1 - start
    if len(windows) and windows.max() > LONGEST:
        parts = -(-windows // LONGEST)
        piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(windows, parts) - piece * LONGEST
        start, windows = np.repeat(start, parts) + piece * LONGEST, np.minimum(left, LONGEST)
    text = np.searchsorted(text_start, start, "right") - 1
    content = tk.hash_bytes(buffer, start, start + windows + width - 1)
    # minima crowd at the low end: mixed again, all owners get as many
    route = tk.mix(least[start]) >> np.uint64(64 - BITS)
    return Fragments(text, start - text_start[text], windows, route, content)


# --- suffix array --------------------------------------------------------------

def _words_at(symbols: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The eight symbols from ``at + offset`` as big-endian numbers."""
    view = np.ndarray((len(symbols) - 7,), "<u8", symbols, strides=(1,))
    return view[np.minimum(at + offset, len(view) - 1)].byteswap()


def direct_sort(symbols: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the first ``depth`` (or more) symbols there:
    sort by eight, then only the ties by more, kept apart by their rank."""
    order = np.argsort(_words_at(symbols, at, 0), kind="stable")
    at = at[order]
    words = _words_at(symbols, at, 0)
    new = np.ones(len(at), bool)
    new[1:] = words[1:] != words[:-1]
    done = 8
    while done < depth:
        group = np.cumsum(new) - 1
        alone = new & np.concatenate((new[1:], [True]))
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        mine = at[tied]
        words = _words_at(symbols, mine, done)
        order = np.lexsort((words, group[tied]))
        mine, words, ranks = mine[order], words[order], group[tied][order]
        at[tied] = mine
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (ranks[1:] != ranks[:-1])
        new[tied] = fresh
        done += 8
    return at


def next_true(mask: np.ndarray) -> np.ndarray:
    """Position of the first true entry at or after each one (the last
    entry counts as true)."""
    at = np.where(mask, np.arange(len(mask)), len(mask) - 1)
    return np.minimum.accumulate(at[::-1])[::-1]


def suffix_order(symbols: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``wanted`` (a mask) in the order of their suffixes, compared
    over ``depth`` symbols at least.  Symbol 0 ends each fragment.

    Stage one: suffixes smaller than their successor (type S) are sorted
    directly.  Stage two: a suffix greater than its successor (type L) stands
    in the bucket of its first symbol in the order of its successors, so a scan
    of the buckets from the smallest symbol on places it when its successor is
    met; inside a bucket, type L comes before type S."""
    n = len(symbols)
    step = np.sign(symbols[1:].astype(np.int16) - symbols[:-1]).astype(np.int8)
    step = np.concatenate((step, [-1]))
    # equal neighbours take the type of the next different ones
    smaller = step[next_true(step != 0)] > 0
    # a type L suffix needs its successors up to the first of type S or the end
    stop = next_true(smaller | (symbols == 0))[wanted]
    edge = wanted.astype(np.int32)
    edge -= np.bincount(stop + 1, minlength=n + 1)[:n].astype(np.int32)
    needed = np.cumsum(edge) > 0

    direct = direct_sort(symbols, np.flatnonzero(needed & smaller & (symbols > 0)), depth)
    first = symbols[direct]
    s_bounds = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for symbol in range(256):
        if symbol == 0:
            bucket = [np.flatnonzero(needed & (symbols == 0))]
        else:
            bucket = induced[symbol]
            front = np.concatenate(bucket) if bucket else np.empty(0, np.int64)
            while len(front):  # type L inside the bucket: runs of one symbol
                front = front[front > 0] - 1
                front = front[needed[front] & (symbols[front] == symbol) & ~smaller[front]]
                if len(front):
                    bucket.append(front)
            bucket.append(direct[s_bounds[symbol]:s_bounds[symbol + 1]])
        whole = np.concatenate(bucket)
        induced[symbol] = []
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[needed[before] & ~smaller[before] & (symbols[before] > symbol)]
        if len(before):
            heads = symbols[before]
            order = np.argsort(heads, kind="stable")
            before, heads = before[order], heads[order]
            cuts = np.flatnonzero(np.diff(heads)) + 1
            for part in np.split(before, cuts):
                induced[symbols[part[0]]].append(part)
    whole = np.concatenate(out) if out else np.empty(0, np.int64)
    return whole[wanted[whole]]


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in
    ``order``, at most ``depth`` (first entry 0)."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for done in range(0, depth, 8):
        if not len(alive):
            break
        a, b = (_words_at(symbols, order[alive - d], done) for d in (0, 1))
        differ = a ^ b
        same = np.full(len(alive), 8)
        odd = differ != 0
        # leading equal bytes of the big-endian words
        same[odd] = sum((differ[odd] < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[alive] += same
        alive = alive[~odd]
    return np.minimum(out, depth)


def smallest_ids(parts: list[bytes], ids: np.ndarray, width: int) -> list[np.ndarray]:
    """For each fragment, per window, the smallest id among all the fragments
    that hold the window's string.  The fragments are distinct."""
    sizes = np.array([len(p) for p in parts], np.int64)
    # UTF-8 has no byte 255, so byte + 1 leaves symbol 0 for the ends
    symbols = np.frombuffer(b"\xff".join(parts) + b"\xff" * 72, np.uint8) + np.uint8(1)
    start = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - width + 1
    wanted = np.zeros(len(symbols), bool)
    at = np.repeat(start - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    wanted[at] = True
    order = suffix_order(symbols, wanted, width)
    new = np.flatnonzero(common_prefixes(symbols, order, width) < width)
    owner_id = np.empty(len(symbols), np.int64)
    owner_id[at] = np.repeat(ids, windows)
    least = np.minimum.reduceat(owner_id[order], new)
    owner_id[order] = np.repeat(least, np.diff(new, append=len(order)))
    least, ends = owner_id[at], np.cumsum(windows).tolist()
    return [least[a:b] for a, b in zip([0, *ends], ends, strict=False)]


# --- the Spark job ---------------------------------------------------------------

def route_counts(ids: np.ndarray, found: Fragments) -> tuple[np.ndarray, np.ndarray]:
    """Distinct routes of a slice and how many ids hold each (up to 255)."""
    owners = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0)[found.text]
    order = np.lexsort((owners, found.route))
    r, o = found.route[order], owners[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    pair = new.copy()
    pair[1:] |= o[1:] != o[:-1]
    first = np.flatnonzero(new)
    counts = np.add.reduceat(pair.astype(np.int64), first) if len(first) else first
    return r[first], np.minimum(counts, 255).astype(np.uint8)


class Slice:
    """One slice's texts in the order of their ids, its fragments, and, once
    it is known which routes are repeated, the distinct ones among those in
    the order of their routes.  Two fragments of a slice are one when route
    (48 bits) and content hash (64 bits) agree."""

    def __init__(self, group: pa.Table, width: int, gram: int):
        pairs = sorted(zip(group["id"].to_pylist(), group["content"].cast(pa.binary()).to_pylist(), strict=True))
        self.ids = np.array([p[0] for p in pairs], np.int64)
        self.texts = [p[1] for p in pairs]
        self.width, self.found = width, fragments(self.texts, width, gram)
        self.routes, self.counts = route_counts(self.ids, self.found)

    def keep_repeated(self, answers: np.ndarray) -> None:
        repeated = self.routes[answers >= 2]
        at = np.searchsorted(repeated, self.found.route)
        hit = at < len(repeated)
        hit[hit] = repeated[at[hit]] == self.found.route[hit]
        self.found = found = self.found[hit]
        # stable: the first of equal fragments has the smallest id
        order = np.lexsort((found.content, found.route))
        route, content = found.route[order], found.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (route[1:] != route[:-1]) | (content[1:] != content[:-1])
        self.which = np.empty(len(order), np.int64)  # distinct fragment of each one
        self.which[order] = np.cumsum(new) - 1
        self.distinct = found[order[new]]

    def parts(self, a: int, b: int) -> list[bytes]:
        """Bytes of the distinct fragments a to b."""
        d, more = self.distinct, self.width - 1
        rows = zip(d.text[a:b].tolist(), d.start[a:b].tolist(), d.windows[a:b].tolist(), strict=True)
        return [self.texts[t][s:s + n + more] for t, s, n in rows]


def suffix_dedup(docs: DataFrame, width: int = 50, gram: int = 24, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, span_starts, span_ends, kept`` per row: maximal
    removed byte intervals (ends exclusive) and the remaining bytes."""
    # two groups per shuffle partition: a task holds one of them at a time
    slices = owners = 2 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    rows = rows.withColumn("slice", slice_of("id", slices))

    def send_routes(group: pa.Table) -> pa.Table:
        s = Slice(group, width, gram)
        return ex.to_table(list(ex.parcels(group["slice"][0].as_py(), s.routes, s.counts, owners, BITS)),
                           ex.SENT_ARROW)

    def send_fragments(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return ex.to_table([], FRAGMENTS_ARROW)
        s, out = Slice(group, width, gram), []
        s.keep_repeated(ex.answers(replies))
        cuts = np.searchsorted(ex.owner_of(s.distinct.route, owners, BITS), np.arange(owners + 1)).tolist()
        least = s.ids[s.distinct.text]
        for owner, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                sizes = (s.distinct.windows[a:b] + width - 1).astype(np.int32)
                out.append((group["slice"][0].as_py(), owner, b"".join(s.parts(a, b)), sizes.tobytes(),
                            least[a:b].tobytes(), s.distinct.route[a:b].tobytes()))
        return ex.to_table(out, FRAGMENTS_ARROW)

    def sort_suffixes(group: pa.Table) -> pa.Table:
        """One owner: the fragments of all slices, a range of routes at a time."""
        data = b"".join(group["bytes"].to_pylist())
        size, least, route = (np.concatenate([np.frombuffer(x, kind) for x in group[c].to_pylist()])
                              for c, kind in (("sizes", np.int32), ("ids", np.int64), ("routes", np.uint64)))
        each = [len(x) // 4 for x in group["sizes"].to_pylist()]
        owner, senders = group["owner"][0].as_py(), group["slice"].to_pylist()
        del group
        begin = np.cumsum(size, dtype=np.int64) - size
        windows = size.astype(np.int64) - width + 1
        upto = np.concatenate(([0], np.cumsum(windows)))
        result = np.empty(upto[-1], np.int64)
        order = np.argsort(route, kind="stable")
        # a batch ends between two routes: equal strings share a route
        filled = np.cumsum(size[order], dtype=np.int64) // BATCH
        step = np.maximum.accumulate(np.where(np.diff(route[order], prepend=route[order][:1]) != 0, filled, 0))
        for batch in np.split(order, np.flatnonzero(np.diff(step)) + 1):
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(data[a:a + n], len(index))
                              for a, n in zip(begin[batch].tolist(), size[batch].tolist(), strict=True)])
            ids = np.full(len(index), np.iinfo(np.int64).max)
            np.minimum.at(ids, which, least[batch])
            found = smallest_ids(list(index), ids, width)
            result[ranges(upto[batch], windows[batch])] = np.concatenate([found[i] for i in which.tolist()])
        answered, at = [], 0
        for slice_no, n in zip(senders, each, strict=True):
            answered.append((slice_no, owner, zlib.compress(result[upto[at]:upto[at + n]].tobytes(), 1)))
            at += n
        return ex.to_table(answered, ex.ANSWERED_ARROW)

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return ex.to_table([], OUT_ARROW)
        s = Slice(group, width, gram)
        step = np.asarray(replies["step"])
        s.keep_repeated(ex.answers(replies.filter(pa.array(step == 1))))
        second = replies.filter(pa.array(step == 2)).sort_by("owner")["answer"].to_pylist()
        least = np.frombuffer(b"".join(zlib.decompress(x) for x in second), np.int64)
        at = np.cumsum(s.distinct.windows) - s.distinct.windows
        f = s.found
        drop = least[ranges(at[s.which], f.windows)] < np.repeat(s.ids[f.text], f.windows)
        begin, whose = ranges(f.start, f.windows)[drop], np.repeat(f.text, f.windows)[drop]
        cuts = np.searchsorted(whose, np.arange(len(s.texts) + 1)).tolist()
        out = []
        for k, (i, text) in enumerate(zip(s.ids.tolist(), s.texts, strict=True)):
            starts, ends = spans(begin[cuts[k]:cuts[k + 1]], width)
            kept, done = [], 0
            for a, b in zip(starts, ends, strict=True):
                kept.append(text[done:a])
                done = b
            out.append((None if i == NULL_ID else i, len(text), starts, ends, b"".join([*kept, text[done:]])))
        return ex.to_table(out, OUT_ARROW)

    by_slice = rows.groupBy("slice")
    counted = written(ex.exchange(by_slice.applyInArrow(send_routes, ex.SENT), "count", "u1"))
    sent = by_slice.cogroup(counted.groupBy("slice")).applyInArrow(send_fragments, FRAGMENTS)
    ranked = sent.groupBy("owner").applyInArrow(sort_suffixes, ex.ANSWERED)
    replies = counted.withColumn("step", F.lit(1)).unionByName(ranked.withColumn("step", F.lit(2)))
    return by_slice.cogroup(replies.groupBy("slice")).applyInArrow(remove, OUT)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ..., start + size - 1, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def spans(begin: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Maximal intervals covered by windows that begin at ``begin`` (sorted)."""
    if not len(begin):
        return [], []
    cut = np.flatnonzero(np.diff(begin) > width) + 1
    return begin[np.concatenate(([0], cut))].tolist(), (begin[np.concatenate((cut - 1, [-1]))] + width).tolist()
