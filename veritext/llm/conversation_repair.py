"""Conversation structure repair by the auction shortest-path algorithm.

The rows of a conversation, in order of their turns, are a lattice: node
``(i, q)`` stands before row ``i`` with the repaired role initials so far in
state ``q`` of ``(s?(ua)+)?``.  Arcs are the edits, with integer costs: keep a
row, give it the role user or assistant, delete it, or insert an empty row.
The cheapest path is found by an auction: the path from the origin is extended
along an arc that its end's price pays for exactly, or contracted after the
end's price has risen to the cheapest offer.  Prices never exceed what an arc
costs plus the next price, so at the end exactly the tight arcs can lie on a
cheapest path, and the ASCII-least edits are traced along them.

Rows are dealt by range of (conversation, turn, print, row), so one
conversation can spread over many tasks; each task cuts its rows into segments
of ``SEGMENT`` at most.  A conversation inside one segment is solved there.
The others are solved in three steps: auctions give each segment's costs
between its entry and exit states, two passes over these small tables (sorted,
a few numbers in memory) carry the prices back from the end and the states
forward from the start, and auctions against the carried prices give the
edits, segment by segment.  Only thin columns are sorted; text is joined to
the edits at the end, and a conversation's digest is streamed.

Faults (the first that fits): blank, no ``[^\\x20\\x09-\\x0D]``; duplicate, the
same role and text earlier in the conversation; truncated, the last such
character is not one of ``.!?``.

Defined results: a null conversation id is a conversation; null roles and texts
are one space (so the role's initial is a space, the text blank); null turns
come first and do not count for gaps; rows of one turn are ordered by the
SHA-256 of role and text, and equal rows follow each other, the first is no
duplicate; an empty table gives empty results; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .line_dedup import BLANKS

SEGMENT = 64  # rows of one lattice
FAR = 1 << 40  # the cost of no way

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Codes of a row: 4 * initial + fault.
INITIALS = "sua"  # others are 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}  # su ua au
# States: nothing yet, s, ...u, ...a; the state behind each initial, and the role that is due.
EMPTY, S, U, A = range(4)
BEHIND = ({0: S, 1: U}, {1: U}, {2: A}, {1: U})
DUE = ((U, "user"), (U, "user"), (A, "assistant"), (U, "user"))
OPEN_END = (0, FAR, FAR, 0)  # a conversation may end in EMPTY or A


class Lattice:
    """One segment: node ``4 i + q``, and the end behind the last column,
    reached from state ``q`` at cost ``exits[q]``.  ``last`` allows insertions
    behind the last row."""

    def __init__(self, codes: bytes, exits: tuple[int, ...], last: bool):
        self.n, self.end = len(codes), 4 * len(codes) + 4
        self.price = [0] * (self.end + 1)
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i, code in enumerate(codes):
            initial, fault = divmod(code, 4)
            extra = TRUNCATED if fault == CUT else 0
            for q in range(4):
                due = DUE[q][0]
                out = [("D", 4 * i + 4 + q, DELETE), ("I", 4 * i + due, INSERT)]
                if fault not in (BLANK, DUPLICATE):
                    if initial in BEHIND[q]:
                        out.append(("K", 4 * i + 4 + BEHIND[q][initial], KEEP + extra))
                    out.append(("R", 4 * i + 4 + due, REROLE + extra))
                self.arcs.append(out)
        for q in range(4):
            out = [("", self.end, exits[q])] if exits[q] < FAR else []
            self.arcs.append(out + ([("I", 4 * self.n + DUE[q][0], INSERT)] if last else []))
        # prices would rise for ever in a cycle without a way out: only arcs to nodes with one
        ways = self.ways([[j for _, j, _ in out] for out in self.arcs])
        self.arcs = [[arc for arc in out if ways[arc[1]]] for out in self.arcs]

    def ways(self, successors: list[list[int]]) -> list[bool]:
        """Which nodes reach the end."""
        out = [False] * self.end + [True]
        for i in range(self.n, -1, -1):
            for _ in range(4):  # insertions stay in a column of four
                for node in range(4 * i, 4 * i + 4):
                    out[node] = any(out[j] for j in successors[node])
        return out

    def auction(self, origin: int) -> int:
        """Cost of the cheapest path from ``origin`` to the end.  Prices stay
        valid for further origins."""
        price, arcs, path = self.price, self.arcs, [origin]
        if not arcs[origin]:
            return FAR
        while True:
            node = path[-1]
            best, to = min((cost + price[j], j) for _, j, cost in arcs[node])
            if price[node] < best:  # contract: the end of the path pays the cheapest offer
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:  # extend
                if to == self.end:
                    return price[origin]
                path.append(to)

    def trace(self, origin: int) -> tuple[str, int]:
        """The ASCII-least edits of the cheapest paths, and the state they end in."""
        tight = [[(e, j) for e, j, cost in out if self.price[i] == cost + self.price[j]]
                 for i, out in enumerate(self.arcs)]
        ends = self.ways([[j for _, j in out] for out in tight])
        edits, node = [], origin
        while True:
            edit, to = min((e, j) for e, j in tight[node] if ends[j])
            if to == self.end:
                return "".join(edits), node % 4
            edits.append(edit)
            node = to


@lru_cache(1 << 16)
def whole(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    lattice = Lattice(codes, OPEN_END, True)
    return lattice.auction(EMPTY), lattice.trace(EMPTY)[0]


@lru_cache(1 << 12)
def between(codes: bytes) -> list[int]:
    """Costs from entry state ``e`` to exit state ``x``, at ``4 e + x``."""
    out = [FAR] * 16
    for x in range(4):
        lattice = Lattice(codes, tuple(0 if q == x else FAR for q in range(4)), False)
        for e in range(4):
            out[4 * e + x] = lattice.auction(e)
    return out


def against(codes: bytes, exits: tuple[int, ...]) -> tuple[list[int], list[str], list[int]]:
    """Per entry state: cost to the conversation's end, edits and exit state."""
    lattice = Lattice(codes, exits, False)
    costs = [lattice.auction(e) for e in range(4)]
    traces = [lattice.trace(e) if cost < FAR else ("", EMPTY) for e, cost in enumerate(costs)]
    return costs, [t for t, _ in traces], [x for _, x in traces]


def ending() -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost and insertions behind the last row, per state."""
    lattice = Lattice(b"", OPEN_END, True)
    costs = tuple(lattice.auction(q) for q in range(4))
    return costs, tuple(lattice.trace(q)[0] for q in range(4))


def roles(codes: bytes, edits: str, state: int = EMPTY) -> Iterator[tuple[str, int, str | None]]:
    """(edit, row or -1, new role or None) of each edit."""
    row = 0
    for e in edits:
        due, role = DUE[state]
        if e == "K":
            state = BEHIND[state][codes[row] // 4]
        elif e in "RI":
            state = due
        yield e, (-1 if e == "I" else row), (role if e in "RI" else None)
        row += e != "I"


def illegal_pairs(codes: bytes) -> int:
    return sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes[:-1], codes[1:], strict=True))


# ---------------------------------------------------------------- rows and segments

def thin_rows(rows: DataFrame) -> DataFrame:
    """``conv, turn, print, id, code`` of the written ``rows``: faults found."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    thin = rows.select("conv", "turn", "print", "id", F.substring("role", 1, 1).alias("initial"),
                       (F.length(F.ltrim(body, F.lit(BLANKS))) == 0).alias("blank"),
                       F.substring(body, -1, 1).isin(".", "!", "?").alias("closed"))
    first = thin.groupBy("conv", "print").agg(F.min(F.struct("turn", "id")).alias("first")).select(
        F.col("conv").alias("conv_2"), F.col("print").alias("print_2"), "first")
    thin = thin.join(first, F.col("conv").eqNullSafe(F.col("conv_2")) & (F.col("print") == F.col("print_2")))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("first.id") != F.col("id"), DUPLICATE)
             .when(~F.col("closed"), CUT).otherwise(SOUND))
    initial = F.when(F.length("initial") > 0, F.instr(F.lit(INITIALS), F.col("initial")) - 1).otherwise(-1)
    code = 4 * F.when(initial >= 0, initial).otherwise(3) + fault
    return thin.select("conv", "turn", "print", "id", code.cast("int").alias("code"))


def batch_of(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def streamed(df: DataFrame, function, columns: str, conv: str = "conv") -> DataFrame:
    """``function`` maps an iterator of row tuples to an iterator of row tuples
    ``conv, columns``, partition by partition, in bounded memory."""
    kind = df.schema[conv].dataType
    out = df.sparkSession.createDataFrame([], columns).schema
    schema = pa.schema([("conv", to_arrow_type(kind))] + [(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        pending: list[tuple] = []
        for row in function(rows):
            pending.append(row)
            if len(pending) == 4096:
                yield batch_of(list(zip(*pending, strict=True)), schema)
                pending = []
        if pending:
            yield batch_of(list(zip(*pending, strict=True)), schema)

    return df.mapInArrow(run, f"conv {kind.simpleString()}, {columns}")


def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (part, conv, id, code) -> segments (conv, part, seg, open, codes,
    ids).  A segment is open if its conversation may have others: here, or in
    the neighbouring ranges."""
    seg, edge, conv, codes, ids, part, parts_of_conv = 0, True, None, bytearray(), [], 0, 0
    for part, key, row, code in rows:
        if ids and (key != conv or len(ids) == SEGMENT):
            several = key == conv or parts_of_conv > 0
            yield conv, part, seg, edge or several, bytes(codes), ids
            if key != conv:
                edge, parts_of_conv = False, 0
            else:
                parts_of_conv += 1
            seg, codes, ids = seg + 1, bytearray(), []
        conv = key
        codes.append(code)
        ids.append(row)
    if ids:
        yield conv, part, seg, True, bytes(codes), ids


def segments(rows: DataFrame) -> DataFrame:
    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "print", "id"]
    dealt = thin_rows(rows).repartitionByRange(*key).sortWithinPartitions(*key)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "conv", "id", "code")
    return streamed(dealt, cut, "part int, seg int, open boolean, codes binary, ids array<long>")


# ---------------------------------------------------------------- conversations of several segments

def carried_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, part, seg, costs), last segment first -> prices of the exit states."""
    final, _ = ending()
    started, conv, prices = False, None, final
    for key, part, seg, costs in rows:
        if not started or key != conv:
            started, conv, prices = True, key, final
        yield key, part, seg, list(prices)
        prices = tuple(min(costs[4 * e + x] + prices[x] for x in range(4)) for e in range(4))


def carried_forward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, part, seg, first, last, costs, edits, exits), first segment
    first -> (conv, part, seg, state, edits, cost, illegal): the entry state of
    each segment, the cost in the first one, the pair at each joint."""
    _, tails = ending()
    held = None
    state, initial = EMPTY, None
    for key, part, seg, first, last, costs, edits, exits in rows:
        if held is not None:
            same = held[0] == key
            yield (*held[:4], held[4] + ("" if same else tails[state]), *held[5:])
        if held is None or held[0] != key:
            state, initial, cost = EMPTY, None, costs[EMPTY]
        else:
            cost = 0
        joint = int(initial is not None and (initial, first) not in LEGAL)
        held = (key, part, seg, state, edits[state], cost, joint)
        state, initial = exits[state], last
    if held is not None:
        yield (*held[:4], held[4] + tails[state], *held[5:])


def solved(segs: DataFrame) -> DataFrame:
    """``conv, part, seg, state, edits, cost, illegal`` of every segment."""

    def closed(rows):
        for conv, part, seg, codes in rows:
            cost, edits = whole(codes)
            yield conv, part, seg, EMPTY, edits, cost, 0

    def costs(rows):
        for conv, part, seg, codes in rows:
            yield conv, part, seg, between(codes)

    def traces(rows):
        for conv, part, seg, codes, prices in rows:
            cost, edits, exits = against(codes, tuple(prices))
            yield conv, part, seg, codes[0] // 4, codes[-1] // 4, cost, edits, exits

    out = "part int, seg int, state int, edits string, cost long, illegal int"
    simple = streamed(segs.where("not open").select("conv", "part", "seg", "codes"), closed, out)
    long = segs.where("open").select("conv", "part", "seg", "codes")
    # dealt by segment, so a long conversation's lattices spread
    matrix = streamed(long.repartition("part", "seg"), costs, "part int, seg int, costs array<long>")
    back = matrix.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seg"))
    prices = streamed(back, carried_back, "part int, seg int, prices array<long>")
    priced = long.join(prices.drop("conv"), ["part", "seg"]).select("conv", "part", "seg", "codes", "prices")
    traced = streamed(priced, traces, "part int, seg int, first int, last int, costs array<long>, "
                                      "edits array<string>, exits array<int>")
    forward = traced.repartition("conv").sortWithinPartitions("conv", "part", "seg")
    return simple.unionByName(streamed(forward, carried_forward, out))


# ---------------------------------------------------------------- results

class Repair:
    """Tables of one repair, written once: ``rows`` (conv, turn, role, text,
    id), ``segments`` and ``edits`` (one row per edit: conv, part, seg, step,
    edit, id of the row or null, new role or null)."""

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text"):
        def spaced(c: str) -> Column:
            return F.coalesce(F.col(c).cast("string"), F.lit(" "))

        rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"),
                         spaced(text_col).alias("text"))
        both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
        self.rows = written(rows.withColumn("print", F.unhex(F.sha2(both, 256)))
                            .withColumn("id", F.monotonically_increasing_id()))
        self.segments = written(segments(self.rows))
        self.solution = written(solved(self.segments))

        def spelled(rows):
            for conv, part, seg, codes, ids, state, edits in rows:
                for step, (edit, row, role) in enumerate(roles(codes, edits, state)):
                    yield conv, part, seg, step, edit, (ids[row] if row >= 0 else None), role

        pieces = self.segments.select("conv", "part", "seg", "codes", "ids").join(
            self.solution.select("part", "seg", "state", "edits"), ["part", "seg"])
        self.edits = written(streamed(pieces.select("conv", "part", "seg", "codes", "ids", "state", "edits"), spelled,
                                      "part int, seg int, step int, edit string, id long, role string"))

    def steps(self) -> DataFrame:
        """``edits`` with the role and text that each leaves (null if deleted)."""
        order = ["conv", "part", "seg", "step", "edit"]
        texts = self.rows.select("id", F.col("role").alias("old_role"), "text")
        stay = self.edits.where("edit in ('K', 'R')").join(texts, "id").select(
            *order, F.coalesce("role", "old_role").alias("role"), "text")
        others = self.edits.where("edit in ('D', 'I')").select(
            *order, "role", F.when(F.col("edit") == "I", "").alias("text"))
        return stay.unionByName(others)

    def repaired(self) -> DataFrame:
        """The repaired conversations: ``conv, part, seg, step`` (their order),
        ``role, text``."""
        return self.steps().where("edit <> 'D'").drop("edit")

    def summary(self) -> DataFrame:
        """Per conversation: gaps, faults, illegal pairs and cost."""
        turns = self.rows.groupBy("conv").agg(F.coalesce(
            F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))

        def counted(rows):
            for conv, codes in rows:
                faults = [c % 4 for c in codes]
                yield conv, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal_pairs(codes), 0

        kinds = ("blank", "duplicate", "truncated", "illegal", "cost")
        counts = streamed(self.segments.select("conv", "codes"), counted, ", ".join(f"{k} long" for k in kinds))
        zero = [F.lit(0).cast("long").alias(k) for k in kinds[:3]]
        joints = self.solution.select("conv", *zero, F.col("illegal").cast("long").alias("illegal"), "cost")
        sums = counts.unionByName(joints).groupBy("conv").agg(*[F.sum(k).alias(k) for k in kinds])
        sums = sums.withColumnRenamed("conv", "conv_2")
        return turns.join(sums, F.col("conv").eqNullSafe(F.col("conv_2"))).drop("conv_2")

    def digests(self) -> DataFrame:
        """Per conversation: ``audit`` (all edits) and the SHA-256 of its
        repaired ``role:text`` rows, newline-joined.  A digest needs its rows
        one after the other: they are sorted and streamed, not collected."""
        order = self.steps().repartition("conv").sortWithinPartitions("conv", "part", "seg", "step")

        def digest(rows):
            conv, audit, sha, lines = None, [], None, 0
            for key, edit, role, text in rows:
                if sha is None or key != conv:
                    if sha is not None:
                        yield conv, "".join(audit), sha.hexdigest()
                    conv, audit, sha, lines = key, [], hashlib.sha256(), 0
                audit.append(edit)
                if edit != "D":
                    sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if sha is not None:
                yield conv, "".join(audit), sha.hexdigest()

        return streamed(order.select("conv", "edit", "role", "text"), digest, "audit string, repaired_sha256 string")
