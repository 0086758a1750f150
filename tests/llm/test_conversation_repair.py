"""Conversation repair against a plain dynamic program over (cost, edits)."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.util import SF001
from veritext.llm import conversation_repair as cr
from veritext.llm import queries

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, edits, repaired rows) of rows (role, text, fault); ends in '' or 'a'."""
    table = {q: (0, "", []) if q in ("", "a") else None for q in ("", "s", "u", "a")}

    def inserted(t):
        for _ in range(4):
            for q in t:
                due = "a" if q == "u" else "u"
                if t[due] is not None:
                    x = (t[due][0] + 3, "I" + t[due][1], [({"u": "user", "a": "assistant"}[due], "")] + t[due][2])
                    if t[q] is None or x[:2] < t[q][:2]:
                        t[q] = x
        return t

    table = inserted(table)
    for role, text, fault in reversed(rows):
        new = {}
        for q in table:
            options = []

            def add(to, cost, edit, row):
                if table[to] is not None:
                    options.append((cost + table[to][0], edit + table[to][1], row + table[to][2]))

            add(q, 4, "D", [])
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (q, role[:1]) in STEP:
                    add(STEP[q, role[:1]], extra, "K", [(role, text)])
                due = "a" if q == "u" else "u"
                add(due, 3 + extra, "R", [({"u": "user", "a": "assistant"}[due], text)])
            new[q] = min(options, default=None)
        table = inserted(new)
    return table[""]


def judged(rows):
    """Contract columns of one conversation: rows (turn, role, text) after damage."""
    def key(r):
        return (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())

    rows, seen, faults = sorted(rows, key=key), set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    cost, edits, left = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def random_codes(rnd, n, sound=0.7):
    return bytes(4 * rnd.choice((0, 1, 1, 2, 2, 3)) + (0 if rnd.random() < sound else rnd.randint(1, 3)) for _ in range(n))


def plain(codes):
    return [("sua?"[c // 4], "t", ("", "blank", "duplicate", "truncated")[c % 4]) for c in codes]


def test_auction_finds_the_cheapest_and_least_edits():
    rnd = random.Random(1)
    for n in list(range(7)) * 60 + [40, 64]:
        codes = random_codes(rnd, n, rnd.random())
        assert cr.whole(codes) == cheapest(plain(codes))[:2]


def test_segments_join_to_the_whole(monkeypatch):
    rnd = random.Random(2)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(cr, "SEGMENT", size)
        convs = [random_codes(rnd, rnd.randint(1, 14), 0.6) for _ in range(60)]
        rows = [(c, i, code) for c, codes in enumerate(convs) for i, code in enumerate(codes)]
        bounds = sorted(rnd.sample(range(len(rows)), 7)) + [len(rows)]
        segs, at = [], 0
        for part, b in enumerate(bounds):
            segs += list(cr.cut(iter([(part, *r) for r in rows[at:b]])))
            at = b
        assert b"".join(s[4] for s in segs) == b"".join(convs)
        assert sum((s[5] for s in segs), []) == [i for _, i, _ in rows]
        open_segs = [s for s in segs if s[3]]
        alone = defaultdict(int)
        for s in segs:
            alone[s[0]] += 1
        assert all(s[3] for s in segs if alone[s[0]] > 1)
        back = [(c, p, s, cr.between(codes)) for c, p, s, _, codes, _ in sorted(open_segs, key=lambda s: (s[0], -s[1], -s[2]))]
        prices = {(p, s): x for _, p, s, x in cr.carried_back(iter(back))}
        traced = []
        for c, p, s, _, codes, _ in open_segs:
            cost, edits, exits = cr.against(codes, tuple(prices[p, s]))
            traced.append((c, p, s, codes[0] // 4, codes[-1] // 4, cost, edits, exits))
        done = list(cr.carried_forward(iter(traced)))
        for c in {s[0] for s in open_segs}:
            mine = [x for x in done if x[0] == c]
            cost, edits, _ = cheapest(plain(convs[c]))
            assert sum(x[5] for x in mine) == cost and "".join(x[4] for x in mine) == edits
            inside = sum(cr.illegal_pairs(s[4]) for s in open_segs if s[0] == c)
            assert inside + sum(x[6] for x in mine) == cr.illegal_pairs(convs[c])


def results(repair):
    sums = {r.conv: r for r in repair.summary().collect()}
    digests = {r.conv: r for r in repair.digests().collect()}
    return {c: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, digests[c].audit,
                digests[c].repaired_sha256) for c, r in sums.items()}


def test_odd_conversations_and_a_long_one(spark):
    rnd = random.Random(3)
    rows = [(1, None, "user", "late?"), (1, 0, "user", "hello."), (1, 5, "assistant", " "), (2, None, None, None),
            (None, 1, "user", "null conversation."), (None, 2, "assistant", "yes"), (3, 1, "", "no role."),
            (3, 1, "system", "tie."), (3, 1, "system", "tie."), (4, 7, "assistant", "x" * 100_000 + "."),
            (4, 8, "User", "capital."), (4, 8, "umpire", "starts with u.\n\t"), (4, 8, "ümlaut", "…")]
    rows += [(9, i // 2, rnd.choice(["user", "assistant", "user", "system", "tool"]),
              rnd.choice(["a.", "b!", "same.", "", "cut", f"own {i}.", f"own {i}"])) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit(1) for c in ("conv", "id", "print", "code", "part", "seg", "edits", "copy")})
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, " " if r is None else r, " " if x is None else x))
    want = {c: judged(r) for c, r in want.items()}
    repair = cr.Repair(df)
    assert results(repair) == want
    # the repaired rows themselves
    for c in (1, 9):
        left = [f"{r.role}:{r.text}" for r in repair.repaired().where(F.col("conv") == c).orderBy("part", "seg", "step").collect()]
        assert hashlib.sha256("\n".join(left).encode()).hexdigest() == want[c][-1]
    empty = cr.Repair(df.limit(0))
    assert empty.summary().collect() == [] and empty.digests().collect() == [] and empty.repaired().collect() == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    after = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 1:
            x = ""
        if kind == 2:
            x = x.translate({ord(k): None for k in ".!?"})
        if kind == 4:
            r = "user"
        after[c] += [(t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = queries.op12_conversation_repair(spark, SF001)
    kinds = dict(out.dtypes)
    assert all(kinds[k] == "bigint" for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert got == {c: judged(r) for c, r in after.items()}
    assert len({v[6] for v in got.values()}) > 10
