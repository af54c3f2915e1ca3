"""Conversation repair against a plain shortest-path search and plain loops."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from vintage.llm import conversation_repair as cr
from vintage.llm.common import ship

FIELDS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Dijkstra over (place, state) with (cost, letters) as the label."""
    n, heap, done = len(rows), [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, s = heapq.heappop(heap)
        if i == n and s in (0, 3):
            return cost, letters
        if (i, s) in done:
            continue
        done.add((i, s))
        new = {0: "u", 1: "u", 2: "a", 3: "u"}[s]
        to = {"u": 2, "a": 3}[new]
        heapq.heappush(heap, (cost + 5, letters + "I", i, to))
        if i < n:
            role, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, s))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 1 + more, letters + "R", i + 1, to))
                kept = s if role == "" else {(0, "s"): 1, (s, new): to}.get((s, role[:1]))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, kept))


def repair(rows, letters):
    out, s, i = [], 0, 0
    for x in letters:
        new = {0: "user", 1: "user", 2: "assistant", 3: "user"}[s]
        to = {"user": 2, "assistant": 3}[new]
        if x == "I":
            out.append(f"{new}:")
            s = to
            continue
        role, text = rows[i]
        i += 1
        if x == "R":
            out.append(f"{new}:{text}")
            s = to
        elif x == "K":
            out.append(f"{role}:{text}")
            s = s if role == "" else 1 if role[0] == "s" else to
    return "\n".join(out)


def plain(table):
    space = lambda x: " " if x is None else str(x)
    out, after = [], []
    for conv, turn, role, text in table:
        role, text = space(role), space(text)
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    null = lambda x: (x is not None, x or 0)
    after.sort(key=lambda r: (null(r[0]), null(r[1]), r[2].encode(), r[3].encode()))
    by = {c: list(g) for c, g in groupby(after, key=lambda r: r[0])}
    for conv in {r[0] for r in table}:
        rows, seen, faults = by.get(conv, []), set(), []
        for _, _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in rows if r[1] is not None]
        cost, audit = cheapest([(r[2], f) for r, f in zip(rows, faults, strict=True)])
        pairs = zip(rows, rows[1:], strict=False)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                    hashlib.sha256(repair([r[2:] for r in rows], audit).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0)


def compare(spark, df, block=cr.BLOCK):
    ship(spark)
    got = sorted((tuple(r) for r in cr.audit_conversations(df, block).collect()), key=key)
    table = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got == sorted(plain(table), key=key)
    return got


def test_auction_equals_search():
    rng = random.Random(3)
    for trial in range(600):
        n = rng.randrange(0, 40)
        roles = rng.choice(["ua", "uuas", "usxae", "aaau"])
        rows = [("" if (r := rng.choice(roles)) == "e" else r, rng.choice([None, None, "truncated", "blank"])) for _ in range(n)]
        faults = "".join({None: "k", "truncated": "t", "blank": "d"}[f] for _, f in rows)
        lattice = cr.Lattice("".join(r or "e" for r, _ in rows), faults, cr.END, True)
        lattice.converge()
        letters, _ = lattice.trace(0)
        assert (lattice.price[0], letters) == cheapest(rows), (trial, rows)


@pytest.mark.parametrize("block", [cr.BLOCK, 3])
def test_conversations(spark, block):
    got = compare(spark, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), block)
    assert any(r[6] for r in got)


def test_long_conversation_in_blocks(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user"]), rng.choice(["a.", "b", f"text {t}.", f"text {t}", " "]))
            for c in (1, 2) for t in range(700 if c == 1 else 40)]
    for block in (cr.BLOCK, 16):
        compare(spark, spark.createDataFrame(rows, FIELDS), block)


ROWS = [(1, 1, "user", "same text."), (1, 1, "user", "same text."), (1, 2, None, None), (1, None, "assistant", ""), (1, None, None, "x."),
        (None, 3, "user", "who?"), (None, None, "assistant", "me!"), (2, 1, "", "no role."), (2, 2, "user", "end \n\t"), (2, 2, "assistant", "Ja. \x0b"),
        (2, 5, "user", "long " * 30_000), (3, 9, "user", "\n"), (4, 1, "assistant", "a."), (4, 2, "system", "b."), (4, 900, "user", "é"),
        *[(c, 1, "user", "Hi.") for c in range(5, 40)]]


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_edges(spark, kind):
    df = spark.createDataFrame([] if kind == "empty" else ROWS, FIELDS)
    if kind == "clashes":
        names = ["_at", "_t", "_r", "_kind", "_copy", "block", "fault", "_c", "_k", "_n", "gaps", "cost", "audit", "initials", "last"]
        df = df.select("*", *[F.lit("x").alias(c) for c in names])
    got = compare(spark, df, 2)
    assert len(got) == (0 if kind == "empty" else 40)
    if kind != "empty":
        empty = hashlib.sha256(b"").hexdigest()
        assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", empty) for r in got)  # all rows dropped
