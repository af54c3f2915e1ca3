"""Conversation structure repair (operator 11) by the auction shortest-path
algorithm.

A conversation's rows, in order, are the columns of a lattice; its four levels
are the states of the grammar ``(s?(ua)+)?`` over role initials (nothing yet,
after s, after u, after a). Arcs are edits: Keep 0, Rerole 1, Delete 2, Insert
5, and 5 more for a truncated row that stays; blank and repeated rows can only
be deleted. A letter leads from a node to one node at most, so a string of
letters names a path.

Shortest paths come from Bertsekas' auction: a path is extended along the arc
that the prices make cheapest, and contracted, its end's price raised, where no
arc is as cheap as the price says. Prices only rise and never pass a node's
distance. Among equal arcs the least letter is taken; an arc passed over with a
smaller letter was dearer then and can't get cheaper, so the converged path is
the least string among the cheapest. Prices start from the rows' least costs
and converge from the end of the lattice to its start, a few rows at a time,
which keeps contractions short.

Conversations are cut into blocks of BLOCK rows, whatever their length. The
auctions of blocks run in any task: one gives a block's costs from each state
to each state, the next, knowing the prices at its end, the paths from each
state. Between them only four prices a block go through a conversation in
order, and at the end its rows do, one after the other, because a SHA-256
over the whole repaired text can't be cut: that task holds a row and the
letters of the conversation, which are its result.

Null conv_ids are a conversation of their own; null turns come first; a null
role, text, conv_id or turn counts as one space. Rows of one turn follow each
other by role and text, so repeated rows are neighbours and all but the first
are duplicates. An empty role has no initial: kept, it changes no state. An
empty table gives an empty result; a conversation without rows after damage
has zeros, an empty audit and the hash of the empty string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import cut, positions

#: Rows whose auctions run in one piece, and rows between converged prices.
BLOCK, STRIDE = 256, 8
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INF = 1 << 60
#: Grammar: (state, initial) -> state; every state expects one of u and a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EXPECTS = {0: "user", 1: "user", 2: "assistant", 3: "user"}
NEXT = {s: STEP[s, role[0]] for s, role in EXPECTS.items()}
ACCEPTS = (0, 3)
WHITE = " \t\n\x0b\x0c\r"


# --- auction ----------------------------------------------------------------

class Lattice:
    """Lattice of some rows. ``initials`` and ``faults`` have a character for
    each row (fault: ``k`` none, ``d`` must be deleted, ``t`` truncated);
    ``exits`` the price of leaving it in each state; ``last``: rows may be
    inserted after its end."""

    def __init__(self, initials: str, faults: str, exits: tuple[int, ...], last: bool):
        self.n = n = len(initials)
        self.sink = 4 * (n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(self.sink + 1)]
        self.price = [INF] * self.sink + [0]
        least = min(exits)
        for s in range(4):
            if exits[s] < INF:
                self.arcs[4 * n + s].append(("", exits[s], self.sink))
        reaches = {s for s in range(4) if exits[s] < INF}
        self._close(n, reaches, last, least)
        for i in range(n - 1, -1, -1):
            extra = TRUNCATED if faults[i] == "t" else 0
            ahead, reaches = reaches, set()
            for s in range(4):
                arcs = [("D", DELETE, s)]
                if faults[i] != "d":
                    kept = s if initials[i] == "e" else STEP.get((s, initials[i]))
                    if kept is not None:
                        arcs.append(("K", KEEP + extra, kept))
                    arcs.append(("R", REROLE + extra, NEXT[s]))
                self.arcs[4 * i + s] = [(x, c, 4 * (i + 1) + t) for x, c, t in arcs if t in ahead]
                if self.arcs[4 * i + s]:
                    reaches.add(s)
            least += min((c for s in range(4) for _, c, _ in self.arcs[4 * i + s]), default=0)
            self._close(i, reaches, True, least)

    def _close(self, i: int, reaches: set[int], inserts: bool, least: int) -> None:
        """Arcs of inserted rows at position ``i``; first prices there."""
        if inserts:
            for _ in range(4):
                reaches.update(s for s in range(4) if NEXT[s] in reaches)
            for s in range(4):
                if NEXT[s] in reaches:
                    self.arcs[4 * i + s].append(("I", INSERT, 4 * i + NEXT[s]))
        for s in range(4):
            self.arcs[4 * i + s].sort()
            if s in reaches:
                self.price[4 * i + s] = least

    def walk(self, origin: int, until: int) -> tuple[str, int]:
        """Auction from ``origin`` to the first node numbered ``until`` or
        more: the letters and the node. Prices on the path are distances."""
        price, arcs = self.price, self.arcs
        path, letters = [origin], [""]
        while path[-1] < until:
            best = INF
            for x, c, j in arcs[path[-1]]:
                if c + price[j] < best:
                    best, letter, to = c + price[j], x, j
            if price[path[-1]] < best:
                price[path[-1]] = best
                if len(path) > 1:
                    path.pop()
                    letters.pop()
            else:
                path.append(to)
                letters.append(letter)
        return "".join(letters), path[-1]

    def converge(self) -> None:
        """Make the prices of every STRIDE-th position distances, from the end."""
        until = self.sink
        for i in range(self.n - self.n % STRIDE, -1, -STRIDE):
            for s in range(4):
                if self.price[4 * i + s] < INF:
                    self.walk(4 * i + s, until)
            until = 4 * i

    def entry_prices(self) -> list[int]:
        return self.price[:4]

    def trace(self, state: int) -> tuple[str, int]:
        """Least of the cheapest strings from ``state``; the state at the end."""
        if self.price[state] >= INF:
            return "", state
        letters, at = "", state
        while at < 4 * self.n:  # to the last column, where the state is read
            more, at = self.walk(at, 4 * min(self.n, at // 4 + STRIDE - at // 4 % STRIDE))
            letters += more
        more, _ = self.walk(at, self.sink)
        return letters + more, at % 4


END = tuple(0 if s in ACCEPTS else INF for s in range(4))


def transfer(initials: str, faults: str) -> list[int]:
    """Costs of a block from each state (fours) to each state."""
    out = []
    for to in range(4):
        lattice = Lattice(initials, faults, tuple(0 if s == to else INF for s in range(4)), last=False)
        lattice.converge()
        out.append(lattice.entry_prices())
    return [out[to][s] for s in range(4) for to in range(4)]


# --- tasks ------------------------------------------------------------------

def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [END * 4 if last else transfer(i, f) for i, f, last in
                 zip(*(batch.column(k).to_pylist() for k in ("initials", "faults", "last")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(costs, pa.list_(pa.int64())),
                                          batch.column("initials"), batch.column("faults"), batch.column("last")],
                                         ["conv_id", "block", "costs", "initials", "faults", "last"])


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its last to its first, which get the
    prices at their end."""
    ahead: list[int] = []
    for batch in batches:
        exits = []
        for costs, initials, faults, last in zip(*(batch.column(k).to_pylist() for k in ("costs", "initials", "faults", "last")), strict=True):
            exits.append(list(END) if last else ahead)
            if last:
                lattice = Lattice(initials, faults, END, last=True)
                lattice.converge()
                ahead = lattice.entry_prices()
            else:
                ahead = [min(INF, *(costs[4 * s + t] + ahead[t] for t in range(4))) for s in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(exits, pa.list_(pa.int64()))],
                                         ["conv_id", "block", "exits"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for block, initials, faults, last, exits in zip(*(batch.column(k).to_pylist() for k in ("block", "initials", "faults", "last", "exits")), strict=True):
            lattice = Lattice(initials, faults, tuple(exits or END), last)
            lattice.converge()
            found = [lattice.trace(s) for s in range(4 if block else 1)]
            rows.append(([x for x, _ in found], [s for _, s in found], lattice.price[0]))
        paths, states, costs = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(paths, pa.list_(pa.string())),
                                          pa.array(states, pa.list_(pa.int32())), pa.array(costs, pa.int64())],
                                         ["conv_id", "block", "paths", "states", "cost"])


class _Repair:
    """A conversation whose rows go by."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost, self.illegal, self.before = conv_id, 0, 0, 0, None
        self.audit: list[str] = []
        self.hash, self.opened = hashlib.sha256(), False
        self.rest, self.at, self.now = "", 0, 0

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.opened else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.opened = True

    def inserted(self) -> None:
        while self.at < len(self.rest) and self.rest[self.at] == "I":
            self.put(EXPECTS[self.now], "")
            self.now, self.at = NEXT[self.now], self.at + 1

    def add(self, role: str, text: str, paths, states, cost) -> None:
        if paths is not None:
            if not self.audit:
                self.cost = cost
            self.rest, self.at, self.now = paths[self.state], 0, self.state
            self.audit.append(self.rest)
            self.state = states[self.state]
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.inserted()
        letter = self.rest[self.at]
        self.at += 1
        if letter == "R":
            self.put(EXPECTS[self.now], text)
            self.now = NEXT[self.now]
        elif letter == "K":
            self.put(role, text)
            self.now = STEP[self.now, initial] if initial else self.now
        self.inserted()  # only at the end of a conversation: elsewhere they lead a row or block

    def row(self) -> tuple:
        return self.conv_id, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations, in order -> a row for each."""
    names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    held, kind = None, None
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for conv_id, role, text, paths, states, cost in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text", "paths", "states", "cost")), strict=True):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    out.append(held.row())
                held = _Repair(conv_id)
            held.add(role, text, paths, states, cost)
        if out:
            yield _batch(out, names, kind)
    if held is not None:
        yield _batch([held.row()], names, kind)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


# --- Spark ------------------------------------------------------------------

def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that
    crc32(conv_id:turn) mod 20 picks: 0 drops a row, 1 empties its text, 2
    takes its ``.!?``, 3 repeats it, 4 makes its role user."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = (F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate(F.col("_t"), ".!?", ""))
            .otherwise(F.col("_t")))
    rows = conversations.select("conv_id", "turn", _text("role").alias("_r"), _text("text").alias("_t"), kind.alias("_kind"))
    rows = rows.where("_kind != 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("_r")).alias("role"),
        text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with their place ``_at`` in the
    conversation and their first ``fault`` (blank, duplicate, truncated)."""
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = positions(rows, ["conv_id", "turn", "role", "text"], ["conv_id"]).withColumn("_text_key", key)
    firsts = (rows.groupBy("conv_id", "_text_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("_text_key").alias("_k"), "_first"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_text_key") == F.col("_k")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (F.when(trimmed == "", "blank").when(F.col("_at") > F.col("_first"), "duplicate")
             .when(~F.substring(trimmed, -1, 1).isin(*".!?"), "truncated"))
    return cut(rows.select("conv_id", "turn", "role", "text", "_at", fault.alias("fault")))


def _joined(left: DataFrame, right: DataFrame, *on: str, how: str = "left") -> DataFrame:
    """Join with null-safe keys; the keys of ``left`` stay."""
    r = right.select(*[F.col(c).alias(f"_{c}_2") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}_2"))
    return left.join(r, cond, how).drop(*[f"_{c}_2" for c in on])


def counts(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For each original conversation: rows, gaps and faults after damage."""
    fault = lambda name: F.coalesce(F.sum((F.col("fault") == name).cast("long")), F.lit(0))
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), *[fault(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    per = turns.groupBy("conv_id").agg(
        F.sum("n").alias("_rows"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("_rows", "gaps", "blank", "duplicate", "truncated")]
    return _joined(conversations.select("conv_id").distinct(), per, "conv_id").select("conv_id", *zero)


def repaired(rows: DataFrame, per: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cheapest repair of each conversation of ``rows`` (see `with_faults`):
    conv_id, illegal, cost, audit, repaired_sha256. ``per`` has its ``_rows``."""
    initial = F.when(F.col("role") == "", "e").when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    state = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("k")
    rows = rows.withColumn("block", F.floor(F.col("_at") / block).cast("long"))
    codes = rows.select("conv_id", "block", F.struct("_at", initial.alias("i"), state.alias("f")).alias("c"))
    codes = codes.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("c")).alias("c"))  # at most a block of characters
    codes = codes.select("conv_id", "block", F.array_join("c.i", "").alias("initials"), F.array_join("c.f", "").alias("faults"))
    codes = _joined(codes, per.select("conv_id", "_rows"), "conv_id")
    codes = cut(codes.withColumn("last", (F.col("block") + 1) * block >= F.col("_rows")).drop("_rows"))
    kind = dict(rows.dtypes)["conv_id"]
    long = codes.where(~(F.col("last") & (F.col("block") == 0)))
    own = f"conv_id {kind}, block long"
    costs = long.mapInArrow(_transfers, f"{own}, costs array<long>, initials string, faults string, last boolean")
    exits = (costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
             .mapInArrow(_prices, f"{own}, exits array<long>"))
    codes = _joined(codes, exits, "conv_id", "block")
    traces = cut(codes.mapInArrow(_traces, f"{own}, paths array<string>, states array<int>, cost long"))
    traces = traces.withColumn("_at", F.col("block") * block).drop("block")
    rows = _joined(rows.select("conv_id", "_at", "role", "text"), traces, "conv_id", "_at")
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "_at").select("conv_id", "role", "text", "paths", "states", "cost")
            .mapInArrow(_repairs, f"conv_id {kind}, illegal long, cost long, audit string, repaired_sha256 string"))


def audit_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage ``conversations`` (conv_id, turn, role, text) and repair them:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 for each original conversation."""
    rows = with_faults(damaged(conversations))
    per = cut(counts(conversations, rows))
    out = _joined(per, repaired(rows, per, block), "conv_id")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("illegal", "cost")]
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
