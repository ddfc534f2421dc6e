"""Conversations made to alternate again at the least cost, by divide and conquer over four states.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant; while it is read it is
in one of four states: nothing yet, after system, after user, after assistant. Each row may be kept, given the other role or
deleted, and empty turns may be put in between. A piece of a conversation is a table of what it costs to come from one state
to another, and of the order of the cheapest edits as text; two pieces join to one such table.

Hirschberg's scheme finds the edits: cost vectors of four states run forward over the first half and backward over the
second and meet in the middle; of the crossings of least total cost the one whose edits read least is taken, and both
halves are solved alone, with their ends given. It is used twice: over the pieces of a conversation, which a range
partitioning cuts so that no task holds more than its share of a long one, and over the rows of a piece.

Awkward input: nulls in role and text read as one space; such a role can't be kept, such a text is blank. A null turn comes
first. A null conv_id is a conversation. Rows of one turn are in order of role, then of the text's SHA-256, and equal rows are
repeats of the first. A role counts by its first character; one without any can't be kept. Very long texts pass
through whole, one at a time. Conversations without rows give zeros and an empty text's hash. Empty tables give empty
results. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STATES = range(4)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # state after a kept role
PUT = (2, 2, 3, 2)  # state after a turn of the only role, user or assistant, that may follow
ROLE = {2: "user", 3: "assistant"}
START = 0  # the state a conversation starts in
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1  # costs
FAR = 1 << 60
CLASSES = "xsSuUaAoO"  # a row that must go, then initials s, u, a and others; capitals are truncated
Piece = tuple[tuple[int, ...], tuple[int, ...]]  # cost and rank of (from, to), at 4 * from + to


def _after(state: int, count: int) -> int:
    for _ in range(count):
        state = PUT[state]
    return state


def row_edits(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of one row, those that read least among equals, by (state before, state after). Inserts come before the row."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for state in STATES:
        for inserts in range(3):  # a third insert only comes back to a state that fewer reach
            at = _after(state, inserts)
            options = [(DELETE, "D", at)]
            if kind != "x":
                extra = TRUNCATED * kind.isupper()
                options.append((REROLE + extra, "R", PUT[at]))
                if (at, kind.lower()) in KEPT:
                    options.append((extra, "K", KEPT[at, kind.lower()]))
            for cost, letter, to in options:
                told = (cost + INSERT * inserts, "I" * inserts + letter)
                out[state, to] = min(out.get((state, to), told), told)
    return out


EDITS = {kind: row_edits(kind) for kind in CLASSES}
ENDING = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}  # what makes a state one to end in


def _ranked(by_state: dict[int, tuple]) -> dict[int, int]:
    """Place of each state in the order of its edits; no edits begin with another state's, as both end with the same row."""
    return {state: n for n, state in enumerate(sorted(by_state, key=by_state.__getitem__))}


def _piece(kind: str) -> Piece:
    cost, rank = [FAR] * 16, [0] * 16
    for state in STATES:
        texts = {to: edits for (start, to), (_, edits) in EDITS[kind].items() if start == state}
        for to, place in _ranked(texts).items():
            cost[4 * state + to], rank[4 * state + to] = EDITS[kind][state, to][0], place
    return tuple(cost), tuple(rank)


ROWS: dict[str, Piece] = {kind: _piece(kind) for kind in CLASSES}
Front = tuple[tuple[int, ...], tuple[int, ...]]  # cost and rank by state


def start_at(state: int) -> Front:
    return tuple(0 if s == state else FAR for s in STATES), (0, 0, 0, 0)


@lru_cache(maxsize=1 << 16)
def _step(front: Front, piece: Piece) -> tuple[Front, int]:
    (cost, rank), (across, order) = front, piece
    best: dict[int, tuple[int, int, int]] = {}
    for state in STATES:
        if cost[state] < FAR:
            for to in STATES:
                if across[4 * state + to] < FAR:
                    told = (cost[state] + across[4 * state + to], rank[state], order[4 * state + to])
                    if to not in best or told < best[to]:
                        best[to] = told
    places = _ranked({to: told[1:] for to, told in best.items()})
    least = min(told[0] for told in best.values())
    return (tuple(best[to][0] - least if to in best else FAR for to in STATES), tuple(places.get(to, 0) for to in STATES)), least


def forward(front: Front, pieces: list[Piece]) -> tuple[Front, int]:
    """Costs and ranks behind the last piece, and what was taken off all costs on the way to keep them small."""
    taken = 0
    for piece in pieces:
        front, least = _step(front, piece)
        taken += least
    return front, taken


@lru_cache(maxsize=1 << 16)
def _step_back(cost: tuple[int, ...], piece: Piece) -> tuple[int, ...]:
    across = piece[0]
    before = [min(FAR, min(across[4 * state + to] + cost[to] for to in STATES)) for state in STATES]
    least = min(before)
    return tuple(c - least if c < FAR else FAR for c in before)


def backward(cost: tuple[int, ...], pieces: list[Piece]) -> tuple[int, ...]:
    """What the pieces cost from each state on, less a common amount."""
    for piece in reversed(pieces):
        cost = _step_back(cost, piece)
    return cost


def joined(pieces: list[Piece]) -> Piece:
    """The table of several pieces in a row."""
    cost, rank = [FAR] * 16, [0] * 16
    for state in STATES:
        (least, order), taken = forward(start_at(state), pieces)
        cost[4 * state : 4 * state + 4] = [c + taken if c < FAR else FAR for c in least]
        rank[4 * state : 4 * state + 4] = order
    return tuple(cost), tuple(rank)


def _least(front: Front, behind: tuple[int, ...]) -> int:
    """The crossing of least cost; of several, the one whose edits so far read least."""
    return min(STATES, key=lambda s: (min(FAR, front[0][s] + behind[s]), front[1][s]))


def last_state(pieces: list[Piece]) -> int:
    """State in which the cheapest edits that read least leave the last row of a conversation."""
    front, _ = forward(start_at(START), pieces)
    return _least(front, tuple(ENDING[s][0] for s in STATES))


def crossings(pieces: list[Piece], enter: int, leave: int) -> list[int]:
    """The state between each two pieces, by halves: space for the states and two vectors, never a table of all of them."""
    states = [0] * (len(pieces) + 1)
    states[0], states[-1] = enter, leave
    open_ = [(0, len(pieces))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        front, _ = forward(start_at(states[low]), pieces[low:middle])
        behind = backward(start_at(states[high])[0], pieces[middle:high])
        states[middle] = _least(front, behind)
        open_ += [(low, middle), (middle, high)]
    return states


def edits(kinds: str, enter: int, leave: int) -> list[str]:
    """Edits of each row between two given states."""
    states = crossings([ROWS[k] for k in kinds], enter, leave)
    return [EDITS[k][a, b][1] for k, a, b in zip(kinds, states, states[1:], strict=False)]


# On the cluster


def _facts(turns: DataFrame) -> DataFrame:
    """Per row: conv_id, turn, role, digest, blank, ends (not truncated), text."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ends"), text.alias("text"),
    )


def _kinds(facts: DataFrame) -> DataFrame:
    """Different rows of each conversation: conv_id, turn, role, digest, n (equal rows), kind.

    Only digests move. Equal rows go together before they are dealt, so a row that repeats without end is one row.
    """
    rows = facts.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("ends").alias("ends"))
    rows = stored(rows, "turns")
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    seen = rows.join(first, same).withColumn("again", ~F.col("_first.turn").eqNullSafe(F.col("turn")))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("blank") | F.col("again"), "x").when(F.col("ends"), letter).otherwise(F.upper(letter))
    return seen.select("conv_id", "turn", "role", "digest", "n", "blank", "again", kind.alias("kind"))


_PIECE = "conv_id {id}, part int, kinds string, copies array<long>, blank long, duplicate long, truncated long"


def _pieces(kinds: DataFrame, id_type: str) -> DataFrame:
    """Rows in order, cut where range partitions end: conv_id, part, kinds, copies and counts, one row per conversation and partition."""
    ordered = kinds.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")

    def counts(held: list[tuple[int, bool, str]]) -> tuple:
        blank = sum(n for n, empty, _ in held if empty)
        # Repeats of a row that isn't blank are duplicates, the first of them only where it was seen in an earlier turn.
        again = sum(n - (kind != "x") for n, empty, kind in held if not empty)
        return "".join(kind for _, _, kind in held), [n for n, _, _ in held], blank, again, sum(kind.isupper() for _, _, kind in held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, str]] = []
        now = part = id_kind = None
        for batch in batches:
            id_kind, out = batch.schema.field("conv_id").type, []
            for conv, number, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "n", "blank", "kind")), strict=True):
                if held and conv != now:
                    out.append((now, part, *counts(held)))
                    held = []
                now, part = conv, number
                held.append(tuple(row))
            if out:
                yield _packed(out, id_kind)
        if held:
            yield _packed([(now, part, *counts(held))], id_kind)

    tagged = ordered.select("conv_id", F.spark_partition_id().alias("part"), "n", "blank", "kind")
    return stored(tagged.mapInArrow(pack, _PIECE.format(id=id_type)), "pieces")


def _packed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "part", "kinds", "copies", "blank", "duplicate", "truncated"])


def _plans(pieces: DataFrame, id_type: str) -> DataFrame:
    """Edits of each piece: conv_id, part, plan, cost, and the counts.

    Each piece becomes a table of sixteen costs; a conversation's tables, one per range partition it reaches, meet in one
    place and give every piece the states at its ends; the pieces are then solved apart from each other.
    """

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [joined([ROWS[k] for k in kinds]) for kinds in batch.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("part"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                names=["conv_id", "part", "cost", "rank"],
            )

    tables = pieces.select("conv_id", "part", "kinds").mapInArrow(table, f"conv_id {id_type}, part int, cost array<long>, rank array<long>")
    lists = tables.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "cost", "rank"))).alias("tables"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: list[list] = [[], [], [], [], []]
            for conv, tables in zip(batch.column("conv_id").to_pylist(), batch.column("tables").to_pylist(), strict=True):
                found = [(tuple(t["cost"]), tuple(t["rank"])) for t in tables]
                states = crossings(found, START, last_state(found))
                for column, values in zip(ends, ([conv] * len(found), [t["part"] for t in tables], states, states[1:], [i == len(found) - 1 for i in range(len(found))]), strict=True):
                    column.extend(values[: len(found)])
            types = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ends, types, strict=True)], names=["_conv", "_part", "enter", "leave", "last"])

    ends = lists.mapInArrow(meet, f"_conv {id_type}, _part int, enter int, leave int, last boolean")
    bound = pieces.join(ends, pieces["conv_id"].eqNullSafe(ends["_conv"]) & (pieces["part"] == ends["_part"])).drop("_conv", "_part")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans, costs = [], []
            for kinds, copies, enter, leave, last in zip(*(batch.column(c).to_pylist() for c in ("kinds", "copies", "enter", "leave", "last")), strict=True):
                letters = edits(kinds, enter, leave)
                ending = ENDING[leave] if last else (0, "")
                # Repeats of a row follow it and must go.
                plans.append("".join(e + "D" * (n - 1) for e, n in zip(letters, copies, strict=True)) + ending[1])
                text = plans[-1]
                kept = sum(TRUNCATED for k, e in zip(kinds, letters, strict=True) if k.isupper() and e[-1] != "D")
                costs.append(DELETE * text.count("D") + REROLE * text.count("R") + INSERT * text.count("I") + kept)
            names = ["conv_id", "part", "blank", "duplicate", "truncated"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(plans, pa.string()), pa.array(costs, pa.int64())], names=[*names, "plan", "cost"])

    return bound.mapInArrow(plan, f"conv_id {id_type}, part int, blank long, duplicate long, truncated long, plan string, cost long")


class _Reader:
    """One conversation read in order: counts, and the repaired text's hash as it grows."""

    def __init__(self, conv: object):
        self.conv, self.plan, self.at, self.state = conv, [], 0, START
        self.counts, self.digest, self.lines = [0, 0, 0, 0], hashlib.sha256(), 0
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def told(self, plan: str, counts: list[int]) -> None:
        self.plan.append(plan)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def write(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.text) and self.text[self.at] == "I":
            self.state = PUT[self.state]
            self.write(ROLE[self.state], "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if self.at == 0 and self.initial is None:
            self.text = "".join(self.plan)
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.turn = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.inserts()
        edit = self.text[self.at]
        self.at += 1
        if edit == "R":
            self.state = PUT[self.state]
            self.write(ROLE[self.state], text)
        elif edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self.write(role, text)

    def result(self) -> tuple:
        self.text = "".join(self.plan)
        self.inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.counts[:3], self.illegal, self.counts[3], self.text, self.digest.hexdigest()


RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role, text. `conversations` (conv_id) lists those to report, also where they have no turns left.
    The texts move once, dealt by conversation and read in order, one row at a time: a hash of a whole text has to be made in
    one place, but nothing of the text is held there.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    facts = _facts(turns)
    plans = _plans(_pieces(_kinds(facts), id_type), id_type)
    asked = (turns if conversations is None else conversations).select("conv_id").distinct()
    no = {c: F.lit(None) for c in ("turn", "role", "digest", "text", "part", "plan", "blank", "duplicate", "truncated", "cost")}

    def shaped(df: DataFrame, step: int, **own: Column) -> DataFrame:
        kinds = {"turn": "long", "part": "int", "blank": "long", "duplicate": "long", "truncated": "long", "cost": "long"}
        return df.select("conv_id", F.lit(step).alias("step"), *[(own[c] if c in own else no[c]).cast(kinds.get(c, "string")).alias(c) for c in no])

    column = lambda *names: {c: F.col(c) for c in names}
    everything = (
        shaped(asked, 0)
        .unionByName(shaped(plans, 1, **column("part", "plan", "blank", "duplicate", "truncated", "cost")))
        .unionByName(shaped(facts, 2, **column("turn", "role", "digest", "text")))
    )
    ordered = everything.repartition("conv_id").sortWithinPartitions("conv_id", "step", "part", "turn", "role", "digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, id_kind = None, None
        for batch in batches:
            id_kind, out = batch.schema.field("conv_id").type, []
            columns = [batch.column(c) for c in ("conv_id", "step", "plan", "blank", "duplicate", "truncated", "cost", "turn", "role", "text")]
            for i in range(batch.num_rows):
                conv, step, plan, *counts = (c[i].as_py() for c in columns[:7])
                if reader is None or conv != reader.conv:
                    if reader:
                        out.append(reader.result())
                    reader = _Reader(conv)
                if step == 1:
                    reader.told(plan, counts)
                elif step == 2:
                    reader.row(*(c[i].as_py() for c in columns[7:]))
            if out:
                yield _told(out, id_kind)
        if reader:
            yield _told([reader.result()], id_kind)

    return ordered.mapInArrow(read, RESULT.format(id=id_type))


def _told(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
