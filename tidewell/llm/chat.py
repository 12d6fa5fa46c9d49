"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton, then rendering.

A legal conversation is at most one system turn, then user and assistant turns in alternation, the user first. Each
given turn keeps its role or is relabelled, and becomes a new turn or is merged into the one before of the same role;
an empty turn of the other role may be inserted before it. The cheapest way is a shortest path over the automaton's
states, so a stretch of turns is a small matrix of costs between states, and matrices multiply (minimum, plus). Turns are
dealt by ranges of (conversation, turn); a conversation inside one range is solved there, one that spans several ranges,
however long, is solved from its stretches' matrices and then rendered stretch by stretch. Each given turn yields one row;
the `fragment`s of a conversation, in order, concatenate to its rendering.

A turn's text can't forge a turn: in it `<|` is written `<\\|` (and `<\\` as `<\\\\`), which `unescaped` undoes.

Edge cases: a null or unknown role must be relabelled; null text is empty; turns are ordered by turn (null first), then
role and text, so repeated rows are turns next to each other; a null conversation is one of its own; equally cheap ways
are told apart by a fixed hash, so results don't depend on how rows are dealt; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import _shuffle

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: States: nothing yet, then the role of the last turn. What may follow each.
START = 3
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ENDS = (1, 2)
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = (1 << 60, 0)
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def escaped(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\([\\|])", r"<\1", text)


def given_role(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def ways(state: int, role: int) -> Iterator[tuple[tuple[int, int], int, str, int]]:
    """(cost and tie-break, new state, way, inserted role or -1) for a turn of this role after this state."""
    for to in range(3):
        base = 0 if to == role else RELABEL
        if to in FOLLOWS[state]:
            yield (base, 0), to, "new", -1
        elif to == state:
            yield (base + MERGE, 0), to, "merge", -1
        else:
            between = [m for m in FOLLOWS[state] if to in FOLLOWS[m]]
            if between:
                yield (base + INSERT, 0), to, "insert", between[0]


WAYS = {(s, r): list(ways(s, r)) for s in range(4) for r in range(-1, 3)}


def plus(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + b[0], a[1] + b[1]


def tie(key: bytes, state: int, to: int) -> int:
    """A fixed number for a step, by which equally cheap ways differ."""
    return zlib.crc32(bytes([state, to]), zlib.crc32(key)) >> 6


def forward(turns: list[tuple], cost: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[list]]:
    """Costs of the states after these turns, from costs before, and the steps back from each state after each turn."""
    back = []
    for key, role, _ in turns:
        after, steps = [NEVER] * 4, [None] * 4
        for s in range(4):
            if cost[s][0] < NEVER[0]:
                for c, to, way, put in WAYS[s, role]:
                    total = plus(plus(cost[s], c), (0, tie(key, s, to)))
                    if total < after[to]:
                        after[to], steps[to] = total, (s, way, put)
        cost = after
        back.append(steps)
    return cost, back


def end_cost(state: int) -> tuple[int, int]:
    """What it takes to end here; a lone system turn needs an empty user turn."""
    return (0, 0) if state in ENDS else (INSERT, 0) if state == 0 else NEVER


def trace(back: list[list], state: int) -> list[tuple[int, str, int]]:
    """(role, way, inserted role) of each turn on the cheapest way to this state."""
    out = []
    for steps in reversed(back):
        s, way, put = steps[state]
        out.append((state, way, put))
        state = s
    return out[::-1]


def fragments(turns: list[tuple], path: list[tuple[int, str, int]], begins: bool, ends: bool) -> Iterator[tuple[str, str, str]]:
    """(role, way, fragment) of each turn; a turn is closed by the next one that is not merged into it, or by the end."""
    for i, ((_, role, text), (to, way, put)) in enumerate(zip(turns, path)):
        out = ""
        if way == "merge":
            out += "\n"
        else:
            if not (begins and i == 0):
                out += CLOSE
            if put >= 0:
                out += OPEN.format(ROLES[put]) + CLOSE
            out += OPEN.format(ROLES[to])
        out += escaped(text)
        if ends and i == len(turns) - 1:
            out += CLOSE
            if to == 0:
                out += OPEN.format(ROLES[1]) + CLOSE
        yield ROLES[to], ("relabel+" if to != role else "") + way, out


ROWS = "conv_id long, turn long, role string, text string, stretch int"
OUT = "conv_id long, turn long, given_role string, role string, action string, cost long, fragment string"


def _turns(rows: list[tuple]) -> list[tuple]:
    """(key, role, text); the key tells the turn in its conversation, whatever range it is in."""
    return [(f"{conv}/{turn}/{role}".encode(), given_role(role), text or "") for conv, turn, role, text, *_ in rows]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of ROWS and what follows them, as tuples, a stretch of a conversation at a time."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    for key, group in groupby(rows, lambda r: (r[0], r[4])):
        yield key, list(group)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in OUT.split(", ")])


def _rendered(rows: list[tuple], turns: list[tuple], path: list, begins: bool, ends: bool, cost: int) -> pa.RecordBatch:
    return _emit([(r[0], r[1], r[2], role, way, cost, f) for r, (role, way, f) in zip(rows, fragments(turns, path, begins, ends))])


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each given turn: its role and action in the cheapest repair, the conversation's cost, and its fragment."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("stretch", F.spark_partition_id())
    rows = _shuffle.cut(rows)  # ranges stay as they are
    parts = rows.groupBy("conv_id").agg(F.min("stretch").alias("first"), F.max("stretch").alias("last"))
    # a conversation over two ranges or more ends one of them, so there are fewer of these than ranges
    split = F.broadcast(parts.filter("last > first"))
    whole = rows.join(split.select("conv_id").withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    long_ = rows.join(split.select(F.col("conv_id").alias("_c"), "first", "last"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _stretches(batches):
            turns = _turns(own)
            cost, back = forward(turns, [NEVER] * 3 + [(0, 0)])
            total, state = min((plus(cost[s], end_cost(s)), s) for s in range(3))
            yield _rendered(own, turns, trace(back, state), True, True, total[0])

    order = ["conv_id", "stretch", "turn", "role", "text"]
    by_stretch = ["conv_id", "stretch"]
    columns = ["conv_id", "turn", "role", "text", "stretch"]
    done = whole.select(*columns).mapInArrow(solve, OUT)  # in the order that the checkpoint holds

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, stretch), own in _stretches(batches):
            turns = _turns(own)
            cells = [forward(turns, [(0, 0) if s == t else NEVER for t in range(4)])[0] for s in range(4)]
            flat = [c for row in cells for c in row]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([stretch], pa.int32()), pa.array([[c[0] for c in flat]], pa.list_(pa.int64())), pa.array([[c[1] for c in flat]], pa.list_(pa.int64()))], names=["conv_id", "stretch", "costs", "ties"])

    long_ = long_.repartition(*by_stretch).sortWithinPartitions(*order)
    cells = long_.select(*columns).mapInArrow(matrix, "conv_id long, stretch int, costs array<long>, ties array<long>")

    def walk(table: pa.Table) -> pa.Table:
        """The states at the ends of each stretch; a conversation has one matrix for each range that it reaches into."""
        own = sorted(table.to_pylist(), key=lambda r: r["stretch"])
        cost, back = [NEVER] * 3 + [(0, 0)], []
        for r in own:
            after, from_ = [NEVER] * 4, [None] * 4
            for s in range(4):
                for t in range(4):
                    c = (r["costs"][4 * s + t], r["ties"][4 * s + t])
                    if c[0] < NEVER[0] and cost[s][0] < NEVER[0] and plus(cost[s], c) < after[t]:
                        after[t], from_[t] = plus(cost[s], c), s
            cost = after
            back.append(from_)
        total, state = min((plus(cost[s], end_cost(s)), s) for s in range(3))
        enter, leave = [], []
        for from_ in reversed(back):
            leave.append(state)
            state = from_[state]
            enter.append(state)
        n = len(own)
        return pa.table([pa.array([r["conv_id"] for r in own], pa.int64()), pa.array([r["stretch"] for r in own], pa.int32()), pa.array(enter[::-1], pa.int32()), pa.array(leave[::-1], pa.int32()), pa.array([total[0]] * n, pa.int64())], names=["c", "s", "enter", "leave", "cost"])

    ends = cells.groupBy("conv_id").applyInArrow(walk, "c long, s int, enter int, leave int, cost long")
    known = long_.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).select(*columns, "first", "last", "enter", "leave", "cost")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _stretches(batches):
            turns = _turns(own)
            *_, stretch, first, last, enter, leave, cost = own[0]
            _, back = forward(turns, [(0, 0) if s == enter else NEVER for s in range(4)])
            yield _rendered(own, turns, trace(back, leave), stretch == first, stretch == last, cost)

    return done.unionByName(known.repartition(*by_stretch).sortWithinPartitions(*order).mapInArrow(render, OUT))
