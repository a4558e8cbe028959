"""Minimum-cost role repair of conversations (operator 3).

Legal conversations: an optional system turn, then user and assistant in turn, first a
user, last an assistant.  A turn may keep its role or be relabelled, and may be merged into
the turn before it; empty turns may be inserted.  Dynamic programming over the states
start, system, user, assistant finds the cheapest repair; ties go to fewer insertions, then
relabels, then merges, then to the first choice in state order.

Turns are dealt out by range and sorted, never gathered by conversation.  A conversation
inside one task is solved there.  One that is long or cut by a range is solved in blocks of
at most ``BLOCK`` turns: each block's costs between states form a min-plus matrix, matrices
are chained per conversation, and then the blocks are solved between known states.

``repair`` gives one row per turn piece in the order (block, pos), ``render`` the sequence that
the pieces of a conversation make up, one row each (a longer one, or one cut by a range, in
blocks of at most ``BLOCK`` turns to be read in order).  A control marker inside a text is
written with a backslash behind its first character, and one more where there are some, so
rendered text holds no markers but its own and can be turned back.  Defined results: turns are ordered by turn, role
and text, null first; a null or unknown role is relabelled; a null text is empty; a null
conv_id is a conversation like any other; repeated rows are turns of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytetext import tidy
from spanforge.llm.storage import dropped, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs, scaled so that a sum of ties is broken by count: insertions, relabels, merges.
UNIT = 1_000_000_000
MERGE, RELABEL, INSERT = UNIT + 1, 3 * UNIT + 1_000, 2 * UNIT + 1_000_000
FAR = np.int64(2**61)
BLOCK = 1024
_MARKER = re.compile(r"<(\\*)\|(im_start|im_end)\|>")


def _moves() -> dict[str, list[tuple[int, int, int, bool, int, tuple[int, ...]]]]:
    """Per role: (from, to, cost, merged, label, inserted states) of every single-turn step."""
    out = {}
    for role in (*ROLES, ""):
        steps = []
        for state in range(4):
            for label in (SYSTEM, USER, ASSISTANT):
                extra = 0 if role == ROLES[label - 1] else RELABEL
                if label == state:
                    steps.append((state, label, extra + MERGE, True, label, ()))
                if label in NEXT[state]:
                    steps.append((state, label, extra, False, label, ()))
                for gap in NEXT[state]:
                    if gap != SYSTEM and label in NEXT[gap]:
                        steps.append((state, label, extra + INSERT, False, label, (gap,)))
        out[role] = steps
    return out


MOVES = _moves()
#: Empty turns that complete a conversation from each state.
ENDING = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _known(role: str | None) -> str:
    return role if role in ROLES else ""


def solve(roles: list[str | None], entry: int = START, leave: int | None = None) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(label, merged, inserted before) of each turn on the cheapest path from entry.

    Without leave, the path may end anywhere and pays for the empty turns that complete it.
    """
    cost = [int(FAR)] * 4
    cost[entry] = 0
    trail = []
    for role in roles:
        best, via = [int(FAR)] * 4, [None] * 4
        for step in MOVES[_known(role)]:
            c = cost[step[0]] + step[2]
            if c < best[step[1]]:
                best[step[1]], via[step[1]] = c, step
        cost = best
        trail.append(via)
    if leave is None:
        leave = min((s for s in ENDING), key=lambda s: (cost[s] + INSERT * len(ENDING[s]), s))
    out = []
    for via in reversed(trail):
        step = via[leave]
        out.append((step[4], step[3], step[5]))
        leave = step[0]
    return out[::-1]


def matrix(roles: list[str | None]) -> np.ndarray:
    """Cheapest cost between all states over these turns."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for role in roles:
        step = np.full((4, 4), FAR)
        for a, b, c, *_ in MOVES[_known(role)]:
            step[a, b] = min(step[a, b], c)
        m = times(m, step)
    return m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product: cheapest costs over one stretch of turns and the next."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def chain(matrices: list[np.ndarray], entry: int = START, leave: int | None = None) -> list[tuple[int, int]]:
    """(state before, state after) of each stretch on the cheapest path through all of them.

    Without leave, the path may end anywhere and pays for the empty turns that complete it.
    """
    cost = [np.where(np.arange(4) == entry, 0, FAR)]
    for m in matrices:
        cost.append(np.minimum((cost[-1][:, None] + m).min(0), FAR))
    state = min((s for s in ENDING), key=lambda s: (int(cost[-1][s]) + INSERT * len(ENDING[s]), s)) if leave is None else leave
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = int((cost[k] + matrices[k][:, state]).argmin())
        out.append((before, state))
        state = before
    return out[::-1]


def escaped(text: str) -> str:
    """A text without control markers of its own; unescaped() gives it back."""
    return _MARKER.sub(r"<\\\1|\2|>", text) if "|im_" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|(im_start|im_end)\|>", r"<\1|\2|>", text)


def pieces(turns: list[tuple], entry: int, leave: int | None, last: bool) -> Iterator[dict]:
    """Output rows of (turn, role, text) turns between two states."""
    path = solve([t[1] for t in turns], entry, leave)
    first = entry == START
    head = lambda state: f"<|im_start|>{ROLES[state - 1]}\n"
    close = "<|im_end|>\n"
    pos = 0
    for (turn, role, text), (label, merged, gaps) in zip(turns, path, strict=True):
        for gap in gaps:
            yield {"pos": pos, "turn": None, "role": None, "new_role": ROLES[gap - 1], "action": "insert", "text": "", "rendered": ("" if first else close) + head(gap)}
            first, pos = False, pos + 1
        kept = role == ROLES[label - 1]
        action = ("merge" if kept else "relabel+merge") if merged else ("keep" if kept else "relabel")
        yield {"pos": pos, "turn": turn, "role": role, "new_role": ROLES[label - 1], "action": action, "text": text or "", "rendered": ("\n" if merged else ("" if first else close) + head(label)) + escaped(text or "")}
        first, pos = False, pos + 1
    if last:
        state = path[-1][0]
        for gap in ENDING[state]:
            yield {"pos": pos, "turn": None, "role": None, "new_role": ROLES[gap - 1], "action": "insert", "text": "", "rendered": close + head(gap)}
            pos += 1
        yield {"pos": pos, "turn": None, "role": None, "new_role": None, "action": "end", "text": "", "rendered": close}


_FIELDS = [("conv_id", pa.int64()), ("block", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("text", pa.string()), ("rendered", pa.string())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "conv_id long, block long, pos long, turn long, role string, new_role string, action string, text string, rendered string"


def _solved_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted turns: whole conversations are solved; open ones pass with their block.

    Rows that pass have a null action and pos as their place in the block.
    """
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    seq, outer = 0, True  # the first and the last conversation may reach into other tasks
    held: list[tuple] = []
    current: object = ()
    open_ = False
    out: list[dict] = []

    def flush(still_open: bool) -> None:
        nonlocal held, seq
        if not held:
            return
        if still_open:
            out.extend({"conv_id": current, "block": base + seq, "pos": i, "turn": t, "role": r, "text": x} for i, (t, r, x) in enumerate(held))
        else:
            out.extend({"conv_id": current, "block": base + seq} | p for p in pieces(held, START, None, True))
        held, seq = [], seq + 1

    for b in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != current or isinstance(current, tuple):
                if not isinstance(current, tuple):
                    flush(open_ or outer)
                    outer = False
                current, open_ = conv, False
            elif len(held) >= BLOCK:
                open_ = True
                flush(True)
            held.append((turn, role, text))
            if len(out) >= 2048:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out = []
    flush(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, block, pos, turn, role, new_role, action, text, rendered."""
    src = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # Equal rows are told apart by a number, or any count of them would be one range.
    dealt = src.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "role", "text", "row").sortWithinPartitions("conv_id", "turn", "role", "text").drop("row")
    rows = written(dealt.mapInArrow(tidy(_solved_here), _DDL), "turns")
    done = rows.where("action IS NOT NULL")
    loose = rows.where("action IS NULL").select("conv_id", "block", "pos", "turn", "role", "text")

    def costs(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "block": t.column("block").slice(0, 1), "m": pa.array([matrix(t.column("role").to_pylist()).ravel().tolist()], pa.list_(pa.int64()))})

    square = lambda t: [np.array(m).reshape(4, 4) for m in t.column("m").to_pylist()]
    flags = lambda states, last: {"entry": pa.array([a for a, _ in states], pa.int32()), "leave": pa.array([b for _, b in states], pa.int32()), "last": pa.array([False] * (len(states) - 1) + [last])}

    def product(t: pa.Table) -> pa.Table:
        whole = reduce(times, square(t.sort_by("block")))
        return pa.table({"conv": t.column("conv").slice(0, 1), "part": t.column("part").slice(0, 1), "m": pa.array([whole.ravel().tolist()], pa.list_(pa.int64()))})

    def chained(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"conv": t.column("conv"), "part": t.column("part")} | flags(chain(square(t)), True))

    def inside(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        one = lambda c: t.column(c)[0].as_py()
        return pa.table({"block": t.column("block")} | flags(chain(square(t), one("entry"), one("leave")), one("last")))

    def solved(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        one = lambda c: t.column(c)[0].as_py()
        got = [{"conv_id": one("conv_id"), "block": one("block")} | p for p in pieces(list(zip(*(t.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True)), one("entry"), one("leave"), one("last"))]
        return pa.Table.from_pylist(got, _SCHEMA)

    # The upper half of a block's number is its range; a conversation without id is one as well.
    blocks = loose.select("conv_id", "block", "pos", "role").groupBy("block").applyInArrow(costs, "conv_id long, block long, m array<long>")
    blocks = written(blocks.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"), F.shiftright("block", 32).alias("part"), "block", "m"), "blocks")
    ranges = blocks.groupBy("conv", "part").applyInArrow(product, "conv string, part long, m array<long>")
    ends = ranges.groupBy("conv").applyInArrow(chained, "conv string, part long, entry int, leave int, last boolean")
    ways = blocks.join(ends, ["conv", "part"]).groupBy("conv", "part").applyInArrow(inside, "block long, entry int, leave int, last boolean")
    ways = written(ways, "ways")
    dropped(blocks)
    rest = loose.join(ways, "block").groupBy("block").applyInArrow(solved, _DDL)
    return done.unionByName(rest)


def render(repaired: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, n_inserted, n_relabelled, n_merged, rendered: one sequence a conversation, long ones by block."""
    said = F.col("action")
    part = F.array_sort(F.collect_list(F.struct("pos", "rendered")))
    return repaired.groupBy("conv_id", "block").agg(
        F.count_if(~said.isin("insert", "end")).alias("n_turns"), F.count_if(said == "insert").alias("n_inserted"), F.count_if(said.startswith("relabel")).alias("n_relabelled"),
        F.count_if(said.endswith("merge")).alias("n_merged"), F.array_join(F.transform(part, lambda p: p["rendered"]), "").alias("rendered"),
    )
