"""Chat formatting with minimum-cost role repair.

Legal conversations: at most one system turn first, then user and assistant turns in alternation, ending with the assistant.
An automaton over the role of the last written turn (nothing, system, user, assistant) reads the given turns; each may keep
its role, be relabelled (cost 2), and either extend the last written turn of that role (merge, cost 1) or start a new one,
before which an empty turn may be inserted (cost 3).  A turn with a role that is none of the three is always relabelled.  At the
end an empty assistant turn may be inserted.  Dynamic programming finds the cheapest repair.  Of several cheapest ones, the first
turn they treat differently decides: keeping goes first, then merging, then the earlier role in the order system, user, assistant.

The cost of reading a stretch of turns is a (min, +) matrix over the automaton's states, and matrices of stretches multiply.  An entry
also tells the place of its way among the ways from the same state, in the order of that rule, so ties are settled alike wherever
a conversation is cut.  So a
conversation is cut into stretches by the rank of its turns: rows are sorted in ranges over all tasks, and the counts of the
ranges before are added, so a stretch has a bounded number of rows whatever the turn numbers are.  Tasks make one matrix per
stretch, then one per block of stretches; the blocks of a conversation fix the states between blocks, these the states
between stretches, and tasks repair each stretch with its ends fixed.  A very long conversation is never one task's group.

Output, one row per written piece: (conv_id, turn, seq, role, action, opens, closes, segment), where the segments of a conversation joined
in (stretch, seq) order give the rendered conversation.  Inserted turns have a null turn.

Defined results: a null role or text counts as an unknown role or the empty text; turns with a null number come first; equal turn
numbers are ordered by role and text, and repeated rows are turns of their own.  Rows with a null conv_id form one
conversation.  An empty table gives no rows.  Only the four columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions_for

# Roles, states (the role of the last written turn) and the costs of the repairs.
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40
STRETCH = 256
BLOCK = 256  # stretches whose matrices are multiplied in one step

# Legal next role of each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def steps() -> dict[int, list[list[tuple[int, int, tuple] | None]]]:
    """For each given role (1-3, 0 unknown): best[state][new state] = (cost, rank, (how, inserted roles))."""
    out = {}
    for given in range(4):
        table: list[list] = [[None] * 4 for _ in range(4)]
        for state in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == given else RELABEL
                ways = []
                if role == state:
                    ways.append((label + MERGE, 1, ("merge", ())))
                if role in NEXT[state]:
                    ways.append((label, 0, ("write", ())))
                for middle in NEXT[state]:
                    if role in NEXT[middle]:
                        ways.append((label + INSERT, 2, ("write", (middle,))))
                    for second in NEXT[middle]:
                        if role in NEXT[second]:
                            ways.append((label + 2 * INSERT, 3, ("write", (middle, second))))
                if ways:
                    cost, rank, how = min(ways, key=lambda w: (w[0], w[1]))
                    table[state][role] = (cost, (label > 0) * 8 + rank, how)
        out[given] = table
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """The place of each value in its row."""
    return x.argsort(axis=-1, kind="stable").argsort(axis=-1)


def _matrices(table) -> np.ndarray:
    """Entries are 4 * cost + place: ways from one state differ in the state they lead to, so four places order them."""
    cost, rank = np.full((4, 4, 4), NEVER, np.int64), np.full((4, 4, 4), 99, np.int64)
    for given, rows in table.items():
        for i in range(4):
            for j in range(4):
                if rows[i][j] is not None:
                    cost[given, i, j], rank[given, i, j] = rows[i][j][:2]
    return cost * 4 + _ranks(rank)


IDENTITY = np.where(np.eye(4, dtype=bool), 0, NEVER) * 4 + np.arange(4)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of a stretch and the one after it: the cheapest way between two states, the first in order of several."""
    best = (((a // 4)[:, :, None] + (b // 4)[None]) * 16 + (a % 4)[:, :, None] * 4 + (b % 4)[None]).min(axis=1)
    return np.minimum(best // 16, NEVER) * 4 + _ranks(best % 16)


def stretch_matrix(given: list[int], matrices: np.ndarray, memo: dict) -> np.ndarray:
    """The matrix over a run of given roles.

    Less their least cost, few different matrices arise, as a few repairs lead from any state to any other.  ``memo`` holds the
    products met so far, so a turn costs one look-up.
    """
    key, total = IDENTITY.tobytes(), 0
    for g in given:
        step = memo.get((key, g))
        if step is None:
            m = compose(np.frombuffer(key, np.int64).reshape(4, 4), matrices[g])
            low = int(m.min()) // 4
            step = memo[key, g] = (np.where(m >= 4 * NEVER, m, m - 4 * low).tobytes(), low)
        key = step[0]
        total += step[1]
    m = np.frombuffer(key, np.int64).reshape(4, 4)
    return np.where(m >= 4 * NEVER, m, m + 4 * total)


# Finishing from each state: (cost, inserted roles).
FINISH = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def choose_states(matrices: list[np.ndarray], first: int = START, last: int | None = None) -> list[int]:
    """The states at the borders of the stretches on the chosen way (from ``first``; to ``last``, or to the conversation's end)."""
    after = [np.array([FINISH[s][0] if last is None else 0 if s == last else NEVER for s in range(4)])]
    for m in reversed(matrices):
        after.append(np.minimum((m // 4 + after[-1][None]).min(axis=1), NEVER))
    after.reverse()
    out = [first]
    for k, m in enumerate(matrices):
        row = m[out[-1]]
        out.append(int((row + 4 * after[k + 1]).argmin()))
    return out


def repair(given: list[int], first: int, last: int, table) -> list[tuple[int, str, tuple]]:
    """For each turn (role, how, inserted roles) on the chosen way between two states."""
    n = len(given)
    best: list[list] = [[None] * 4 for _ in range(n + 1)]
    best[n][last] = (0, 0)
    for k in range(n - 1, -1, -1):
        for s in range(4):
            ways = [(best[k + 1][r][0] + w[0], w[1] + r / 16, r) for r in range(4) if (w := table[given[k]][s][r]) and best[k + 1][r]]
            best[k][s] = (lambda w: (w[0], w[2]))(min(ways)) if ways else None
    out, state = [], first
    for k in range(n):
        role = best[k][state][1]
        _, _, (how, inserted) = table[given[k]][state][role]
        out.append((role, how, inserted))
        state = role
    return out


def render_open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "\n<|end|>\n"
SCHEMA = "conv_id long, stretch long, seq long, turn long, role string, action string, segment string"


def _ranked(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with ``rank``, their place in their conversation in the order of turn, role and text."""
    order = ("conv_id", "turn", "was", "text", "salt")  # equal rows are alike, so a salt may part them

    def place(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            at = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if (conv,) == last else 0
                last = (conv,)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())],
                                             names=[*batch.schema.names, "part", "at"])

    placed = (rows.withColumn("salt", F.rand(1)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .select("conv_id", "given", "turn", "text")
              .mapInArrow(place, "conv_id long, given int, turn long, text string, part int, at long"))
    placed = cut_lineage(placed, "ranked-turns")
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = (counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"),
                            (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
              .where("before > 0"))  # at most one conversation a part has begun in another
    return (placed.join(F.broadcast(before), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
            .select("conv_id", "given", "turn", "text", (F.col("at") + F.coalesce("before", F.lit(0))).alias("rank")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 stretch: int = STRETCH) -> DataFrame:
    """One row per given or inserted turn: (conv_id, stretch, seq, turn, role, action, segment)."""
    code = F.coalesce(*[F.when(F.lower(F.trim(F.col(role_col))) == r, k + 1) for k, r in enumerate(ROLES)], F.lit(0))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), code.alias("given"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("was"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = partitions_for(turns)
    rows = _ranked(rows, parts).withColumn("stretch", F.floor(F.col("rank") / stretch).cast("long"))
    table = steps()
    matrices = _matrices(table)
    keys = ("conv_id", "stretch")

    def grouped(batches, fields, settle):
        head, found = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(fields)))):
                if row[:2] != head:
                    if found:
                        yield settle(head, found)
                    head, found = row[:2], []
                found.append(row[2:])
        if found:
            yield settle(head, found)

    def measure(batches) -> Iterator[pa.RecordBatch]:
        memo: dict = {}

        def settle(head, found):
            m = stretch_matrix([g for (g,) in found], matrices, memo)
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([head[0]], pa.int64()), "stretch": pa.array([head[1]], pa.int64()),
                                               "matrix": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

        yield from grouped(batches, ("conv_id", "stretch", "given"), settle)

    ordered = rows.select(*keys, "rank", "given").repartition(parts, *keys).sortWithinPartitions(*keys, "rank")
    measured = cut_lineage(ordered.select(*keys, "given").mapInArrow(measure, "conv_id long, stretch long, matrix array<long>"), "chat-matrices")
    measured = measured.withColumn("block", F.floor(F.col("stretch") / BLOCK).cast("long"))

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        def settle(head, found):
            m = IDENTITY
            for (x,) in found:
                m = compose(m, np.array(x).reshape(4, 4))
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([head[0]], pa.int64()), "block": pa.array([head[1]], pa.int64()),
                                               "matrix": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

        yield from grouped(batches, ("conv_id", "block", "matrix"), settle)

    blocks = (measured.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "stretch").select("conv_id", "block", "matrix")
              .mapInArrow(multiply, "conv_id long, block long, matrix array<long>"))

    def walk(batches) -> Iterator[pa.RecordBatch]:
        def settle(conv, found):
            states = choose_states([np.array(m).reshape(4, 4) for _, m in found])
            n = len(found)
            return pa.RecordBatch.from_pydict({
                "c": pa.array([conv[0]] * n, pa.int64()), "s": pa.array([s for s, _ in found], pa.int64()), "entry": pa.array(states[:-1], pa.int32()),
                "leave": pa.array(states[1:], pa.int32()), "final": pa.array([k == n - 1 for k in range(n)], pa.bool_())})

        head, found = None, []
        for batch in batches:
            for conv, s, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (conv,) != head:
                    if found:
                        yield settle(head, found)
                    head, found = (conv,), []
                found.append((s, m))
        if found:
            yield settle(head, found)

    borders = (blocks.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block")
               .mapInArrow(walk, "c long, s long, entry int, leave int, final boolean"))

    def inside(batches) -> Iterator[pa.RecordBatch]:
        def settle(head, found):
            first, last, final = found[0][2:]
            states, n = choose_states([np.array(m).reshape(4, 4) for _, m, *_ in found], first, last), len(found)
            return pa.RecordBatch.from_pydict({
                "c": pa.array([head[0]] * n, pa.int64()), "s": pa.array([f[0] for f in found], pa.int64()), "entry": pa.array(states[:-1], pa.int32()),
                "leave": pa.array(states[1:], pa.int32()), "final": pa.array([final and k == n - 1 for k in range(n)], pa.bool_())})

        yield from grouped(batches, ("conv_id", "block", "stretch", "matrix", "entry", "leave", "final"), settle)

    states = (measured.join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("s")))
              .select("conv_id", "block", "stretch", "matrix", "entry", "leave", "final").repartition(parts, "conv_id", "block")
              .sortWithinPartitions("conv_id", "block", "stretch").mapInArrow(inside, "c long, s long, entry int, leave int, final boolean"))
    states = cut_lineage(states, "chat-states")

    def write(batches) -> Iterator[pa.RecordBatch]:
        def settle(head, found):
            first, last, final = found[0][3:6]
            decided = repair([r[0] for r in found], first, last, table)
            out, state = [], first

            def insert(role):
                nonlocal state
                out.append((None, ROLES[role - 1], "insert", (CLOSE if state != START else "") + render_open(role)))
                state = role

            for (given, turn, text, *_), (role, how, inserted) in zip(found, decided):
                for r in inserted:
                    insert(r)
                action = how if given == role else ("relabel" if how == "write" else "relabel+merge")
                if how == "merge":
                    piece = "\n" + text
                else:
                    piece = (CLOSE if state != START else "") + render_open(role) + text
                out.append((turn, ROLES[role - 1], "keep" if action == "write" else action, piece))
                state = role
            if final:
                for r in FINISH[state][1]:
                    insert(r)
                if out:
                    out[-1] = (*out[-1][:3], out[-1][3] + CLOSE)
            n = len(out)
            cols = list(zip(*out))
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([head[0]] * n, pa.int64()), "stretch": pa.array([head[1]] * n, pa.int64()), "seq": pa.array(range(n), pa.int64()),
                "turn": pa.array(cols[0], pa.int64()), "role": pa.array(cols[1]), "action": pa.array(cols[2]), "segment": pa.array(cols[3], pa.string())})

        yield from grouped(batches, ("conv_id", "stretch", "given", "turn", "text", "entry", "leave", "final"), settle)

    joined = rows.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")))
    return (joined.select(*keys, "given", "turn", "text", "entry", "leave", "final", "rank").repartition(parts, *keys)
            .sortWithinPartitions(*keys, "rank")
            .select(*keys, "given", "turn", "text", "entry", "leave", "final").mapInArrow(write, SCHEMA))


def render(formatted: DataFrame) -> DataFrame:
    """(conv_id, rendered): the segments of each conversation joined; one string per conversation."""
    order = Window.partitionBy("conv_id").orderBy("stretch", "seq")
    numbered = formatted.withColumn("place", F.row_number().over(order))
    piece = F.array_sort(F.collect_list(F.struct("place", "segment")))
    return numbered.groupBy("conv_id").agg(F.array_join(F.transform(piece, lambda x: x["segment"]), "").alias("rendered"))
