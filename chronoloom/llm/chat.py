"""Chat formatting with minimum-cost repair of roles.

A conversation is legal if it is an optional system turn followed by user and assistant turns
that alternate, user first.  Every given turn is kept with its role, relabelled (cost RELABEL),
or merged into the turn before it (cost MERGE, or MERGE + RELABEL where its role is another
one); before a turn an empty turn of the role that is due may be inserted (cost INSERT).  A turn
without a known role is given the role that fits.  The cheapest repair is found by dynamic
programming over the automaton of legal turns and rendered.

The state is the last turn's role, so a run of turns is a 4 x 4 matrix of least costs, and runs
compose by the (min, +) product.  A conversation of any length is cut into chunks by the order of
its turns; each chunk gives its matrix, a scan over a conversation's matrices gives each chunk its
entry and exit, and the chunks choose their operations side by side.  A table of ordinary
conversations has one chunk for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Role names that mean the same; a fixed list.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
         "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT,
         "model": ASSISTANT}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
CHUNK = 512
FAR = 1e18
#: The legal next roles of each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _moves() -> list[list[tuple[int, int, float, str]]]:
    """For each given role (0: unknown) all (from, to, cost, operation) of one turn.

    The operations in order of preference among equal costs: keep, merge, relabel, insert.
    """
    out = []
    for role in range(4):
        moves = []
        for state in range(4):
            for new in LEGAL[state]:
                own = 0.0 if role in (0, new) else RELABEL
                moves.append((state, new, own, "keep" if role == new else "relabel"))
            if state != START:
                other = 0.0 if role in (0, state) else RELABEL
                moves.append((state, state, MERGE + other, "merge"))
            for between in LEGAL[state]:
                if between == SYSTEM:
                    continue
                for new in LEGAL[between]:
                    own = 0.0 if role in (0, new) else RELABEL
                    moves.append((state, new, INSERT + own, f"insert_{ROLES[between]}"))
        # Of two ways between the same states the cheaper one, the first of equals.
        best: dict[tuple[int, int], tuple[float, str]] = {}
        for a, b, cost, name in moves:
            if (a, b) not in best or cost < best[a, b][0]:
                best[a, b] = cost, name
        out.append([(a, b, *x) for (a, b), x in sorted(best.items())])
    return out


MOVES = _moves()
_COST = np.full((4, 4, 4), FAR)
for _role, _ways in enumerate(MOVES):
    for _a, _b, _c, _ in _ways:
        _COST[_role, _a, _b] = _c


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs through a and then b."""
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, FAR)
    for role in roles:
        out = compose(out, _COST[role])
    return out


def repair(roles: list[int], entry: int = START, leave: int | None = None
           ) -> tuple[float, list[tuple[int, str]]]:
    """The least cost and each turn's (new role, operation), from ``entry`` to ``leave``.

    Without ``leave`` the cheapest exit; ties go to the exit and the way of the lower states.
    """
    cost = np.full((len(roles) + 1, 4), FAR)
    cost[0, entry] = 0
    for i, role in enumerate(roles):
        cost[i + 1] = (cost[i][:, None] + _COST[role]).min(0)
    state = int(cost[-1].argmin()) if leave is None else leave
    total, out = float(cost[-1, state]), []
    for i in range(len(roles) - 1, -1, -1):
        names = {(a, b): n for a, b, _, n in MOVES[roles[i]]}
        before = int((cost[i] + _COST[roles[i]][:, state]).argmin())
        out.append((state, names[before, state]))
        state = before
    return total, out[::-1]


def _role(column: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in NAMES.items() for x in (k, v)))
    return F.coalesce(F.element_at(known, F.lower(F.trim(column))), F.lit(0))


def _chunked(turns: DataFrame) -> DataFrame:
    """Numbers turns within conversations and chunks, whatever a conversation's length.

    Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation covers
    many partitions; places within a partition are counted there, and the rows of earlier
    partitions are added from one small row per partition and conversation.
    """
    order = ["conv", "turn", "role", "text"]
    dealt = cut(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("conv", "part").orderBy(*order[1:])
    sizes = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(
        W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    told = dealt.withColumn("at", F.row_number().over(inside) - 1).join(
        before.select(F.col("conv").alias("c"), F.col("part").alias("p"), "before"),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    return told.withColumn("place", F.col("at") + F.col("before")).select(
        "conv", "place", F.floor(F.col("place") / CHUNK).alias("chunk"), "turn", "role", "text")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every given turn with its part of the rendered conversation.

    conv_id, place (in the conversation, from 0), turn, role (as given), new_role, operation
    (keep, relabel, merge, insert_user, insert_assistant), cost, and rendered: what to append,
    in the order of place, to get the conversation.  A conversation's last row closes it.

    Turns go by turn number, then role, then text; equal rows stay, each as a turn of its own.
    A null turn number comes first, a null conversation is one conversation, a null text is
    empty.  Other columns are ignored; an empty table gives an empty table.
    """
    slim = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = cut(_chunked(slim).withColumn("code", _role(F.col("role"))))
    kind = slim.schema["conv"].dataType.simpleString()

    def costs(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("place").to_numpy())
        roles = group.column("code").to_numpy()[order].tolist()
        return pa.table({"conv": group.column("conv").slice(0, 1),
                         "chunk": group.column("chunk").slice(0, 1),
                         "costs": pa.array([matrix(roles).ravel().tolist()],
                                           pa.list_(pa.float64()))})

    matrices = placed.select("conv", "chunk", "place", "code").groupBy("conv", "chunk").applyInArrow(
        costs, f"conv {kind}, chunk long, costs array<double>")

    def scan(group: pa.Table) -> pa.Table:
        """Entries and exits of a conversation's chunks; one small row for 512 turns."""
        order = np.argsort(group.column("chunk").to_numpy())
        each = [np.array(group.column("costs")[int(i)].as_py()).reshape(4, 4) for i in order]
        cost = [np.array([0.0, FAR, FAR, FAR])]
        for m in each:
            cost.append(np.minimum((cost[-1][:, None] + m).min(0), FAR))
        state = [int(cost[-1].argmin())]
        for c, m in zip(cost[-2::-1], each[::-1]):
            state.append(int((c + m[:, state[-1]]).argmin()))
        state = state[::-1]
        return pa.table({
            "conv": group.column("conv"), "chunk": pa.array(
                group.column("chunk").to_numpy()[order]),
            "entry": pa.array(state[:-1], pa.int32()), "leave": pa.array(state[1:], pa.int32()),
            "last": pa.array([i == len(each) - 1 for i in range(len(each))])})

    ways = matrices.groupBy("conv").applyInArrow(
        scan, f"conv {kind}, chunk long, entry int, leave int, last boolean")
    told = placed.join(ways.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), "entry",
                                   "leave", "last"),
                       F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop(
        "c", "k")
    turn_kind = slim.schema["turn"].dataType.simpleString()

    def choose(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("place").to_numpy())))
        entry, leave = (group.column(c)[0].as_py() for c in ("entry", "leave"))
        roles = group.column("code").to_pylist()
        _, ways_ = repair(roles, entry, leave)
        costs_, rendered, state = [], [], entry
        for (new, name), role, text in zip(ways_, roles, group.column("text").to_pylist()):
            costs_.append(float(_COST[role, state, new]))
            parts = []
            if name == "merge":
                parts.append("\n\n" + text)
            else:
                if state != START:
                    parts.append(CLOSE)
                if name.startswith("insert_"):
                    parts.append(OPEN.format(name.removeprefix("insert_")) + CLOSE)
                parts.append(OPEN.format(ROLES[new]) + text)
            rendered.append("".join(parts))
            state = new
        if group.column("last")[0].as_py():
            rendered[-1] += CLOSE
        return pa.table({
            "conv_id": group.column("conv"), "place": group.column("place"),
            "turn": group.column("turn"), "role": group.column("role"),
            "new_role": pa.array([ROLES[n] for n, _ in ways_], pa.string()),
            "operation": pa.array([n for _, n in ways_], pa.string()),
            "cost": pa.array(costs_), "rendered": pa.array(rendered, pa.string())})

    return told.groupBy("conv", "chunk").applyInArrow(
        choose, f"conv_id {kind}, place long, turn {turn_kind}, role string, new_role string, "
        "operation string, cost double, rendered string")
