"""Chat formatting with minimum-cost role repair.

Legal sequences are those of an automaton: an optional system turn, then user and assistant turns in
alternation, the last one the assistant's.  Each input turn is kept, relabelled, merged into the
turn before it (relabelled first if roles differ), and empty turns may be inserted before it
or at the end; costs are in ``COSTS``.  A dynamic program over the automaton's states finds the cheapest
repair.  Among equals the first turn at which they differ decides: keep, then merge, relabel, relabel and merge, then
fewer insertions, then the role first in ``ROLES``; so there is one optimum, whatever the partitions.

Steps are matrices of four states, whose entries are a cost and the rank of the way among those of its row; a product takes the
least cost and then the least rank, so it is associative.  Runs of ``RUN`` turns are reduced to matrices in parallel, and
runs of ``RUN`` matrices again, until a conversation has few; from there every run learns the states between which it
traces its own.  A conversation of any length is thus spread over tasks, and its rendering comes as one piece a turn;
the pieces in order of ``pos`` are the rendered text.

Defined cases: an unknown or null role must be relabelled; roles are compared trimmed and lower-cased;
a null text counts as empty; equal turn numbers are ordered by role and text; null turn numbers come first;
null conversation ids are one conversation; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import materialize

ROLES = ("system", "user", "assistant")
OTHER = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal turns after each state; a role's state is its number plus one.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"merge": 0.6, "relabel": 1.5, "unknown": 0.9, "insert": 1.0}
RUN = 4096


def _fill(state: int, target: int) -> tuple[int, ...] | None:
    """The shortest run of empty turns after which ``target`` is legal."""
    todo: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    seen = {state}
    while todo:
        at, path = todo.pop(0)
        if target in LEGAL[at]:
            return path
        for x in LEGAL[at]:
            if x not in seen:
                seen.add(x)
                todo.append((x, (*path, x)))
    return None


FILL = {(s, t): _fill(s, t) for s in range(4) for t in (SYSTEM, USER, ASSISTANT)}


#: Costs are summed as whole numbers, so that sums do not depend on their order.
UNIT = 1000
FAR = 1 << 60
ACTIONS = ("keep", "merge", "relabel", "relabel+merge")
Step = tuple[int, int, tuple[int, ...]]  # cost, number of the action, inserted states


def steps(costs: dict[str, float] = COSTS) -> dict[int, dict[tuple[int, int], Step]]:
    """For each role number the cheapest step from state to state, the first of its equals."""
    whole = {k: round(UNIT * x) for k, x in costs.items()}
    out: dict[int, dict] = {}
    for role in range(4):
        own: dict[tuple[int, int], Step] = {}
        for s in range(4):
            for t in (SYSTEM, USER, ASSISTANT):
                change = 0 if t == role + 1 else whole["unknown"] if role == OTHER else whole["relabel"]
                options: list[Step] = []
                if FILL[s, t] is not None:
                    options.append((change + whole["insert"] * len(FILL[s, t]), 2 if change else 0, FILL[s, t]))
                if s == t:
                    options.append((change + whole["merge"], 3 if change else 1, ()))
                if options:
                    own[s, t] = min(options, key=lambda x: (x[0], x[1], len(x[2])))
        out[role] = own
    return out


STEPS = steps()
#: Empty turns that end a conversation legally.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
Matrix = tuple[tuple[tuple[int, int], ...], ...]  # [from][to]: cost, rank among the row's ways


def _ranked(rows: list[list[tuple]]) -> Matrix:
    """(cost, order..) entries to (cost, rank) entries."""
    out = []
    for row in rows:
        order = sorted(range(4), key=lambda t: (row[t][0] >= FAR, row[t][1:], t))
        rank = {t: k for k, t in enumerate(order)}
        out.append(tuple((min(row[t][0], FAR), rank[t]) for t in range(4)))
    return tuple(out)


UNREACHED = (FAR,)
MATRICES: list[Matrix] = [_ranked([[(x[0], x[1], len(x[2]), t) if (x := STEPS[r].get((s, t))) else UNREACHED for t in range(4)] for s in range(4)]) for r in range(4)]
IDENTITY: Matrix = tuple(tuple((0 if s == t else FAR, (t - s) % 4) for t in range(4)) for s in range(4))


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The least way through both: by cost, then by the rank of its first part, then of its second."""
    return _ranked([[min((a[s][u][0] + b[u][t][0], a[s][u][1], b[u][t][1]) for u in range(4)) for t in range(4)] for s in range(4)])


_products: dict[tuple[Matrix, Matrix], tuple[int, Matrix]] = {}


def _product(a: Matrix, b: Matrix) -> Matrix:
    """:func:`compose`, remembered up to a cost that all entries share."""
    base = min(x[0] for row in a for x in row)
    key = (tuple(tuple((x[0] - base if x[0] < FAR else FAR, x[1]) for x in row) for row in a), b)
    if key not in _products:
        if len(_products) > 100_000:
            _products.clear()
        _products[key] = compose(*key)
    return tuple(tuple((x[0] + base if x[0] < FAR else FAR, x[1]) for x in row) for row in _products[key])


def product(matrices: list[Matrix]) -> Matrix:
    m = IDENTITY
    for x in matrices:
        m = _product(m, x)
    return m


def run_matrix(roles: list[int]) -> Matrix:
    return product([MATRICES[r] for r in roles])


_moves: dict[tuple, tuple[list[int], tuple]] = {}


def _move(way: tuple, m: Matrix) -> tuple[list[int], tuple]:
    """The state before ``m`` for each behind it, and the ways there; costs count from their least."""
    key = (way, m)
    if key not in _moves:
        if len(_moves) > 100_000:
            _moves.clear()
        best = [min((way[u][0] + m[u][t][0], way[u][1], m[u][t][1], u) for u in range(4)) for t in range(4)]
        (after,) = _ranked([[x[:3] for x in best]])
        base = min(x[0] for x in after)
        _moves[key] = [x[3] for x in best], tuple((x[0] - base if x[0] < FAR else FAR, x[1]) for x in after)
    return _moves[key]


def states_between(matrices: list[Matrix], entry: int, leave: int) -> list[tuple[int, int]]:
    """The state before and behind each of ``matrices`` on the least way from ``entry`` to ``leave``."""
    way = IDENTITY[entry]
    back = []
    for m in matrices:
        before, way = _move(way, m)
        back.append(before)
    state, out = leave, []
    for b in reversed(back):
        out.append((b[state], state))
        state = b[state]
    return out[::-1]


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """State, action and inserted states of each turn on the least way from ``entry`` to ``leave``."""
    ways = states_between([MATRICES[r] for r in roles], entry, leave)
    return [(t, ACTIONS[STEPS[r][s, t][1]], STEPS[r][s, t][2]) for r, (s, t) in zip(roles, ways, strict=True)]


def final_state(m: Matrix) -> int:
    """The state that a whole conversation ends in."""
    return min(range(4), key=lambda t: (m[START][t][0] + round(UNIT * COSTS["insert"]) * len(CLOSE[t]), m[START][t][1]))


def to_flat(m: Matrix) -> list[int]:
    return [x for row in m for cell in row for x in cell]


def from_flat(x: list[int]) -> Matrix:
    return tuple(tuple((x[8 * s + 2 * t], x[8 * s + 2 * t + 1]) for t in range(4)) for s in range(4))


def _opening(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


END = "<|end|>\n"


NODE = "conv_id long, id long, n long, m array<long>"
PLACED = "conv_id long, id long, entry int, leave int, before long, last boolean"


def _children(nodes: DataFrame, *parent: Column) -> DataFrame:
    """Each parent's nodes in a row."""
    return nodes.groupBy("conv_id", *parent).agg(F.array_sort(F.collect_list(F.struct("id", "n", "m"))).alias("nodes"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a parent to the parent."""
    for batch in batches:
        yield _batch([(r["conv_id"], r["up"], sum(x["n"] for x in r["nodes"]), to_flat(product([from_flat(x["m"]) for x in r["nodes"]]))) for r in batch.to_pylist()], NODE)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of nodes from their parent's, or from the whole conversation where none is given."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            own = [from_flat(x["m"]) for x in r["nodes"]]
            entry, leave, before, last = (r[k] for k in ("entry", "leave", "before", "last")) if r.get("entry") is not None else (START, final_state(product(own)), 0, True)
            for x, (a, b) in zip(r["nodes"], states_between(own, entry, leave), strict=True):
                rows.append((r["conv_id"], x["id"], a, b, before, last and x is r["nodes"][-1]))
                before += x["n"]
        yield _batch(rows, PLACED)


def places(nodes: DataFrame, fan: int) -> DataFrame:
    """Entry and exit state, turns before, and whether it is the last, of every node of every conversation.

    No task takes more than ``fan`` nodes of a conversation: where there are more, ``fan`` neighbours at a time become a node above.
    """
    levels = [nodes]
    while levels[-1].groupBy("conv_id").count().where(F.col("count") > fan).limit(1).count():
        above = _children(levels[-1], F.expr(f"id div {fan}").alias("up")).mapInArrow(_folded, NODE)
        levels.append(materialize(above, "chat-above"))
    found = _children(levels[-1]).mapInArrow(_placed, PLACED)
    for below in reversed(levels[:-1]):
        own = _children(below, F.expr(f"id div {fan}").alias("up")).withColumnRenamed("conv_id", "c")
        found = materialize(found, "chat-places")
        joined = own.join(found, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("up") == F.col("id")))
        found = joined.select("conv_id", "nodes", "entry", "leave", "before", "last").mapInArrow(_placed, PLACED)
    return found


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, run: int = RUN, fan: int = RUN) -> DataFrame:
    """``conv_id, pos, turn, role, new_role, action, inserted, piece``: one row a turn, in order of ``pos`` within a conversation."""
    role = F.lower(F.trim(df[role_col].cast("string")))
    turns = df.select(
        df[conv_col].cast("long").alias("conv_id"), df[turn_col].cast("long").alias("turn"), df[role_col].cast("string").alias("role"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
        sum((F.when(role == x, F.lit(k - OTHER)).otherwise(0) for k, x in enumerate(ROLES)), F.lit(OTHER)).cast("int").alias("r"),
    )
    # ranges are cut within a conversation too, and by the row number within equal turns
    order = [*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")), F.col("row")]
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("idx", F.monotonically_increasing_id())
    rows = materialize(ranged.withColumn("run", F.expr(f"cast(shiftrightunsigned(idx, 33) * {(1 << 33) // run + 1} + (idx & {(1 << 33) - 1}) div {run} as bigint)")), "chat-turns")
    parts = rows.groupBy("conv_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "r"))), lambda x: x["r"]).alias("roles"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("roles").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("run"), batch.column("roles"), pa.array([to_flat(run_matrix(x)) for x in roles], pa.list_(pa.int64()))], names=["conv_id", "run", "roles", "m"])

    reduced = materialize(parts.mapInArrow(reduce, "conv_id long, run long, roles array<int>, m array<long>"), "chat-runs")
    ends = places(reduced.select("conv_id", F.col("run").alias("id"), F.size("roles").cast("long").alias("n"), "m"), fan)
    known = reduced.select("conv_id", "run", "roles").join(ends.withColumnRenamed("conv_id", "c").withColumnRenamed("id", "u"), (F.col("run") == F.col("u")) & F.col("conv_id").eqNullSafe(F.col("c")))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = []
            for roles, a, b in zip(batch.column("roles").to_pylist(), batch.column("entry").to_pylist(), batch.column("leave").to_pylist(), strict=True):
                plans.append([{"state": s, "action": x, "inserted": [ROLES[f - 1] for f in filled]} for s, x, filled in trace(roles, a, b)])
            kind = pa.list_(pa.struct([("state", pa.int32()), ("action", pa.string()), ("inserted", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "run", "before", "last")), pa.array(plans, kind)], names=["conv_id", "run", "before", "last", "plan"])

    plans = known.select("conv_id", "run", "before", "last", "roles", "entry", "leave").mapInArrow(traced, "conv_id long, run long, before long, last boolean, plan array<struct<state:int,action:string,inserted:array<string>>>")
    # the n-th turn of a run takes the n-th step of its plan
    each = plans.select("conv_id", "run", "before", "last", F.size("plan").alias("n"), F.posexplode("plan").alias("k", "step"))
    first = rows.groupBy("conv_id", "run").agg(F.min("idx").alias("low"))
    each = each.join(first.withColumnRenamed("conv_id", "c").withColumnRenamed("run", "u"), (F.col("run") == F.col("u")) & F.col("conv_id").eqNullSafe(F.col("c"))).select((F.col("low") + F.col("k")).alias("i"), "before", "last", "n", "k", "step")
    joined = rows.join(each, F.col("idx") == F.col("i"))
    pos = F.col("before") + F.col("k")
    new = ~F.col("step.action").contains("merge")
    fills = F.array_join(F.transform("step.inserted", lambda x: F.concat(F.lit("<|"), x, F.lit("|>\n" + END))), "")
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("step.state"))
    end = F.lit("")
    for s, more in CLOSE.items():
        end = F.when(F.col("step.state") == s, F.lit(END + "".join(_opening(x) + END for x in more))).otherwise(end)
    piece = F.concat(
        F.when(new & (pos > 0), F.lit(END)).otherwise(F.when(pos > 0, F.lit("\n")).otherwise("")),
        fills, F.when(new, F.concat(F.lit("<|"), name, F.lit("|>\n"))).otherwise(""), "text",
        F.when(F.col("last") & (F.col("k") == F.col("n") - 1), end).otherwise(""),
    )
    return joined.select("conv_id", pos.alias("pos"), "turn", "role", name.alias("new_role"), F.col("step.action").alias("action"), F.array_join("step.inserted", ",").alias("inserted"), piece.alias("piece"))
