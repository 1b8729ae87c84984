"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton.

A legal conversation is an optional system turn and then user and assistant in
turn, user first and assistant last.  The turns given are read in order; each
one is kept (free), merged into the turn before it (MERGE) or relabelled
(RELABEL), and empty turns may be inserted (INSERT each).  The cheapest way is
found exactly.

A step through some turns is a 4 x 4 matrix of least costs between automaton
states, and matrices of neighbouring pieces combine by (min, +) products.  So
a conversation is cut into pieces of bounded size, all pieces are solved apart,
only the small matrices meet per conversation, and each piece is then traced
from the state in which it begins to the one in which it ends.  A single huge
conversation is spread over the cluster.  Pieces are stretches of turn numbers;
where many rows share few numbers (repeated or missing ones) the stretch is
cut again by turn, role and a hashed share of the rows.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.workdir import materialize

MERGE, RELABEL, INSERT = 1, 2, 3
#: Turn numbers a piece spans; a stretch with more than CROWD times as many rows is cut again.
PIECE, CROWD = 256, 4

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Other names of the roles, free of charge.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each two states the states to pass between them (empty turns), fewest first."""
    out = {}
    for a in range(4):
        level = [(b, ()) for b in NEXT[a]]
        while level:
            fresh = []
            for b, via in level:
                if (a, b) not in out:
                    out[a, b] = via
                    fresh += [(c, (*via, b)) for c in NEXT[b]]
            level = fresh
    return out


PATHS = _paths()


def known_role(role: str | None) -> int:
    """State of a role name, or -1: such a turn has to be relabelled."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else -1


def steps(state: int, role: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, new state, action, inserted states) of reading a turn, the preferred of equals first."""
    out = []
    for target in (SYSTEM, USER, ASSISTANT):
        change = 0 if target == role else RELABEL
        if target == state:
            out.append((MERGE + change, target, "merge", ()))
        if (state, target) in PATHS:
            via = PATHS[state, target]
            out.append((change + INSERT * len(via), target, "relabel" if change else "keep", via))
    return sorted(out, key=lambda x: (x[0], ("keep", "merge", "relabel").index(x[2]), x[1]))


STEPS = {(s, r): steps(s, r) for s in range(4) for r in (-1, 1, 2, 3)}
FAR = 10**12


def solve(roles: list[int], begin: int) -> tuple[list[int], list[list]]:
    """Least costs from state begin to every state after all turns, and the choices on the way."""
    cost, back = [FAR] * 4, []
    cost[begin] = 0
    for role in roles:
        new, how = [FAR] * 4, [None] * 4
        for state in range(4):
            if cost[state] < FAR:
                for price, target, action, via in STEPS[state, role]:
                    if cost[state] + price < new[target]:
                        new[target], how[target] = cost[state] + price, (state, action, via)
        cost = new
        back.append(how)
    return cost, back


def trace(roles: list[int], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(state, action, inserted) of every turn on a cheapest way from begin to end."""
    _, back = solve(roles, begin)
    out, state = [], end
    for how in reversed(back):
        before, action, via = how[state]
        out.append((state, action, via))
        state = before
    return out[::-1]


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation legally."""
    return () if state in (ASSISTANT, START) else (*PATHS[state, ASSISTANT], ASSISTANT)


class Chain:
    """Least costs over pieces that come one by one; a piece leaves four bytes behind."""

    def __init__(self):
        self.cost, self.back = [0, FAR, FAR, FAR], bytearray()

    def add(self, m: list[list[int]]) -> None:
        cost = self.cost
        self.back += bytes(min(range(4), key=lambda a: (cost[a] + m[a][b], a)) for b in range(4))
        self.cost = [min(cost[a] + m[a][b] for a in range(4)) for b in range(4)]

    def close(self) -> tuple[int, bytearray]:
        """Least total cost, closing included, and the states at the pieces' borders."""
        total = [c + INSERT * len(closing(s)) for s, c in enumerate(self.cost)]
        state = min(range(4), key=lambda s: (total[s], s))
        least, border = total[state], bytearray([state])
        for at in range(len(self.back) - 4, -1, -4):
            state = self.back[at + state]
            border.append(state)
        border.reverse()
        return least, border


def chain(matrices: list[list[list[int]]]) -> tuple[int, list[int]]:
    """Least total cost over all pieces, closing included, and the states at the pieces' borders."""
    way = Chain()
    for m in matrices:
        way.add(m)
    least, border = way.close()
    return least, list(border)


def _open(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


CLOSE = "<|end|>\n"


def _groups(batches):
    """(key, rows) of runs of equal first three columns, from sorted Arrow batches; one run is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and row[:3] != key:
                yield key, rows
                rows = []
            key = row[:3]
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows, schema: pa.Schema, most: int = 2000):
    """Arrow batches of bounded size from tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size > 4 << 20:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PIECE = [("conv_id", pa.int64()), ("block", pa.int64()), ("sub", pa.int64())]
_MATRIX = pa.schema([*_PIECE, ("matrix", pa.list_(pa.int64()))])
_BORDER = pa.schema([*_PIECE, ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])
_TURN = pa.schema(
    [("conv_id", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string())]
    + [("relabelled", pa.bool_()), ("inserted", pa.int32()), ("rendered", pa.string()), ("cost", pa.int64()), ("piece", pa.int64()), ("sub_piece", pa.int64())]
)


def _matrices(batches):
    """conv_id, block, sub, role rows in order: the matrix of each piece."""
    rows = ((*key, [c for begin in range(4) for c in solve([known_role(r[3]) for r in rows], begin)[0]]) for key, rows in _groups(batches))
    yield from _batches(rows, _MATRIX)


def _borders(batches):
    """conv_id, block, sub, matrix rows in order: the states in which each piece begins and ends."""

    def conversation(conv, way, blocks, subs):
        least, border = way.close()
        for i, (block, sub) in enumerate(zip(blocks, subs)):
            yield conv, block, sub, border[i], border[i + 1], i == len(blocks) - 1, least

    def rows():
        now = None
        for batch in batches:
            for conv, block, sub, m in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield from conversation(*now)
                    now = conv, Chain(), array("q"), array("q")
                now[1].add([m[4 * a : 4 * a + 4] for a in range(4)])
                now[2].append(block), now[3].append(sub)
        if now is not None:
            yield from conversation(*now)

    yield from _batches(rows(), _BORDER)


def _render(batches):
    """conv_id, block, sub, kind, begin, end, last, cost, turn, role, text: a border row, then the piece's turns."""

    def rows():
        for (conv, block, sub), found in _groups(batches):
            (*_, state, end, last, cost, _, _, _), turns = found[0], found[1:]
            ways = trace([known_role(r[9]) for r in turns], state, end)
            for i, ((target, action, via), (*_, turn, role, text)) in enumerate(zip(ways, turns)):
                if action == "merge":
                    shown = "\n\n" + (text or "")
                else:
                    shown = ("" if state == START else CLOSE) + "".join(_open(s) + CLOSE for s in via) + _open(target) + (text or "")
                after = closing(target) if last and i == len(ways) - 1 else ()
                if last and i == len(ways) - 1:
                    shown += CLOSE + "".join(_open(s) + CLOSE for s in after)
                yield conv, i, turn, role, ROLES[target - 1], action, known_role(role) != target, len(via) + len(after), shown, cost, block, sub
                state = target

    yield from _batches(rows(), _TURN)


def _pieces(turns: DataFrame, piece: int) -> DataFrame:
    """conv_id, block, sub, turn, role, text: every row with its piece (block, sub)."""
    block = F.coalesce(F.floor(F.col("turn") / piece), F.lit(-(2**62))).cast("long").alias("block")
    share = (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("share")
    # written, so that a row has the same share wherever it is read
    rows = materialize(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).select("conv_id", block, share, "turn", "role", "text"), "turns")
    crowds = materialize(rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > CROWD * piece).select(F.col("conv_id").alias("c_conv"), F.col("block").alias("c_block")), "crowds")
    crowded = rows.select("conv_id", "block", "turn", "role").join(crowds, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("block") == F.col("c_block")))
    before = Window.partitionBy("c_conv", "c_block").orderBy("c_turn", "c_role").rowsBetween(Window.unboundedPreceding, -1)
    parts = crowded.groupBy("c_conv", "c_block", F.col("turn").alias("c_turn"), F.col("role").alias("c_role")).agg(F.ceil(F.count(F.lit(1)) / piece).alias("parts"))
    parts = materialize(parts.withColumn("base", F.coalesce(F.sum("parts").over(before), F.lit(0))), "crowds")
    same = F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("block") == F.col("c_block")) & F.col("turn").eqNullSafe(F.col("c_turn")) & F.col("role").eqNullSafe(F.col("c_role"))
    sub = F.coalesce(F.col("base") + F.floor(F.col("share") * F.col("parts")), F.lit(0)).cast("long")
    return rows.join(parts, same, "left").select("conv_id", "block", sub.alias("sub"), "turn", "role", "text")


def repair_turns(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per row of conversations(conv_id, turn, role, text), repaired.

    conv_id, turn, role (as given), new_role, action (keep, merge or relabel;
    merge joins the turn to the one before), relabelled, inserted (empty turns
    before it, or after the last one), rendered, piece, sub_piece and at (the
    row's place: joining rendered by the three gives the conversation), cost
    (the least cost of the whole conversation).

    Rows are read by turn, then role, then text, nulls first; where more than
    CROWD * piece rows of a conversation stand in one stretch of piece turn
    numbers, rows of one turn and role come in a fixed, hashed order.  Null and
    unknown roles are relabelled; null texts are empty; a null turn comes first;
    rows repeated with the same turn are turns of their own, however many; rows
    with a null conv_id make up a conversation; other columns are ignored; an
    empty table gives an empty result.

    Three exchanges: roles by piece, matrices by conversation, and turns with
    their piece's borders by piece; the tasks read sorted rows as a stream.
    """
    cut = _pieces(turns, piece)
    at = ("conv_id", "block", "sub")
    roles = cut.select(*at, "turn", "role").repartition(*at).sortWithinPartitions(*at, "turn", "role")
    matrices = roles.select(*at, "role").mapInArrow(_matrices, "conv_id long, block long, sub long, matrix array<long>")
    borders = matrices.repartition("conv_id").sortWithinPartitions(*at).mapInArrow(_borders, "conv_id long, block long, sub long, begin int, end int, last boolean, cost long")
    none = lambda kind: F.lit(None).cast(kind)
    heads = borders.select(*at, F.lit(0).alias("kind"), "begin", "end", "last", "cost", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"))
    bodies = cut.select(*at, F.lit(1).alias("kind"), none("int").alias("begin"), none("int").alias("end"), none("boolean").alias("last"), none("long").alias("cost"), "turn", "role", "text")
    both = heads.union(bodies).repartition(*at).sortWithinPartitions(*at, "kind", "turn", "role", "text")
    kind = "conv_id long, at int, turn long, role string, new_role string, action string, relabelled boolean, inserted int, rendered string, cost long, piece long, sub_piece long"
    return both.mapInArrow(_render, kind)


def render_conversations(repaired: DataFrame) -> DataFrame:
    """conv_id, text, cost: repaired turns joined to one text a conversation."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "sub_piece", "at", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"), F.max("cost").alias("cost"))
