"""Best paths in weighted automata and in lazy compositions of two, by blocks of states.

Automata are tables: arcs (fst, src, dst, inp, out, cost) and nodes (fst, id, accept), with 0 as
epsilon and node 0 as the start. A table of arcs may also hold several arcs a row: (fst, arcs), an
array of structs of the other columns. A state of a search is a pair (l, r) of a left and a right
state; no pair is made before a path reaches it.

Automata of few arcs, as the lattices of lines, are searched whole: a task streams over them, sorted by
fst, and holds one at a time (_solved). Of the others states are dealt into blocks of consecutive
numbers. A round gives each block that has open states, with the arcs that leave it, to one task, which
settles the block by a best-first search; states beyond the block become the next round's open
states. So a chain of n arcs takes n / BLOCK rounds, however many automata the table holds. Both
searches give the same results.

The search is bounded by exact costs to the end (cost_to_accept): a state whose path so far plus the least
costs to accept on both sides exceed the best accepted path is not opened.

Of several paths to a state the one of least cost is kept, then of fewest arcs, then the
least by (parent, labels); so parents form no circle and results hang on neither layout nor
blocks. Rounds go on until no state is open, without a limit. Costs must not be negative.

Defined cases: an automaton without an accepting path has no row in the results; no arcs at all
give an empty result, but for automata whose start accepts.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.operators.durable import cut

#: States of each side in a block.
BLOCK = 4096
#: Arcs of an automaton searched whole, and pairs of a left and a right arc, as multiples of the block.
WHOLE_ARCS, WHOLE_PAIRS = 4, 64

_STATE = "l long, r long, g double, hops long, pl long, pr long, inp int, out int, cost double, ha double, hb double, fa double, fb double"
_FIELDS = [f.split(" ")[0] for f in _STATE.split(", ")]
_MOVE = ("g", "hops", "pl", "pr", "inp", "out", "cost")
_ROWS = ["fst", "lb", "rb", "kind", "open", "bound", *_FIELDS]
_OPEN, _LEFT, _RIGHT = 0, 1, 2
_ARC = {"src": "long", "dst": "long", "inp": "int", "out": "int", "cost": "double"}
_PATH = {"l": "long", "r": "long", "inp": "int", "out": "int", "cost": "double"}
_KINDS = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def _block(column, size: int):
    return F.floor(F.col(column) / size)


def _room(bound: float) -> float:
    """Sums in another order may differ in the last digits."""
    return bound + 1e-9 * (1 + abs(bound))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each group of rows that are sorted by the key fst, lb, rb; one group is held at a time."""
    key, held = None, []
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("fst", "lb", "rb")), strict=True)
        for at, row in zip(keys, zip(*(batch[c].to_pylist() for c in names), strict=True), strict=True):
            if at != key:
                if held:
                    yield key, held
                key, held = at, []
            held.append(row)
    if held:
        yield key, held


def _streamed(run: Callable, names: list[str], schema: pa.Schema) -> Callable:
    """A function for mapInArrow: run(key, rows) gives rows of schema, which go out in batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _groups(batches, names):
            out += run(key, rows)
            if len(out) > 20_000:
                yield _as_batch(out, schema)
                out = []
        if out:
            yield _as_batch(out, schema)

    return over


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dealt(rows: DataFrame) -> DataFrame:
    # Dealt by a number of its own: Spark 4.1 may leave out a repartition by columns that the sides of a union
    # were dealt by, though it then reads these sides' shuffles locally.
    return rows.repartition(F.xxhash64("fst", "lb", "rb")).sortWithinPartitions("fst", "lb", "rb")


def _settled(key: tuple, rows: list[tuple], size: int, composed: bool) -> list[tuple]:
    """One block: states (open or known) and the arcs that leave its sides; returns all states that got better, in and beyond the block."""
    fst, lb, rb = key
    bound, known, heap = float("inf"), {}, []
    left, right = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for kind, is_open, limit, l, r, g, hops, pl, pr, inp, out, cost, ha, hb, fa, fb in rows:  # noqa: E741
        if kind == _LEFT:
            left[l].append((r, inp, out, cost, ha, fa))
        elif kind == _RIGHT:
            right[l][inp].append((r, out, cost, ha, fa))
        else:
            known[l, r] = (g, hops, pl, pr, inp, out, cost)
            if limit is not None:
                bound = min(bound, limit)
            if is_open:
                heapq.heappush(heap, (g + ha + hb, hops, l, r, g, ha, hb, fa, fb))
    better: dict[tuple, tuple] = {}

    def moves(l, r, ha, hb, fa, fb):  # noqa: E741
        for to, inp, out, cost, h, f in left.get(l, ()):
            if not composed or out == 0:
                yield to, r, inp, out, cost, h, hb, f, fb
            else:
                for to_r, out_r, cost_r, h_r, f_r in right[r].get(out, ()):
                    yield to, to_r, inp, out_r, cost + cost_r, h, h_r, f, f_r
        if composed:
            for to_r, out_r, cost_r, h_r, f_r in right[r].get(0, ()):
                yield l, to_r, 0, out_r, cost_r, ha, h_r, fa, f_r

    while heap:
        total, hops, l, r, g, ha, hb, fa, fb = heapq.heappop(heap)  # noqa: E741
        if known[l, r][:2] != (g, hops):
            continue
        if total > _room(bound):
            break
        if fa is not None and fb is not None:
            bound = min(bound, g + fa + fb)
        for to_l, to_r, inp, out, cost, ha2, hb2, fa2, fb2 in moves(l, r, ha, hb, fa, fb):
            move, at = (g + cost, hops + 1, l, r, inp, out, cost), (to_l, to_r)
            if move[0] + ha2 + hb2 > _room(bound) or (at in known and known[at] <= move):
                continue
            shorter = at not in known or known[at][:2] != move[:2]
            known[at] = move
            better[at] = (*at, *move, ha2, hb2, fa2, fb2)
            if shorter and to_l // size == lb and to_r // size == rb:
                heapq.heappush(heap, (move[0] + ha2 + hb2, hops + 1, to_l, to_r, move[0], ha2, hb2, fa2, fb2))
    return [(fst, at[0] // size != lb or at[1] // size != rb, *state) for at, state in better.items()]


def _arcs_for(kind: int, arcs: DataFrame, ends: DataFrame) -> DataFrame:
    """Arcs as rows of a block, with the least cost to accept and the accept cost behind them; arcs that lead to no end are left out."""
    behind = ends.select("fst", F.col("id").alias("dst"), F.col("h").alias("ha"), F.col("accept").alias("fa"))
    return arcs.join(behind, ["fst", "dst"]).select(
        "fst", F.lit(kind).alias("kind"), F.col("src").cast("long").alias("l"), F.col("dst").cast("long").alias("r"), F.col("inp").cast("int").alias("inp"), F.col("out").cast("int").alias("out"), F.col("cost").cast("double").alias("cost"), "ha", "fa"
    )


def _full(df: DataFrame) -> DataFrame:
    """df with every column of a block's rows, null where it has none."""
    kinds = dict(f.split(" ") for f in _STATE.split(", ")) | {"open": "boolean", "bound": "double"}
    return df.select("fst", "lb", "rb", "kind", *(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _ROWS[4:]))


def _run(starts: DataFrame, left: DataFrame, right: DataFrame | None, size: int) -> DataFrame:
    """All states that a best path may go through: (fst, l, r, g, hops, ...), from open starting states."""
    fst = starts.schema["fst"].dataType
    arrow = pa.schema([("fst", to_arrow_type(fst)), ("open", pa.bool_()), *((n, _KINDS[k]) for n, k in (f.split(" ") for f in _STATE.split(", ")))])
    composed = right is not None
    settle = _streamed(lambda key, rows: _settled(key, rows, size, composed), _ROWS[3:], arrow)
    best = cut(starts.select("fst", F.lit(True).alias("open"), *_FIELDS))
    sides = [(left, "lb"), (right, "rb")] if right is not None else [(left, "lb")]
    # Sides are written with their blocks once, as each round meets them again.
    sides = [(cut(s.withColumn(b, _block("l", size))), b) for s, b in sides]
    while best.where("open").limit(1).count():
        placed = best.withColumn("lb", _block("l", size)).withColumn("rb", _block("r", size))
        limits = best.where("fa is not null and fb is not null").groupBy("fst").agg(F.min(F.expr("g + fa + fb")).alias("bound"))
        active = placed.where("open").select("fst", "lb", "rb").distinct()
        rows = _full(placed.join(active, ["fst", "lb", "rb"], "left_semi").join(limits, "fst", "left").withColumn("kind", F.lit(_OPEN)))
        for side, b in sides:
            rows = rows.unionByName(_full(side.join(active, ["fst", b])))
        found = _dealt(rows).mapInArrow(settle, f"fst {fst.simpleString()}, open boolean, {_STATE}")
        both = best.withColumn("open", F.lit(False)).unionByName(found)
        least = F.min(F.struct(*_MOVE, "open", "ha", "hb", "fa", "fb")).alias("m")
        best = cut(both.groupBy("fst", "l", "r").agg(least).select("fst", "l", "r", "m.*").select("fst", "open", *_FIELDS))
    return best


def _starts(ids: DataFrame, g) -> DataFrame:
    """Open states (fst, l, r, ha, hb, fa, fb) at cost g, without a parent."""
    none = {"pl": "long", "pr": "long", "inp": "int", "out": "int", "cost": "double"}
    return ids.select("fst", "l", "r", g.alias("g"), F.lit(0).cast("long").alias("hops"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "ha", "hb", "fa", "fb")


def cost_to_accept(arcs: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fst, id, h, accept): the least cost from each node to the end of an accepted path, accept cost included; nodes that reach no end have no row."""
    turned = arcs.select("fst", F.lit(_LEFT).alias("kind"), F.col("dst").cast("long").alias("l"), F.col("src").cast("long").alias("r"), F.lit(0).alias("inp"), F.lit(0).alias("out"), F.col("cost").cast("double").alias("cost"), F.lit(0.0).alias("ha"), F.lit(None).cast("double").alias("fa"))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    ends = nodes.where("accept is not null").select("fst", F.col("id").cast("long").alias("l"), F.lit(0).cast("long").alias("r"), zero.alias("ha"), zero.alias("hb"), none.alias("fa"), none.alias("fb"), F.col("accept").cast("double").alias("_a"))
    first = ends.groupBy("fst", "l", "r", "ha", "hb", "fa", "fb").agg(F.min("_a").alias("_a"))
    settled = _run(_starts(first, F.col("_a")), turned, None, block)
    accepts = nodes.where("accept is not null").groupBy("fst", F.col("id").cast("long").alias("id")).agg(F.min(F.col("accept").cast("double")).alias("accept"))
    return settled.select("fst", F.col("l").alias("id"), F.col("g").alias("h")).join(accepts, ["fst", "id"], "left")


def _to_end(arcs: list[tuple], accepts: list[tuple]) -> tuple[dict, dict]:
    """Of one automaton: (the least cost from each node to the end of an accepted path, the accept costs)."""
    back, ends = defaultdict(list), {}
    for src, dst, _, _, cost in arcs:
        back[dst].append((src, cost))
    for at, _, _, _, cost in accepts:
        ends[at] = min(cost, ends.get(at, cost))
    least, heap = dict(ends), [(cost, at) for at, cost in ends.items()]
    heapq.heapify(heap)
    while heap:
        h, at = heapq.heappop(heap)
        if h > least[at]:
            continue
        for src, cost in back.get(at, ()):
            if src not in least or h + cost < least[src]:
                least[src] = h + cost
                heapq.heappush(heap, (h + cost, src))
    return least, ends


def _solved(left: list[tuple], right: list[tuple], left_accepts: list[tuple], right_accepts: list[tuple], composed: bool) -> tuple | None:
    """(cost, l, r, path) of the best accepted path of one automaton or composition, None without one: the search of _settled without blocks."""
    a_least, a_ends = _to_end(left, left_accepts)
    if 0 not in a_least:
        return None
    b_least, b_ends = _to_end(right, right_accepts) if composed else ({0: 0.0}, {0: 0.0})
    if 0 not in b_least:
        return None
    lefts, rights = defaultdict(list), defaultdict(list)
    for src, dst, inp, out, cost in left:
        if dst in a_least:
            lefts[src].append((dst, inp, out, cost))
    for src, dst, inp, out, cost in right:
        if dst in b_least:
            rights[src, inp].append((dst, out, cost))
    known: dict[tuple, tuple] = {(0, 0): (0.0, 0, None, None, None, None, None)}
    heap, best, limit = [(a_least[0] + b_least[0], 0, 0, 0, 0.0)], None, float("inf")
    while heap:
        total, hops, l, r, g = heapq.heappop(heap)  # noqa: E741
        if known[l, r][:2] != (g, hops):
            continue
        if total > limit:
            break
        if l in a_ends and r in b_ends:
            end = (g + a_ends[l] + b_ends[r], hops, l, r)
            best = end if best is None else min(best, end)
            limit = _room(best[0])
        moves = []
        for to, inp, out, cost in lefts.get(l, ()):
            if not composed or out == 0:
                moves.append((to, r, inp, out, cost))
            else:
                moves += [(to, to_r, inp, out_r, cost + cost_r) for to_r, out_r, cost_r in rights.get((r, out), ())]
        if composed:
            moves += [(l, to_r, 0, out_r, cost_r) for to_r, out_r, cost_r in rights.get((r, 0), ())]
        for to_l, to_r, inp, out, cost in moves:
            at, move = (to_l, to_r), (g + cost, hops + 1, l, r, inp, out, cost)
            least, before = move[0] + a_least[to_l] + b_least[to_r], known.get(at)
            if least > limit or (before is not None and before <= move):
                continue
            known[at] = move
            if before is None or before[:2] != move[:2]:
                heapq.heappush(heap, (least, hops + 1, to_l, to_r, move[0]))
    if best is None:
        return None
    at, path = best[2:], []
    while known[at][1]:
        _, _, *arc = known[at]
        at = (arc[0], arc[1])
        path.append(arc)
    return best[0], *best[2:], path[::-1]


def _values(column: pa.Array) -> list:
    """The values of a column; by numpy where it holds no null, as that is much faster."""
    fast = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if fast else column.to_pylist()


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(fst, its rows by kind) of each automaton from rows (fst, kind, arcs) that are sorted by fst; one is held at a time."""
    key, held = None, ([], [], [], [])
    for batch in batches:
        cuts = _values(batch["arcs"].offsets)
        # The values of a slice are those of the whole array.
        arcs = batch["arcs"].values.slice(cuts[0], cuts[-1] - cuts[0])
        cuts = [c - cuts[0] for c in cuts]
        rows = list(zip(*(_values(arcs.field(k)) for k in range(len(_ARC))), strict=True))
        for at, kind, first, last in zip(_values(batch["fst"]), _values(batch["kind"]), cuts, cuts[1:], strict=False):
            if at != key:
                if key is not None:
                    yield key, held
                key, held = at, ([], [], [], [])
            held[kind].extend(rows[first:last])
    if key is not None:
        yield key, held


def _listed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (fst, cost, l, r, path) as a batch."""
    *plain, paths = zip(*rows, strict=True)
    cuts = [0, *itertools.accumulate(map(len, paths))]
    arc = schema.field("path").type.value_type
    flat = list(zip(*itertools.chain.from_iterable(paths), strict=True)) or [()] * arc.num_fields
    arcs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, arc, strict=True)], fields=list(arc))
    return pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(k).type) for k, c in enumerate(plain)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), arcs, type=schema.field("path").type)], schema=schema)


def _all_solved(schema: pa.Schema, composed: bool) -> Callable:
    """A function for mapInArrow: rows (fst, cost, l, r, path) of the automata with an accepted path."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, (left, right, left_accepts, right_accepts) in _wholes(batches):
            found = _solved(left, right, left_accepts, right_accepts, composed)
            if found:
                out.append((key, *found))
                size += 1 + len(found[-1])
            if size > 20_000:
                yield _listed(out, schema)
                out, size = [], 0
        if out:
            yield _listed(out, schema)

    return over


def _packed(arcs: DataFrame) -> DataFrame:
    """(fst, arcs): a row's arcs as an array."""
    struct = lambda of: F.struct(*(of(c).cast(t).alias(c) for c, t in _ARC.items()))
    if "arcs" not in arcs.columns:
        return arcs.select("fst", F.array(struct(F.col)).alias("arcs"))
    # What is as it should be is left alone, as Spark runs a transform without compiled code.
    kind = f"array<struct<{','.join(f'{c}:{t}' for c, t in _ARC.items())}>>".replace("long", "bigint")
    fits = arcs.schema["arcs"].dataType.simpleString() == kind
    return arcs.select("fst", "arcs" if fits else F.transform("arcs", lambda a: struct(lambda c: a[c])).alias("arcs"))


def _single(arcs: DataFrame) -> DataFrame:
    """(fst, src, dst, inp, out, cost): a row for each arc."""
    return arcs.select("fst", F.explode("arcs").alias("_a")).select("fst", "_a.*") if "arcs" in arcs.columns else arcs


def _large(left: DataFrame, right: DataFrame | None, block: int) -> DataFrame:
    """(fst) of the automata, or compositions, that one task had better not hold whole."""
    count = lambda df, a, b: _packed(df).select("fst", (F.size("arcs") * a).alias("a"), (F.size("arcs") * b).alias("b"))
    both = count(left, 1, 0) if right is None else count(left, 1, 0).unionByName(count(right, 0, 1))
    sums = both.groupBy("fst").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    return sums.where((F.col("a") + F.col("b") > WHOLE_ARCS * block) | (F.col("a") * F.col("b") > WHOLE_PAIRS * block)).select("fst")


def _whole(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """(fst, cost, l, r, path) of the best accepted paths; each automaton or composition is searched whole by one task."""
    accept = lambda nodes: _packed(nodes.where("accept is not null").select("fst", F.col("id").alias("src"), *(F.lit(0).alias(c) for c in ("dst", "inp", "out")), F.col("accept").alias("cost")))
    kinds = [(0, _packed(left[0])), (2, accept(left[1]))] + ([(1, _packed(right[0])), (3, accept(right[1]))] if right else [])
    rows = functools.reduce(DataFrame.unionByName, (df.select("fst", F.lit(k).alias("kind"), "arcs") for k, df in kinds)).where("fst is not null")
    fst, path = rows.schema["fst"].dataType, ", ".join(f"{c}: {t}" for c, t in _PATH.items())
    arrow = pa.schema([("fst", to_arrow_type(fst)), ("cost", pa.float64()), ("l", pa.int64()), ("r", pa.int64()), ("path", pa.list_(pa.struct([(c, _KINDS[t]) for c, t in _PATH.items()])))])
    dealt = rows.repartition(F.xxhash64("fst")).sortWithinPartitions("fst")
    return dealt.mapInArrow(_all_solved(arrow, right is not None), f"fst {fst.simpleString()}, cost double, l long, r long, path array<struct<{path}>>")


def _best(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None, block: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(the best paths of the automata searched whole, ends and path of the large ones): None where none is large."""
    large = cut(_large(left[0], right and right[0], block))
    if not large.limit(1).count():
        return _whole(left, right), None
    of = lambda how: [side and tuple(df.join(large, "fst", how) for df in side) for side in (left, right)]
    return _whole(*of("left_anti")), _by_blocks(*of("left_semi"), block)


def best_arcs(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(ends: fst, cost, l, r; path: fst, place, l, r, inp, out, cost): the best accepted path of each automaton, or of its composition with the right one of the same fst.

    The path's rows are its arcs, place counting from 0, l and r the states where they start.
    """
    whole, blocks = _best(left, right, block)
    whole = cut(whole)
    ends, path = whole.select("fst", "cost", "l", "r"), whole.select("fst", F.posexplode("path").alias("place", "_a")).select("fst", F.col("place").cast("long").alias("place"), "_a.*")
    return (ends.unionByName(blocks[0]), path.unionByName(blocks[1])) if blocks else (ends, path)


def _by_blocks(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Ends and path as of best_arcs, by blocks of states."""
    # Each side is read by two searches, so what makes it is worked out once.
    left, right = (side and (cut(_single(side[0])), cut(side[1])) for side in (left, right))
    a_ends = cut(cost_to_accept(*left, block))
    a_arcs = _arcs_for(_LEFT, left[0], a_ends)
    first = a_ends.where("id = 0").select("fst", F.col("h").alias("ha"), F.col("accept").alias("fa"))
    if right is None:
        b_arcs, first = None, first.withColumn("hb", F.lit(0.0)).withColumn("fb", F.lit(0.0))
    else:
        b_ends = cut(cost_to_accept(*right, block))
        b_arcs = _arcs_for(_RIGHT, right[0], b_ends)
        first = first.join(b_ends.where("id = 0").select("fst", F.col("h").alias("hb"), F.col("accept").alias("fb")), "fst")
    zero = F.lit(0).cast("long")
    settled = _run(_starts(first.withColumn("l", zero).withColumn("r", zero), F.lit(0.0)), a_arcs, b_arcs, block)
    ended = settled.where("fa is not null and fb is not null").groupBy("fst").agg(F.min(F.struct(F.expr("g + fa + fb").alias("cost"), "hops", "l", "r")).alias("m"))
    ends = cut(ended.select("fst", "m.cost", "m.l", "m.r"))
    return ends, _trace(settled, ends, block)


def _walked(key: tuple, rows: list[tuple]) -> list[tuple]:
    """The way back from a state to where the path entered the block; the last row names the state before, in another block, or nothing."""
    known = {(l, r): rest for here, l, r, *rest in rows if not here}  # noqa: E741
    out = []
    for at in [(l, r) for here, l, r, *_ in rows if here]:  # noqa: E741
        while at in known and known[at][1] is not None:
            hops, pl, pr, inp, label, cost = known[at]
            at = (pl, pr)
            out.append((key[0], hops - 1, pl, pr, inp, label, cost, at not in known))
    return out


def _trace(settled: DataFrame, ends: DataFrame, block: int) -> DataFrame:
    """The arcs of the best paths by way of the states' parents; a round for each block that a path goes back through."""
    kind, names = settled.schema["fst"].dataType, ["here", "l", "r", "hops", "pl", "pr", "inp", "out", "cost"]
    schema = f"fst {kind.simpleString()}, place long, l long, r long, inp int, out int, cost double, goes_on boolean"
    arrow = pa.schema([("fst", to_arrow_type(kind)), *((n, pa.int64()) for n in ("place", "l", "r")), ("inp", pa.int32()), ("out", pa.int32()), ("cost", pa.float64()), ("goes_on", pa.bool_())])
    blocks = lambda df: df.withColumn("lb", _block("l", block)).withColumn("rb", _block("r", block))
    placed = cut(blocks(settled).select("fst", "lb", "rb", F.lit(False).alias("here"), *names[1:]))
    front, path = ends.select("fst", "l", "r"), None
    while True:
        at = blocks(front)
        near = placed.join(at.select("fst", "lb", "rb").distinct(), ["fst", "lb", "rb"], "left_semi")
        rows = near.unionByName(at.withColumn("here", F.lit(True)), allowMissingColumns=True)
        piece = cut(_dealt(rows).mapInArrow(_streamed(_walked, names, arrow), schema))
        path = piece.drop("goes_on") if path is None else cut(path.unionByName(piece.drop("goes_on")))
        front = piece.where("goes_on").select("fst", "l", "r")
        if not front.limit(1).count():
            return path


def best_labels(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """(fst, cost, labels): cost and output labels, without epsilons, of the best accepted paths."""
    whole, blocks = _best(left, right, block)
    found = whole.select("fst", "cost", F.filter(F.col("path.out"), lambda c: c != 0).alias("labels"))
    if not blocks:
        return found
    ends, path = blocks
    told = path.where("out <> 0").groupBy("fst").agg(F.array_sort(F.collect_list(F.struct("place", "out"))).alias("_path"))
    labels = F.coalesce(F.transform("_path", lambda x: x["out"]), F.expr("cast(array() as array<int>)"))
    return found.unionByName(ends.join(told, "fst", "left").select("fst", "cost", labels.alias("labels")))


def texts(lattices: tuple[DataFrame, DataFrame], models: tuple[DataFrame, DataFrame], block: int = BLOCK) -> DataFrame:
    """(fst, cost, text): the best text of each lattice under the language model of the same fst."""
    best = best_labels(lattices, models, block)
    return best.select("fst", "cost", F.concat_ws("", F.transform("labels", lambda c: F.chr(c))).alias("text"))
