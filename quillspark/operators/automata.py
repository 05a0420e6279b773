"""Weighted automata as tables: arcs (fst, src, dst, inp, out, cost) and nodes (fst, id, accept); 0 is epsilon.

The start is node 0. Composition is an equi-join on label; the searches for best paths are in search.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.durable import cut

ARC = ("fst", "src", "dst", "inp", "out", "cost")


def line(df: DataFrame, fst: str, text: str) -> tuple[DataFrame, DataFrame]:
    """A linear automaton for each text: (arcs, nodes)."""
    chars = df.select(F.col(fst).alias("fst"), F.filter(F.split(text, ""), lambda c: c != "").alias("cs"))
    arcs = chars.select("fst", F.posexplode("cs").alias("src", "c"))
    code = F.unicode("c") if hasattr(F, "unicode") else F.ascii("c")
    arcs = arcs.select("fst", "src", (F.col("src") + 1).alias("dst"), code.alias("inp"), code.alias("out"), F.lit(0.0).alias("cost"))
    nodes = chars.select("fst", F.explode(F.sequence(F.lit(0), F.size("cs"))).alias("id"), F.size("cs").alias("n"))
    return arcs, nodes.select("fst", "id", F.when(F.col("id") == F.col("n"), 0.0).alias("accept"))


def best_arcs_only(arcs): return arcs.groupBy("fst", "src", "dst").agg(F.min(F.struct("cost", "inp", "out")).alias("m")).select("fst", "src", "dst", "m.inp", "m.out", "m.cost")


def reverse(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs turned round; a new start -1 leads to the accepting nodes at their cost, and node 0 accepts."""
    turned = arcs.select("fst", F.col("dst").alias("src"), F.col("src").alias("dst"), "inp", "out", "cost")
    start = nodes.where("accept is not null").select("fst", F.lit(-1).alias("src"), F.col("id").alias("dst"), F.lit(0).alias("inp"), F.lit(0).alias("out"), F.col("accept").alias("cost"))
    ends = nodes.select("fst", "id", F.when(F.col("id") == 0, 0.0).alias("accept"))
    return turned.unionByName(start), ends


def closure(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs with an epsilon arc from every accepting node back to the start."""
    back = nodes.where("accept is not null").select("fst", F.col("id").alias("src"), F.lit(0).alias("dst"), F.lit(0).alias("inp"), F.lit(0).alias("out"), F.col("accept").alias("cost"))
    return arcs.unionByName(back)


def compose(a: DataFrame, b: DataFrame, a_nodes: DataFrame, b_nodes: DataFrame) -> DataFrame:
    """Arcs of the composition of automata of equal fst: labels joined, epsilon moves of either side kept.

    States are structs (l, r); all pairs of one automaton's states are the domain, so restrict
    the inputs to reachable states where they are large.
    """
    x = a.select("fst", *(F.col(c).alias(f"a_{c}") for c in ARC[1:]))
    y = b.select("fst", *(F.col(c).alias(f"b_{c}") for c in ARC[1:]))
    state = lambda l, r: F.struct(F.col(l).cast("long").alias("l"), F.col(r).cast("long").alias("r"))  # noqa: E731, E741
    both = x.join(y, (x.fst == y.fst) & (x.a_out == y.b_inp) & (x.a_out != 0)).select(x.fst, state("a_src", "b_src").alias("src"), state("a_dst", "b_dst").alias("dst"), F.col("a_inp").alias("inp"), F.col("b_out").alias("out"), (F.col("a_cost") + F.col("b_cost")).alias("cost"))
    left = x.where("a_out = 0").join(b_nodes.select("fst", F.col("id").alias("n")), "fst").select("fst", state("a_src", "n").alias("src"), state("a_dst", "n").alias("dst"), F.col("a_inp").alias("inp"), F.lit(0).alias("out"), F.col("a_cost").alias("cost"))
    right = y.where("b_inp = 0").join(a_nodes.select("fst", F.col("id").alias("n")), "fst").select("fst", state("n", "b_src").alias("src"), state("n", "b_dst").alias("dst"), F.lit(0).alias("inp"), F.col("b_out").alias("out"), F.col("b_cost").alias("cost"))
    return both.unionByName(left).unionByName(right)


def best_paths(arcs: DataFrame, nodes: DataFrame, beam: int | None = None) -> DataFrame:
    """(fst, cost, labels): the least-cost accepted path of each automaton and its output labels.

    The search settles blocks of states (see search.py). With a beam only the best states of a
    step go on, and the result may miss the best path. Costs must not be negative.
    """
    return search.best_labels((arcs, nodes)) if beam is None else _beam_paths(arcs, nodes, beam)


def _beam_paths(arcs: DataFrame, nodes: DataFrame, beam: int) -> DataFrame:
    """Step by step the beam best states that improved, until none does."""
    best = nodes.select("fst").distinct().select("fst", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("cost"), F.expr("cast(array() as array<int>)").alias("labels"))
    front = best = cut(best)
    arcs = cut(arcs.select("fst", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "out", "cost"))
    while front.limit(1).count():
        few = front.withColumn("k", F.row_number().over(Window.partitionBy("fst").orderBy("cost", "id"))).where(F.col("k") <= beam).drop("k")
        out = F.when(F.col("e.out") == 0, F.col("f.labels")).otherwise(F.concat(F.col("f.labels"), F.array(F.col("e.out").cast("int"))))
        step = few.alias("f").join(arcs.alias("e"), (F.col("f.fst") == F.col("e.fst")) & (F.col("f.id") == F.col("e.src"))).select("f.fst", F.col("e.dst").alias("id"), (F.col("f.cost") + F.col("e.cost")).alias("cost"), out.alias("labels"))
        step = step.groupBy("fst", "id").agg(F.min(F.struct("cost", "labels")).alias("n"))
        newer = F.col("n").isNotNull() & (F.col("cost").isNull() | (F.col("n.cost") < F.col("cost")))
        both = cut(best.join(step, ["fst", "id"], "full").select("fst", "id", F.when(newer, F.col("n")).otherwise(F.struct("cost", "labels")).alias("m"), newer.alias("new")))
        best = both.select("fst", "id", "m.cost", "m.labels")
        front = both.where("new").select("fst", "id", "m.cost", "m.labels")
    ends = best.join(nodes.where("accept is not null").select("fst", F.col("id").cast("long").alias("id"), "accept"), ["fst", "id"])
    return ends.groupBy("fst").agg(F.min(F.struct((F.col("cost") + F.col("accept")).alias("cost"), "labels")).alias("m")).select("fst", "m.cost", "m.labels")


def lattice(groups: DataFrame) -> DataFrame:
    """Arcs from grouped segments (fst, first, last, cls, cost): from the first segment to behind the last."""
    return groups.select("fst", F.col("first").alias("src"), (F.col("last") + 1).alias("dst"), F.col("cls").alias("inp"), F.col("cls").alias("out"), "cost")


def to_text(labels): return F.concat_ws("", F.transform(F.filter(labels, lambda c: c != 0), lambda c: F.chr(c)))


def rescore(arcs: DataFrame, changes: DataFrame) -> DataFrame:
    """arcs with the cost of (fst, src, dst, inp, out, new) for each arc named there; of several equal arcs the cheapest is changed."""
    place = ["fst", "src", "dst", "inp", "out"]
    ranked = arcs.withColumn("k", F.row_number().over(Window.partitionBy(*place).orderBy("cost")))
    met = ranked.join(changes.select(*place, "new").dropDuplicates(place), place, "left")
    return met.select(*place, F.when((F.col("k") == 1) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("cost")).alias("cost"))


def optional_spaces(arcs: DataFrame, nodes: DataFrame, cost: float = 0.0) -> DataFrame:
    """arcs with a loop for a space at every node: a truth whose spaces may be more than written."""
    loop = nodes.select("fst", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(32).alias("inp"), F.lit(32).alias("out"), F.lit(cost).alias("cost"))
    return arcs.select(*ARC).unionByName(loop)


def word_tree(words: DataFrame, word: str) -> DataFrame:
    """(prefix, letter, ends): the edges of the letter tree of a word list; ends tells whether a word ends there."""
    w = words.select(F.col(word).alias("w")).where("w <> ''").distinct()
    steps = w.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    edge = steps.select(F.expr("substring(w, 1, k - 1)").alias("prefix"), F.expr("substring(w, k, 1)").alias("letter"), (F.col("k") == F.length("w")).alias("ends"))
    return edge.groupBy("prefix", "letter").agg(F.max("ends").alias("ends"))


def segments_of_arcs(path: DataFrame) -> DataFrame:
    """(fst, segment, place) from a best path's rows (fst, place, id): an id holds the first and last segment in its halves."""
    first, last = F.shiftright("id", 16), F.col("id").bitwiseAND(F.lit(0xFFFF))
    return path.where(last >= first).select("fst", F.explode(F.sequence(first, last)).alias("segment"), "place")
