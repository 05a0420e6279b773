"""Best paths by blocks against a plain search over all pairs of states, and long chains."""

import heapq
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import automata, search

ARC, NODE = "fst long, src int, dst int, inp int, out int, cost double", "fst long, id int, accept double"


def plain(left, right, accept_left, accept_right):
    """(cost, labels) of the best path of a composition by Dijkstra over pairs, or None; of equal costs any labels may come."""
    seen, heap = set(), [(0.0, 0, 0, ())]
    best = None
    while heap:
        g, a, b, labels = heapq.heappop(heap)
        if (a, b) in seen:
            continue
        seen.add((a, b))
        if a in accept_left and b in accept_right:
            total = g + accept_left[a] + accept_right[b]
            if best is None or total < best[0]:
                best = (total, labels)
        for s, d, _, o, c in left:
            if s != a:
                continue
            if o == 0:
                heapq.heappush(heap, (g + c, d, b, labels))
            for s2, d2, i2, o2, c2 in right:
                if s2 == b and i2 == o != 0:
                    heapq.heappush(heap, (g + c + c2, d, d2, (*labels, o2) if o2 else labels))
        for s2, d2, i2, o2, c2 in right:
            if s2 == b and i2 == 0:
                heapq.heappush(heap, (g + c2, a, d2, (*labels, o2) if o2 else labels))
    return best


def automaton(rng, n, arcs, labels, cyclic):
    out = []
    for _ in range(arcs):
        s, d = rng.randrange(n), rng.randrange(n)
        if not cyclic and d <= s:
            s, d = min(s, d), max(s, d) + (s == d)
        out.append((s, min(d, n - 1), rng.choice(labels), rng.choice(labels), rng.random() * 10))
    return [a for a in out if cyclic or a[0] < a[1]], {rng.randrange(n): rng.random() for _ in range(2)}


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    return {k: (*automaton(rng, 12, 40, [0, 97, 98, 99], k % 2), *automaton(rng, 7, 30, [0, 97, 98, 99], True)) for k in range(12)}


def tables(spark, pairs, at):
    arcs = [(k, *a) for k, p in pairs.items() for a in p[at]]
    nodes = [(k, i, p[at + 1].get(i)) for k, p in pairs.items() for i in range(12)]
    return spark.createDataFrame(arcs, ARC), spark.createDataFrame(nodes, NODE)


@pytest.mark.parametrize("block", [3, 4096])
def test_composition_equals_plain_search(spark, pairs, block):
    want = {k: plain(p[0], p[2], p[1], p[3]) for k, p in pairs.items()}
    got = {r["fst"]: r for r in search.best_labels(tables(spark, pairs, 0), tables(spark, pairs, 2), block).collect()}
    assert set(got) == {k for k, w in want.items() if w}
    assert len(got) > 3
    for k, r in got.items():
        assert r["cost"] == pytest.approx(want[k][0])
        assert tuple(r["labels"]) == want[k][1]


def test_path_rows_join_up(spark, pairs):
    ends, path = search.best_arcs(tables(spark, pairs, 0), tables(spark, pairs, 2), 3)
    cost = {r["fst"]: r["cost"] for r in ends.collect()}
    rows = {}
    for r in path.collect():
        rows.setdefault(r["fst"], []).append(r)
    for k, arcs in rows.items():
        arcs.sort(key=lambda r: r["place"])
        assert [r["place"] for r in arcs] == list(range(len(arcs)))
        assert (arcs[0]["l"], arcs[0]["r"]) == (0, 0)
        end = next(r for r in ends.collect() if r["fst"] == k)
        accepts = pairs[k][1][end["l"]] + pairs[k][3][end["r"]]
        assert sum(r["cost"] for r in arcs) + accepts == pytest.approx(cost[k])


def packed(arcs, most):
    """arcs in rows of up to most arcs."""
    row = arcs.groupBy("fst", F.floor((F.col("cost") * 10) % most).alias("k")).agg(F.collect_list(F.struct("src", "dst", "inp", "out", "cost")).alias("arcs"))
    return row.select("fst", "arcs")


def test_small_automata_are_searched_whole(spark, pairs, monkeypatch):
    """Compositions of few arcs take one checkpoint, for the large ones, and no rounds, and rows of several arcs are taken."""
    calls = []
    monkeypatch.setattr(search, "cut", lambda df, cut=search.cut: calls.append(1) or cut(df))
    want = {k: plain(p[0], p[2], p[1], p[3]) for k, p in pairs.items()}
    (left, left_nodes), (right, right_nodes) = tables(spark, pairs, 0), tables(spark, pairs, 2)
    got = {r["fst"]: (pytest.approx(r["cost"]), tuple(r["labels"])) for r in search.best_labels((packed(left, 3), left_nodes), (packed(right, 5), right_nodes)).collect()}
    assert got == {k: w for k, w in want.items() if w}
    assert len(calls) == 1


def test_automata_come_whole_out_of_slices():
    """Rows of an automaton may lie in several batches, and a batch may be a slice of a longer one; nulls stay nulls."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("src", "dst", "inp", "out")] + [("cost", pa.float64())]))
    arc = lambda at, out: dict(src=at, dst=at + 1, inp=1, out=out, cost=0.5)
    rows = [("a", 0, [arc(0, 1), arc(1, 2)]), ("a", 2, [arc(2, 0)]), ("b", 1, []), ("b", 0, [arc(0, None)]), ("c", 3, [arc(7, 7)])]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), kind))], ["fst", "kind", "arcs"])
    want = [("a", ([(0, 1, 1, 1, 0.5), (1, 2, 1, 2, 0.5)], [], [(2, 3, 1, 0, 0.5)], [])), ("b", ([(0, 1, 1, None, 0.5)], [], [], [])), ("c", ([], [], [], [(7, 8, 1, 7, 0.5)]))]
    for cuts in ([0, 5], [0, 1, 5], [0, 1, 2, 3, 4, 5], [0, 3, 3, 5]):
        assert list(search._wholes(whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))) == want


@pytest.mark.parametrize("composed", [True, False])
def test_whole_and_blocks_agree_on_ties(spark, composed):
    """Of many paths of equal cost, circles of no cost among them, both searches take the same; automata of both kinds stand in one table."""
    rng = random.Random(9)
    whole = lambda arcs: [(s, d, i, o, float(int(c) % 3)) for s, d, i, o, c in arcs]
    ties = {}
    for k in range(40):
        (a, a_ends), (b, b_ends) = automaton(rng, 9, 30 if k % 3 else 4, [0, 97, 98], True), automaton(rng, 5, 20 if k % 3 else 2, [0, 97, 98], True)
        ties[k] = whole(a), {i: 1.0 for i in a_ends}, whole(b), {i: 0.0 for i in b_ends}
    left, right = tables(spark, ties, 0), tables(spark, ties, 2) if composed else None
    rows = lambda df: sorted(map(tuple, df.collect()))
    place = ["fst", "place", "l", "r", "inp", "out", "cost"]
    ends, path = search._by_blocks(left, right, 3)
    assert 10 < ends.count() < 40
    for block in (3, 4096):
        got_ends, got_path = search.best_arcs(left, right, block)
        assert rows(got_ends) == rows(ends)
        assert rows(got_path.select(place)) == rows(path.select(place))
    large = {r["fst"] for r in search._large(left[0], right and right[0], 3).collect()}
    assert 0 < len(large) < 40


def test_long_chain_is_whole(spark):
    """A line of 50,000 arcs goes back through a dozen blocks and comes out whole; one without an end has no row."""
    n = 50_000
    arcs = spark.range(n).selectExpr("0L fst", "cast(id as int) src", "cast(id + 1 as int) dst", "cast(97 + id % 26 as int) inp", "cast(97 + id % 26 as int) out", "1D cost")
    more = arcs.union(arcs.where("src < 9").selectExpr("1L", "src", "dst", "inp", "out", "cost"))
    nodes = spark.createDataFrame([(0, n, 0.5), (1, 9, None)], NODE)
    got = search.best_labels((more, nodes)).collect()
    assert [(r["fst"], r["cost"]) for r in got] == [(0, n + 0.5)]
    assert got[0]["labels"] == [97 + k % 26 for k in range(n)]


def test_zero_cost_circle_and_empty(spark):
    """Epsilon circles of no cost end; a start that accepts needs no arc; no arcs and no accepting node give no row."""
    arcs = spark.createDataFrame([(0, 0, 1, 0, 0, 0.0), (0, 1, 0, 0, 0, 0.0), (0, 1, 2, 98, 98, 0.0), (0, 2, 1, 0, 0, 0.0)], ARC)
    nodes = spark.createDataFrame([(0, 2, 0.0), (5, 0, 2.0), (6, 0, None)], NODE)
    got = {r["fst"]: (r["cost"], r["labels"]) for r in search.best_labels((arcs, nodes)).collect()}
    assert got == {0: (0.0, [98]), 5: (2.0, [])}
    assert search.best_labels((arcs.where("false"), nodes.where("false"))).collect() == []


def test_cost_to_accept(spark, pairs):
    arcs, nodes = tables(spark, pairs, 0)
    got = {(r["fst"], r["id"]): r["h"] for r in search.cost_to_accept(arcs, nodes, 3).collect()}
    for k, p in pairs.items():
        least = dict(p[1])
        for _ in range(20):
            for s, d, _, _, c in p[0]:
                if d in least and least[d] + c < least.get(s, 1e30):
                    least[s] = least[d] + c
        assert {i: v for (f, i), v in got.items() if f == k} == pytest.approx(least)


def test_best_paths_of_texts(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, ""), (3, "x" * 9000)], "id long, t string")
    arcs, nodes = automata.line(texts, "id", "t")
    got = {r["fst"]: r["t"] for r in search.best_labels((arcs, nodes)).select("fst", automata.to_text("labels").alias("t")).collect()}
    assert got == {1: "abc", 2: "", 3: "x" * 9000}
