"""Automaton files: round trips over several partitions, files by another hand, damaged files."""

import struct

import pytest

from quillspark.sources import automaton_files as A


@pytest.fixture(scope="module")
def tables(spark):
    arcs = [(f"f{k}", i, (i * 7 + j) % (k + 2), j, 100 + j, 0.5 * j) for k in range(9) for i in range(k + 2) for j in range(i % 4)]
    nodes = [(f"f{k}", i, 1.25 if i == k + 1 else None) for k in range(9) for i in range(k + 2)]
    return spark.createDataFrame(arcs, "fst string, src int, dst int, inp int, out int, cost double").repartition(5), spark.createDataFrame(nodes, "fst string, id int, accept double").repartition(3)


def test_round_trip_through_stored_files(spark, tables, tmp_path):
    A.write_automata(*tables).repartition(4).write.parquet(str(tmp_path / "files"))
    arcs, nodes = A.read_automata(spark.read.parquet(str(tmp_path / "files")))
    for got, want in zip((arcs, nodes), tables, strict=True):
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def by_hand(start=0, symbols=b"", flags=0, magic=A.MAGIC, version=2, kind=b"vector", states=2):
    """A file of two states: 0 -97:98/1.5-> 1, and 1 accepts at 0.25."""
    text = lambda s: struct.pack("<i", len(s)) + s
    head = struct.pack("<i", magic) + text(kind) + text(b"standard") + struct.pack("<iiqqqq", version, flags, 3, start, states, 0)
    return head + symbols + struct.pack("<fq", float("inf"), 1) + struct.pack("<iifi", 97, 98, 1.5, 1) + struct.pack("<fq", 0.25, 0)


def test_files_by_another_hand(spark):
    text = lambda s: struct.pack("<i", len(s)) + s
    table = struct.pack("<i", A.SYMBOLS_MAGIC) + text(b"letters") + struct.pack("<qq", 1, 1) + text("ä".encode()) + struct.pack("<q", 97)
    files = spark.createDataFrame([("plain", by_hand()), ("symbols", by_hand(symbols=table * 2, flags=3)), ("turned", by_hand(start=1))], "path string, content binary")
    arcs, nodes = A.read_automata(files)
    assert {tuple(r) for r in arcs.collect()} == {("plain", 0, 1, 97, 98, 1.5), ("symbols", 0, 1, 97, 98, 1.5), ("turned", 1, 0, 97, 98, 1.5)}
    assert {tuple(r) for r in nodes.where("accept is not null").collect()} == {("plain", 1, 0.25), ("symbols", 1, 0.25), ("turned", 0, 0.25)}


def test_damaged_files_are_refused(spark):
    good = by_hand()
    bad = {"magic": by_hand(magic=7), "version": by_hand(version=1), "kind": by_hand(kind=b"const"), "many": by_hand(states=1 << 40), "less": by_hand(states=-1), "short": good[:-3], "long": good + b"x", "empty": b"",
           "target": good[:-16] + struct.pack("<i", 9) + good[-12:], "symbols": by_hand(flags=1)}
    files = spark.createDataFrame([*bad.items(), ("good", good), ("null", None)], "path string, content binary")
    told = {r["path"]: r["error"] for r in A.read_states(files).where("error is not null").collect()}
    assert set(told) == {*bad, "null"}
    arcs, nodes = A.read_automata(files, skip_damaged=True)
    assert arcs.count() == 1 and nodes.count() == 2
    with pytest.raises(Exception, match="magic"):
        A.read_automata(files.where("path = 'magic'"))[0].collect()


def test_gaps_and_empty_tables(spark, tables):
    assert A.write_automata(tables[0].where("false"), tables[1].where("false")).collect() == []
    with pytest.raises(Exception, match="without a gap"):
        A.write_automata(tables[0], tables[1].where("id <> 1")).collect()
