"""Binary automaton files: tables of arcs and nodes from and to the vector format of weighted transducers.

A file is a row (path, content), as Spark's binaryFile source reads it from any store and as
Parquet keeps it; so files of one table are read and written by as many tasks as it has
partitions, and a task that is run again writes nothing twice. One automaton is held at a time.

Layout, all little-endian: the magic number, the strings "vector" and "standard" (length, bytes),
version and flags of 32 bits, properties, start, number of states and of arcs of 64 bits, the
symbol tables that the flags tell of; then for each state its accept cost as a 32-bit
float, the number of its arcs of 64 bits, and 16 bytes for each arc: input, output, cost, target.

Defined cases: an infinite or very large accept cost stands for a state that does not accept; a file
whose start is not state 0 comes out with its states 0 and start exchanged; damaged files (magic number, kind,
version, a count or target out of range, too short or too long) are refused: with their error in a
column, or by failing the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, SYMBOLS_MAGIC = 2125659606, 2125658996
KIND, ARC_KIND = b"vector", b"standard"
LEAST_VERSION, PROPERTIES = 2, 3
INPUT_SYMBOLS, OUTPUT_SYMBOLS = 1, 2
#: Accept costs from here on mean that a state does not accept.
NO_ACCEPT = 1e30

_HEAD = struct.Struct("<iiqqqq")
_ARC = np.dtype([("inp", "<i4"), ("out", "<i4"), ("cost", "<f4"), ("dst", "<i4")])


class Damaged(ValueError):
    """A file that does not hold to the format."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Damaged("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def text(self) -> bytes:
        return self.take(self.number("i"))

    def skip_symbols(self) -> None:
        if self.number("i") != SYMBOLS_MAGIC:
            raise Damaged("a symbol table has another magic number")
        self.text()
        self.take(8)
        for _ in range(self.number("q")):
            self.text()
            self.take(8)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accept cost of each state, number of arcs of each state, all arcs in the order of their states)."""
    r = _Reader(data)
    if r.number("i") != MAGIC:
        raise Damaged("another magic number")
    if (r.text(), r.text()) != (KIND, ARC_KIND):
        raise Damaged("another kind of automaton or arc")
    version, flags, _, start, states, _ = _HEAD.unpack(r.take(_HEAD.size))
    if version < LEAST_VERSION:
        raise Damaged("the version is too old")
    for flag in (INPUT_SYMBOLS, OUTPUT_SYMBOLS):
        if flags & flag:
            r.skip_symbols()
    # A state takes twelve bytes at least, so a wrong count is told before anything is made.
    if not 0 <= states <= (len(data) - r.at) // 12 or not (0 <= start < states or states == 0):
        raise Damaged("the number of states or the start is out of range")
    accept, degree, arcs = np.empty(states), np.empty(states, np.int64), []
    for k in range(states):
        accept[k], degree[k] = r.number("f"), r.number("q")
        arcs.append(np.frombuffer(r.take(int(degree[k]) * _ARC.itemsize), _ARC))
    if r.at != len(data):
        raise Damaged("the file goes on behind its last state")
    every = np.concatenate(arcs) if arcs else np.empty(0, _ARC)
    if len(every) and not (0 <= every["dst"].min() and every["dst"].max() < states):
        raise Damaged("an arc leads to no state")
    if start:
        swap = np.arange(states)
        swap[[0, start]] = swap[[start, 0]]
        every = every.copy()
        every["dst"] = swap[every["dst"]]
        pieces = np.split(every, np.cumsum(degree)[:-1])
        every, accept, degree = np.concatenate([pieces[k] for k in swap]), accept[swap], degree[swap]
    return accept, degree, every


def encode(accept: np.ndarray, degree: np.ndarray, arcs: np.ndarray) -> bytes:
    """The file of states in order, with their arcs in the same order."""
    out = [struct.pack("<i", MAGIC), *(struct.pack("<i", len(s)) + s for s in (KIND, ARC_KIND)), _HEAD.pack(LEAST_VERSION, 0, PROPERTIES, 0, len(accept), 0)]
    body, at = arcs.astype(_ARC).tobytes(), 0
    for cost, n in zip(accept.tolist(), degree.tolist(), strict=True):
        out.append(struct.pack("<fq", cost, n) + body[at : at + n * _ARC.itemsize])
        at += n * _ARC.itemsize
    return b"".join(out)


_READ = "path string, state int, accept float, inp array<int>, out array<int>, cost array<float>, dst array<int>, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _READ.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.float32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.string()]
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            try:
                accept, degree, arcs = decode(content.as_py() or b"")
            except Damaged as e:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, None, None, None, None, None, None, str(e)), kinds, strict=True)], names)
                continue
            n = len(accept)
            offsets = pa.array(np.concatenate(([0], np.cumsum(degree))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(arcs[f]))) for f in ("inp", "out", "cost", "dst")]
            costs = pa.array(accept.astype(np.float32), mask=~(accept < NO_ACCEPT))
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), costs, *lists, pa.nulls(n, pa.string())], names)


def read_states(files: DataFrame) -> DataFrame:
    """(path, state, accept, inp, out, cost, dst, error): a row for each state of the files (path, content) with its arcs as arrays; for a damaged file one row with the error."""
    return files.select("path", "content").mapInArrow(_read, _READ)


def read_automata(files: DataFrame, skip_damaged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(arcs: fst, src, dst, inp, out, cost; nodes: fst, id, accept) of the files (path, content), fst being the path."""
    states = read_states(files)
    states = states.where("error is null") if skip_damaged else states.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))).otherwise(F.lit(True)))
    each = states.select(F.col("path").alias("fst"), F.col("state").alias("src"), F.explode(F.arrays_zip("dst", "inp", "out", "cost")).alias("a"))
    arcs = each.select("fst", "src", "a.dst", "a.inp", "a.out", F.col("a.cost").cast("double").alias("cost"))
    return arcs, states.select(F.col("path").alias("fst"), F.col("state").alias("id"), F.col("accept").cast("double").alias("accept"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fst and id; an automaton is held until its last state has come."""
    key, accept, degree, arcs = None, [], [], []

    def flush() -> pa.RecordBatch:
        every = np.array([tuple(a[f] for f in ("inp", "out", "cost", "dst")) for a in arcs], _ARC)
        data = encode(np.array(accept, np.float32), np.array(degree, np.int64), every)
        return pa.RecordBatch.from_pydict({"path": pa.array([key], pa.string()), "content": pa.array([data], pa.binary())})

    for batch in batches:
        for fst, at, cost, own in zip(*(batch[c].to_pylist() for c in ("fst", "id", "accept", "arcs")), strict=True):
            if key is not None and fst != key:
                yield flush()
                accept, degree, arcs = [], [], []
            key = fst
            if at != len(accept):
                raise Damaged(f"the states of {fst} are not numbered from 0 without a gap")
            accept.append(float("inf") if cost is None else cost)
            degree.append(len(own or ()))
            arcs += own or ()
    if key is not None:
        yield flush()


def write_automata(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, content): a file for each automaton, path being its fst; the arcs of a state go by target, labels and cost."""
    own = arcs.groupBy("fst", F.col("src").cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "inp", "out", "cost"))).alias("arcs"))
    states = nodes.select("fst", F.col("id").cast("long").alias("id"), F.col("accept").cast("double").alias("accept")).join(own, ["fst", "id"], "left")
    rows = states.select(F.col("fst").cast("string").alias("fst"), "id", "accept", "arcs")
    return rows.repartition(F.xxhash64("fst")).sortWithinPartitions("fst", "id").mapInArrow(_write, "path string, content binary")
