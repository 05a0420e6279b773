"""SimHash near-duplicates: fingerprints, a binary-trie self-join, and connected components.

Fingerprints that differ in few bits are found by a binary trie of the sorted fingerprints:
pairs of nodes are walked down together, differing bits add up, and a pair is dropped when
they exceed the budget. To spread the trie over tasks, fingerprints are dealt by blocks of
bits: with a budget of k bits and k + 1 blocks, two linked fingerprints agree on one block at
least, so each trie holds the fingerprints that share one block. A trie of more than TRIE
fingerprints is dealt again, by blocks of the bits that are left, until it is small; this
loses no link, whatever the skew.

Equal fingerprints count once, and each task returns a spanning forest of the links that it
finds, so a group of n copies costs n rows and not n * n.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; texts of
fewer words than a shingle are one shingle; rows of equal text share a component; a row
without an id gets a component of the others' ids, or null if there is none; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import compact, reliable

#: Most fingerprints of one trie, and most pairs of a step of the walk over several tries.
TRIE, STEP_PAIRS = 512, 2_000_000
#: Edges that a task contracts at once.
BLOCK_EDGES = 200_000
#: Tables of so many rows at most are broadcast (16 bytes each).
BROADCAST_ROWS = 10_000
MASK = (1 << 64) - 1


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """Hashes of the text's shingles, repeats included, in their order."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([h(b" ".join(w), seed)], dtype=np.uint64)
    return np.array([h(b" ".join(w[i : i + words]), seed) for i in range(len(w) - words + 1)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, unsigned."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                fp = np.array([simhash(shingle_hashes(t, words, seed)) for t in cut.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def walk(fps: np.ndarray, first: np.ndarray, last: np.ndarray, budget: int, done=None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of all pairs within `budget` bits in the same trie.

    fps: unsigned; trie k is fps[first[k]:last[k]], sorted. A node is a range of fps, and all
    node pairs of a level go down together. done(alo, ahi, blo, bhi) may tell node pairs whose
    pairs are of no use; equal fingerprints make a pair like any others.
    """
    bits_below = np.zeros(len(fps) + 1, dtype=np.int64)
    alo, ahi = first.astype(np.int64), last.astype(np.int64)
    blo, bhi, diff = alo.copy(), ahi.copy(), np.zeros(len(alo), dtype=np.int8)
    found_a, found_b = [], []
    for bit in range(63, -1, -1):
        # Pairs of single fingerprints are settled at once.
        ends = (ahi - alo == 1) & (bhi - blo == 1)
        if ends.any():
            a, b = alo[ends], blo[ends]
            good = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= budget)
            found_a.append(a[good])
            found_b.append(b[good])
            alo, ahi, blo, bhi, diff = (x[~ends] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            break
        np.cumsum(fps >> np.uint64(bit) & np.uint64(1), out=bits_below[1:])
        amid = ahi - (bits_below[ahi] - bits_below[alo])
        bmid = bhi - (bits_below[bhi] - bits_below[blo])
        same = alo == blo  # a node with itself: its two children with themselves and with each other once
        down = [
            (alo, amid, blo, bmid, diff, None),
            (amid, ahi, bmid, bhi, diff, None),
            (alo, amid, bmid, bhi, diff + 1, None),
            (amid, ahi, blo, bmid, diff + 1, ~same),
        ]
        parts = []
        for lo1, hi1, lo2, hi2, d, only in down:
            keep = (hi1 > lo1) & (hi2 > lo2) & (d <= budget) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
            if only is not None:
                keep &= only
            parts.append(tuple(x[keep] for x in (lo1, hi1, lo2, hi2, d)))
        alo, ahi, blo, bhi, diff = (np.concatenate([p[k] for p in parts]) for k in range(5))
        if done is not None and len(alo):
            use = ~done(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, diff = (x[use] for x in (alo, ahi, blo, bhi, diff))
    # All bits are read: each fingerprint of one node with each of the other, or of the same node.
    n = (ahi - alo) * (bhi - blo)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(bhi - blo, n)
    a, b = np.repeat(alo, n) + at // np.maximum(wide, 1), np.repeat(blo, n) + at % np.maximum(wide, 1)
    good = (np.repeat(alo != blo, n)) | (a < b)
    found_a.append(a[good])
    found_b.append(b[good])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def first_masks(budget: int) -> list[int]:
    """budget + 1 blocks that share out the 64 bits."""
    return split_mask(MASK, budget + 1)


def split_mask(free: int, parts: int) -> list[int]:
    bits = [k for k in range(63, -1, -1) if free >> k & 1]
    cuts = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << k for k in bits[cuts[j] : cuts[j + 1]]) for j in range(parts)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(fps: DataFrame, budget: int, most: int = TRIE) -> DataFrame:
    """(mask, value, fp): every fingerprint in a trie for each block, tries of over `most` dealt again."""
    masks = first_masks(budget)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    while True:
        free = 64 - max(bin(m).count("1") for m in masks)
        hot = compact(rows.groupBy("mask", "value").count().where(F.col("count") > most).select("mask", "value")) if 2**free > most else None
        n_hot = hot.limit(BROADCAST_ROWS + 1).count() if hot is not None else 0
        if not n_hot:
            return rows if done is None else done.unionByName(rows)
        key = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        cold = rows.join(key, ["mask", "value"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        used = {r["mask"] & MASK for r in hot.select("mask").distinct().collect()}  # of len(masks) at most
        children = {m: [m | c for c in split_mask(MASK & ~m, budget + 1)] for m in masks if m in used}
        into = None
        for m, c in children.items():
            test, value = F.col("mask") == signed(m), F.array(*(F.lit(signed(x)) for x in c))
            into = F.when(test, value) if into is None else into.when(test, value)
        rows = rows.join(key, ["mask", "value"], "left_semi").select("fp", F.explode(into).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = [x for c in children.values() for x in c]


def link(fps: DataFrame, budget: int = 2, most: int = TRIE) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints, from all tries."""

    def settle(mask, value, fp):
        order = np.lexsort((fp, value, mask))
        mask, value, fp = mask[order], value[order], fp[order]
        starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
        ends = np.concatenate((starts[1:], [len(fp)]))
        many = ends - starts > 1
        starts, ends = starts[many], ends[many]
        cost = np.cumsum((ends - starts) ** 2)
        left, right = [], []
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + STEP_PAIRS, side="right")))
            lo, hi = starts[at], ends[stop - 1]
            a, b = walk(fp[lo:hi], starts[at:stop] - lo, ends[at:stop] - lo, budget)
            if len(a):
                own, code = np.unique(np.concatenate((fp[lo:hi][a], fp[lo:hi][b])), return_inverse=True)
                label = forest(len(own), code[: len(a)], code[len(a) :])
                moved = np.flatnonzero(label != np.arange(len(own)))
                left.append(own[moved])
                right.append(own[label[moved]])
            at = stop
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            n += batch.num_rows
            if n >= 200_000:
                mask, value, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                # The rows come sorted by trie; the last trie may go on in the next batch.
                cut = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                yield from settle(mask[:cut], value[:cut], fp[:cut].view(np.uint64))
                held, n = [(mask[cut:], value[cut:], fp[cut:])], len(fp) - cut
        if n:
            mask, value, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from settle(mask, value, fp.view(np.uint64))

    tries = deal(fps, budget, most)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tries.select("mask", "value", "fp").repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a long, b long").distinct()


def contract(edges: DataFrame, block: int = BLOCK_EDGES) -> DataFrame:
    """(a, b), a > b: the edges of each block of a partition, as those from each node to the least node that it reaches in the block.

    Components stay as they are: each block's own are kept, and with them all that its edges join.
    """

    def settle(held):
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        own, code = np.unique(np.concatenate((a, b)), return_inverse=True)
        label = forest(len(own), code[: len(a)], code[len(a) :])
        moved = np.flatnonzero(label != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                n += held[-1].num_rows
                if n >= block:
                    yield settle(held)
                    held, n = [], 0
        if held:
            yield settle(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, block: int = BLOCK_EDGES) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots, by hooking to the least neighbour and contraction.

    Each block of edges is contracted to stars first, so chains and cycles within a block cost
    no round. A round points every node to its least neighbour, shortens the pointers to the
    roots, and relabels the edges; at least half of the nodes that still have edges go in a round.
    """
    e = reliable(contract(compact(edges.where("a <> b")), block))
    found = None
    while not e.isEmpty():
        up = compact(e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")))
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            up2 = compact(up.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            up = up2.select("node", "root")
            if up2.where("moved").isEmpty():
                break
        move = lambda df, c: df.join(up.select(F.col("node").alias(c), F.col("root").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        found = up if found is None else move(found, "root").select("node", "root").unionByName(up)
        found = compact(found)
        e = compact(move(move(e, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return found if found is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def assign(rows: DataFrame, budget: int = 2, most: int = TRIE) -> DataFrame:
    """(id, fp, component_id) of rows (id, fp)."""
    rows = reliable(rows)
    classes = compact(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(link(classes.select("fp"), budget, most))
    linked = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "top")
    # By another expression than the sums are dealt by, so that a component or fingerprint of very many rows can be split.
    classes = linked.join(least, F.bitwise_not("root") == F.bitwise_not("top")).select("fp", "component_id")
    return rows.join(classes.withColumnRenamed("fp", "other"), F.bitwise_not("fp") == F.bitwise_not("other")).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs."""
    found = assign(fingerprints(docs, id_col, text_col, words, seed), budget)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
