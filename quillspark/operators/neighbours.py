"""Exact nearest neighbours by a join over pivot cells, with bounds from the triangle inequality.

Reference rows are dealt to the nearest of a few pivots; a cell knows its radius and the distances
of its first rows from the pivot. A query's distance to the pivots bounds the distance of its k-th
neighbour from above, and tells the cells that cannot hold a nearer row; it is sent to
the others only. Cells and the queries that visit them are cut into blocks, so that one
cell that holds a third of all rows, or that a third of all queries visit, is many tasks. The best k of all blocks are merged by query.

The driver sees the pivots (PIVOTS vectors at most, a bounded sample by hash), and a few
numbers for each; every reference row is searched.

Defined cases: of equal distances the least id comes first; fewer than k rows give fewer
neighbours; an empty reference gives no rows; vectors must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.durable import cut

#: Pivots at most, and reference rows of a block; a block of queries holds as many times VISITS.
PIVOTS, BLOCK, VISITS = 256, 20_000, 8
#: Queries that are compared with a block at a time, and visits that are worked out at a time.
STEP, VISITED = 256, 16_384


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all rows of b; the pivots are few."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _celled(pivots: np.ndarray):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _apart(_matrix(b["features"]), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "away"])

    return over


def _visits(pivots: np.ndarray, radius: np.ndarray, first: np.ndarray, k: int, most: float):
    """Queries with each cell that may hold one of their k nearest; first[j] are the least distances from pivot j of rows of its cell, infinite where it has fewer."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every cell may be visited, so a part's queries times the cells are bounded.
        step = max(1, VISITED // max(1, len(pivots)))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            d = _apart(_matrix(b["features"]), pivots)
            reach = (d[:, :, None] + first[None]).reshape(len(d), -1)
            bound = np.minimum(np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(d), np.inf), most)
            # Distances come from sums of products, so a little room is left.
            room = 1e-6 * (1 + d.max(1) + radius[np.isfinite(radius)].max(initial=0))
            row, cell = np.nonzero(d - radius[None] <= (bound + room)[:, None])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    return over


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, most: float, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, squared distance) of the k nearest of a block, as indexes; exact differences decide."""
    d = (q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T
    own = q_ids[:, None] == ids[None] if skip_self else np.zeros(d.shape, bool)
    d[own] = np.inf
    room = 1e-9 * (1 + np.abs((q * q).sum(1)) + (v * v).sum(1).max())
    last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    row, at = np.nonzero((d <= np.minimum(last, most * most)[:, None] + room[:, None]) & ~own)
    exact = ((q[row] - v[at]) ** 2).sum(1)
    order = np.lexsort((ids[at], exact, row))
    row, at, exact = row[order], at[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    good = (place < k) & (exact <= most * most)
    return row[good], at[good], exact[good]


def _compare(k: int, most: float, skip_self: bool):
    """Rows sorted by cell, block, part, and references before queries; one block of references is held."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for b in batches:
            where = np.stack([np.asarray(b[c]).astype(np.int64) for c in ("cell", "block", "part", "kind")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(axis=1), [True]))) if len(where) else []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                some, now = b.slice(start, end - start), tuple(where[start, :3].tolist())
                ids, vectors = np.asarray(some["id"]), _matrix(some["features"])
                if now != key:
                    key, held, ready = now, [], None
                if where[start, 3] == 0:
                    held.append((ids, np.asarray(some["cls"].fill_null(-1)), vectors))
                    continue
                if not held and ready is None:
                    continue
                if ready is None:
                    ready, held = tuple(np.concatenate([h[i] for h in held]) for i in range(3)), []
                for first in range(0, len(ids), STEP):
                    part = slice(first, first + STEP)
                    row, at, exact = _best(ids[part], vectors[part], ready[0], ready[2], k, most, skip_self)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][row]), pa.array(ready[0][at]), pa.array(ready[1][at].astype(np.int32)), pa.array(exact)], ["id", "other", "cls", "distance"])

    return over


def nearest(queries: DataFrame, reference: DataFrame, k: int, skip_self: bool = True, most: float = float("inf"), block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(id, rank, other, cls, distance): the k nearest reference rows (id, cls, features) of each query (id, features), by squared distance, within the distance most.

    With skip_self a row of the query's own id is no neighbour.
    """
    need = k + 1 if skip_self else k
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"), *([F.col("cls").cast("int").alias("cls")] if "cls" in df.columns else []))
    reference, queries = typed(reference), typed(queries).drop("cls")
    n = reference.count()
    if not n:
        return queries.where("false").select("id", F.lit(0).alias("rank"), F.col("id").alias("other"), F.lit(0).alias("cls"), F.lit(0.0).alias("distance"))
    chosen = reference.select("features", F.xxhash64("id").alias("h")).orderBy("h").limit(min(pivots, -(-n // block))).collect()
    middle = np.array([r["features"] for r in chosen], dtype=np.float64)
    cells = cut(reference.mapInArrow(_celled(middle), "id long, features array<double>, cls int, cell int, away double"))
    radius, first, sizes = np.full(len(middle), -np.inf), np.full((len(middle), need), np.inf), np.zeros(len(middle), np.int64)
    for r in cells.groupBy("cell").agg(F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
    ranked = cells.select("cell", "away", F.row_number().over(Window.partitionBy("cell").orderBy("away")).alias("r")).where(F.col("r") <= need)
    for r in ranked.collect():
        first[r["cell"], r["r"] - 1] = r["away"]
    visits = queries.mapInArrow(_visits(middle, radius, first, need, most), "id long, features array<double>, cell int")
    visited = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    blocks = [max(1, -(-int(s) // block)) for s in sizes]
    parts = [max(1, -(-visited.get(j, 0) // (VISITS * block))) for j in range(len(middle))]
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("cell") + 1)
    upto = lambda numbers: F.explode(F.sequence(F.lit(0), of(numbers) - 1))
    one = lambda numbers, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), of(numbers)).cast("int")
    left = cells.select("id", "features", "cls", "cell", one(blocks, "block").alias("block"), F.lit(0).alias("kind")).withColumn("part", upto(parts))
    right = visits.select("id", "features", F.lit(None).cast("int").alias("cls"), "cell", one(parts, "part").alias("part"), F.lit(1).alias("kind")).withColumn("block", upto(blocks))
    rows = left.unionByName(right).repartition(F.xxhash64("cell", "block", "part")).sortWithinPartitions("cell", "block", "part", "kind")
    found = rows.mapInArrow(_compare(k, most, skip_self), "id long, other long, cls int, distance double")
    best = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "other", "cls", "distance")
