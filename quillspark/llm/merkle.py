"""Merkle manifest of a dataset: DuckDB hashes blocks of leaves on the executors, Spark joins them.

The leaves of a tree are numbered by a sort over range partitions, dealt into aligned blocks of
FANOUT ** depth consecutive ones, and every block goes to DuckDB as one Arrow table: level
queries of an ordered string_agg and sha256 give the block's root. The block roots are the
leaves of the next block level, until each tree has one root; the roots of the trees are the
leaves of one more tree. On the way down each block meets the proof of its own root (a join by
block), adds the proofs within the block, and folds its leaves up to the root.

No task holds more than one block and one proof, however large a tree is.

Defined cases: null and empty values differ ("-" and "0:"); a null id comes first and is never
tampered with; rows of equal id follow the order of their leaves, so repeated rows get proofs of
their own; an empty table has no rows; a table of one row has its leaf as the root and the hash of the
empty string as the proof. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, named, reliable

# Fixed values of the contract.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EACH = 3

#: Levels that DuckDB hashes in one block: 4,096 leaves.
DEPTH = 4

_HEX = 64
_PATH = "array<struct<before:string,after:string>>"


@lru_cache(maxsize=1)
def _engine() -> duckdb.DuckDBPyConnection:
    """One DuckDB for each Python worker, on one thread and without files."""
    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '256MB'; SET temp_directory = ''")
    return con


def _levels(block: pa.Table, depth: int, with_paths: bool) -> tuple[str, str]:
    """(root of the block, name of the table of its levels' proofs).

    block has place (in the tree), hash and of, the number of leaves of the whole tree. The
    table _paths has place, level, before and after: the hashes of the node's siblings.
    """
    con, n = _engine(), block["of"][0].as_py()
    con.register("_given", block.select(["place", "hash"]))
    con.execute("CREATE OR REPLACE TEMP TABLE _nodes AS SELECT place, hash FROM _given")
    con.unregister("_given")
    con.execute("CREATE OR REPLACE TEMP TABLE _above AS SELECT place, place AS node FROM _nodes")
    con.execute("CREATE OR REPLACE TEMP TABLE _paths (place BIGINT, level INTEGER, before VARCHAR, after VARCHAR)")
    level = 0
    while n > 1 and level < depth:
        con.execute(f"CREATE OR REPLACE TEMP TABLE _runs AS SELECT place // {FANOUT} AS run, string_agg(hash, '' ORDER BY place) AS all_of FROM _nodes GROUP BY 1")
        if with_paths:
            con.execute(
                f"""INSERT INTO _paths SELECT a.place, {level}, substr(r.all_of, 1, {_HEX} * (a.node % {FANOUT})), substr(r.all_of, {_HEX} * (a.node % {FANOUT} + 1) + 1)
                FROM _above a JOIN _runs r ON r.run = a.node // {FANOUT}"""
            )
            con.execute(f"UPDATE _above SET node = node // {FANOUT}")
        con.execute("CREATE OR REPLACE TEMP TABLE _nodes AS SELECT run AS place, sha256(all_of) AS hash FROM _runs")
        n, level = -(-n // FANOUT), level + 1
    return con.execute("SELECT hash FROM _nodes").fetchall()[0][0], "_paths"


def _block_root(depth: int, block: pa.Table) -> pa.Table:
    root, _ = _levels(block, depth, False)
    return pa.table({"tree": block["tree"][:1], "place": block["block"][:1], "hash": pa.array([root], pa.string())})


def _outer(above: pa.Table) -> tuple[list[dict], str]:
    return above["path"][0].as_py(), above["root"][0].as_py()


def _with_paths(depth: int, block: pa.Table, above: pa.Table) -> pa.Table:
    """Each node of a block with its whole path: that within the block, then that of the block's root."""
    path, root = _outer(above)
    _, paths = _levels(block, depth, True)
    made = _engine().execute(
        f"""SELECT g.place, coalesce(p.path, []) AS path FROM _above g
        LEFT JOIN (SELECT place, list(struct_pack(before := before, after := after) ORDER BY level) AS path FROM {paths} GROUP BY place) p ON p.place = g.place ORDER BY g.place"""
    ).fetchall()
    tree = block["tree"][0].as_py()
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"tree": pa.array([tree] * len(made), block["tree"].type), "place": pa.array([r[0] for r in made], pa.int64()), "path": pa.array([r[1] + path for r in made], kind), "root": pa.array([root] * len(made), pa.string())})


def _proved(depth: int, block: pa.Table, above: pa.Table) -> pa.Table:
    """The leaves of a block with the hash of their proofs, and the root that their (tampered) hashes fold up to."""
    con, (path, root) = _engine(), _outer(above)
    _, paths = _levels(block, depth, True)
    con.register("_leaves", block.select(["place", "tampered"]))
    con.execute("CREATE OR REPLACE TEMP TABLE _fold AS SELECT place, tampered AS hash, '' AS proof FROM _leaves")
    con.unregister("_leaves")
    for (level,) in con.execute(f"SELECT DISTINCT level FROM {paths} ORDER BY level").fetchall():
        con.execute(
            f"""CREATE OR REPLACE TEMP TABLE _fold AS SELECT f.place, sha256(concat(p.before, f.hash, p.after)) AS hash, concat(f.proof, p.before, p.after) AS proof
            FROM _fold f JOIN {paths} p ON p.place = f.place AND p.level = {level}"""
        )
    for step in path:  # beyond the block all leaves share their siblings
        con.execute("CREATE OR REPLACE TEMP TABLE _fold AS SELECT place, sha256(concat(?, hash, ?)) AS hash, proof FROM _fold", [step["before"], step["after"]])
    outer = "".join(s["before"] + s["after"] for s in path)
    folded = con.sql("SELECT hash, sha256(concat(proof, ?)) AS proof FROM _fold ORDER BY place", params=[outer]).to_arrow_table()
    leaves = block.sort_by("place")
    n = leaves.num_rows
    subroot = above["subroot"][0].as_py()
    return pa.table(
        {
            "id": leaves["id"], "leaf": leaves["hash"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": folded["proof"].cast(pa.string()), "folded_root": folded["hash"].cast(pa.string()),
        }
    )


def numbered(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """nodes with place (from 0, within its tree, by order) and of (the tree's number of nodes).

    One sort over range partitions; then each partition's rows of a tree are counted, and only
    these counts (a row for each partition and tree) are added up over the tree.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = reliable(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = dealt.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("of"))
    met = dealt.join(starts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_in")))
    return met.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_tree", "_in", "_shift")


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {FANOUT**depth}"))


def _by_block(run: Callable, depth: int) -> Callable:
    """run for blocks of depth levels, with as many parameters as Spark looks for."""
    if run is _block_root:
        return lambda block: run(depth, block)
    return lambda block, above: run(depth, block, above)


def _roots_of_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, place, hash, of): the nodes that stand depth levels above."""
    kind = nodes.schema["tree"].dataType.simpleString()
    made = _blocks(nodes, depth).select("tree", "block", "place", "hash", "of").groupBy("tree", "block").applyInArrow(_by_block(_block_root, depth), f"tree {kind}, place bigint, hash string")
    sizes = nodes.groupBy("tree").agg(F.max("of").alias("_of")).select(F.col("tree").alias("_tree"), F.expr(f"(_of + {FANOUT**depth - 1}) div {FANOUT**depth}").alias("of"))
    return reliable(made.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree"))


def climb(nodes: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """nodes (tree, place, hash, of), then the block roots above them, up to one root for each tree."""
    levels = [nodes]
    while True:
        levels.append(_roots_of_blocks(levels[-1], depth))
        if not levels[-1].where("of > 1").limit(1).count():
            return levels


def descend(levels: list[DataFrame], top: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, place, path, root) of the nodes levels[1] from the paths of the roots of the trees, top (tree, path, root)."""
    at = levels[-1].select("tree", "place").join(top.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    for nodes in reversed(levels[1:-1]):
        kind = nodes.schema["tree"].dataType.simpleString()
        groups = _blocks(nodes, depth).select("tree", "block", "place", "hash", "of").groupBy("tree", "block")
        met = groups.cogroup(at.withColumn("block", F.col("place")).groupBy("tree", "block"))
        at = reliable(met.applyInArrow(_by_block(_with_paths, depth), f"tree {kind}, place bigint, path {_PATH}, root string"))
    return at


def _coded(column):
    """A value's part of a leaf: its bytes counted, then itself; a dash for null."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(tree, id, hash, tampered): each row's leaf, and the leaf of the row as it is after tampering with some rows' texts."""
    whole = lambda text: F.sha2(F.concat(*(_coded(text if f == text_col else named(f)) for f in fields)), 256)
    code = named(id_col).cast("string")
    tampered = F.when(code.isNotNull() & (F.crc32(code) % TAMPERED_EACH == 0), ascii_lower(named(text_col))).otherwise(named(text_col))
    return docs.select(named(tree_col).alias("tree"), named(id_col).alias("id"), whole(named(text_col)).alias("hash"), whole(tampered).alias("tampered"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs."""
    # Kept narrow before the sort, whose sampling would read all texts again.
    placed = numbered(reliable(leaves(docs, fields, id_col, tree_col, text_col)), "tree", ["id", "hash"])
    levels = climb(placed, depth)
    subroots = levels[-1].select(F.lit(0).alias("all"), F.col("tree").alias("name"), F.col("hash"))
    trees = reliable(numbered(subroots, "all", ["name"]).select(F.col("all").alias("tree"), "place", "hash", "of", "name"))
    upper = climb(trees, depth)
    root = upper[-1].select("tree", F.col("hash").alias("root"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    # The trees' own leaves are one level lower than what descend() returns.
    above = descend([trees.select("tree", "place", "hash", "of"), *upper[1:]], root, depth)
    blocks = _blocks(trees, depth).groupBy("tree", "block").cogroup(above.withColumn("block", F.col("place")).groupBy("tree", "block"))
    paths = blocks.applyInArrow(_by_block(_with_paths, depth), f"tree int, place bigint, path {_PATH}, root string")
    top = trees.select("place", "name", F.col("hash").alias("subroot")).join(paths.select("place", "path", "root"), "place").select(F.col("name").alias("tree"), "path", "root", "subroot")
    outer = reliable(descend(levels, top.select("tree", "path", "root"), depth))
    named_roots = top.select(F.col("tree").alias("_tree"), "subroot")
    outer = outer.join(named_roots, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree").withColumn("block", F.col("place"))
    kind = placed.schema["id"].dataType.simpleString()
    met = _blocks(placed, depth).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    proved = met.applyInArrow(_by_block(_proved, depth), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proved.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
