"""Near-duplicate removal by tries over exact candidate groups: one document of each group stays.

A document is the set of its shingles (64-bit hashes) and the SimHash of that set; two
documents are linked when the Jaccard similarity of their sets is LIKE or more, and the groups
are the components of the links. Documents of equal sets are one class from the start.

Candidates come in three steps, and every candidate is settled by comparing the two whole sets,
but for those that the parities of their sets rule out:

1. the binary-trie self-join of the SimHash operator, over the fingerprints of all classes;
2. stars: every class with one class of each shingle of its prefix;
3. tries over the classes that share a prefix shingle and are still in different components:
   pairs of nodes are walked down together, and dropped when more than BITS bits differ or when
   all their classes are in one component already.

Prefixes lose no pair: with the shingles of every set in one common order, two sets of n and m
shingles and similarity t share at least ceil(t * max(n, m)) of them, so the first
n - ceil(t * n) + 1 of one set and the first m - ceil(t * m) + 1 of the other meet. Any order
does; rare shingles come first here, as counted on a bounded sample of texts, which keeps the
groups of one shingle small and has no say in the result. BITS is so wide that a pair of 0.8
is dropped with a chance of 2 in 10 million, or 13 in a million for sets of four and five
shingles: of 64 bits 9.7 differ on average there, or 12. A shingle of many classes is dealt into parts of GROUP
classes, and every part meets every other.

Parities are one bit for each of some buckets: whether a set has an odd number of shingles
there. Two sets differ in one shingle at least for each bit that differs, so a pair of too many
such bits is no link, whatever the sets are; with two buckets a shingle or more this leaves few
pairs below the limit, and only those have their sets moved, which are 20 to 30 times as large.

Defined cases: texts without words are one class; texts of fewer words than a shingle are one
shingle; of a group the row of the least id stays (rows without an id come last, equal ids go
by the hash of their text), whatever else has its id; of rows of equal id and text one stays;
an empty table stays empty. Columns of the input may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import compact, maybe, reliable, sketch
from quillspark.llm.simhash import BROADCAST_ROWS, components, link, shingle_hashes, simhash, walk

WORDS, LIKE = 5, 0.8
#: Most differing bits of two fingerprints of a trie in step 3.
BITS = 26
#: Classes of one part of a hot shingle; texts and shingles of the sample that orders the shingles.
GROUP, SAMPLE_TEXTS, SAMPLE_SHINGLES = 256, 4_000, 200_000
#: Fingerprints of a trie that are compared without descending it.
FEW = 48
#: Most turns of stars before the rest is compared in full, and classes of a hot shingle that are stars in one turn.
TURNS, CENTRES = 4, 12
#: Links for each comparison of a turn that make another turn worth while.
WORTH = 0.05
#: Below any difference of two fractions of set sizes, above the rounding of a product.
TINY = 1e-9


def shingle_set(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """(class, shingle hashes in rising order): the class is a signed hash of the whole set."""
    h = np.unique(shingle_hashes(text, words, 42))
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)), h


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray, like: float = LIKE) -> np.ndarray:
    """The first n - ceil(like * n) + 1 of n hashes, by their count in the sample (`common` is sorted), then by themselves."""
    if not len(h):
        return h
    seen = np.zeros(len(h), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, seen))[: len(h) - int(np.ceil(like * len(h) - TINY)) + 1]]


def parities(h: np.ndarray) -> bytes:
    """For each of a power of two of buckets, two for each hash at least, whether it holds an odd number of hashes."""
    n = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """The number of hashes at least that one only of two sets has, by their parities."""
    a, b = (np.frombuffer(z, dtype=np.uint8) for z in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # buckets k and k + half become one
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): a row's key is its id and the hash of its text."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))


def _sets(rows: DataFrame, words: int, cut=None) -> DataFrame:
    """(id, h, node, size, fp, hashes, odd) of rows (id, h, text): fp is the fingerprint of the set, odd its parities, and cut(hashes) are kept."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                some = b.slice(part, 256)
                got = [shingle_set(t, words) for t in some.column(2).to_pylist()]
                prints = np.array([simhash(h) for _, h in got], dtype=np.uint64).view(np.int64)
                out = [(cut(h) if cut else h).view(np.int64) for _, h in got]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([len(h) for _, h in got], pa.int64()), pa.array(prints), pa.array(out, pa.list_(pa.int64())), pa.array([parities(h) for _, h in got], pa.binary())],
                    names=["id", "h", "node", "size", "fp", "hashes", "odd"],
                )

    return rows.mapInArrow(run, f"id {kind}, h long, node long, size long, fp long, hashes array<long>, odd binary")


def _common(named: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two sampled texts or more and their counts: it orders the shingles and decides no link."""
    n = named.count()
    some = named.where(F.pmod("h", F.lit(max(1, n // SAMPLE_TEXTS))) == 0).limit(2 * SAMPLE_TEXTS)
    counted = _sets(some, words).dropDuplicates(["node"]).select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1")
    rows = counted.orderBy(F.desc("count"), "h").limit(SAMPLE_SHINGLES).collect()
    h, c = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in rows], dtype=np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def possible(pairs: DataFrame, like: float) -> DataFrame:
    """(a, b) of pairs (a, b, na, nb, shared), with numbers of shared prefix shingles that add up, that the sizes and this sum allow.

    Of the set whose prefix ends first, all shared shingles of the prefix are in both prefixes,
    so the sets share at most these and the rest of that set.
    """
    rest = F.ceil(F.greatest("na", "nb") * F.lit(like) - TINY) - 1
    return (
        pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(like) - TINY)
        .groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        .where(F.col("shared") + rest >= (F.col("na") + F.col("nb")) * F.lit(like / (1 + like)) - TINY).select("a", "b")
    )


def uniform_pairs(root: np.ndarray, alo, ahi, blo, bhi) -> np.ndarray:
    """Which pairs of ranges [alo, ahi) and [blo, bhi) hold one root only."""
    turns = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
    return (turns[alo] == turns[ahi - 1]) & (turns[blo] == turns[bhi - 1]) & (root[alo] == root[blo])


def common_keys(keys: list[np.ndarray], key: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of keys that i and j share, whether one of them is less than `key`) for the nodes of a trie, by their sorted keys."""
    flat = np.concatenate(keys)
    own, code = np.unique(flat, return_inverse=True)
    node = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    often = np.flatnonzero(np.bincount(code) > 1)
    place = np.full(len(own), -1)
    place[often] = np.arange(len(often))
    at, less = place[code], own[often] < key
    shared, before = (np.zeros((len(keys), len(keys)), dtype=np.float32) for _ in range(2))
    for first in range(0, len(often), 2048):  # so that the matrix of nodes and keys is of bounded size
        here = (at >= first) & (at < first + 2048)
        m = np.zeros((len(keys), min(2048, len(often) - first)), dtype=np.float32)
        m[node[here], at[here] - first] = 1
        shared += m @ m.T
        low = m[:, less[first : first + 2048]]
        before += low @ low.T
    return shared, before > 0


def trie_pairs(rows: DataFrame, most: int = GROUP, bits: int = BITS, like: float = LIKE) -> DataFrame:
    """(a, b, na, nb, shared), a < b: the pairs of rows (key, node, size, fp, root, n) within `bits` bits and of different roots.

    n is the key's number of rows. A key of `most` rows at most reports each of its pairs, with
    shared = 1. Larger keys would report the same pairs again and again, so their rows carry
    the larger keys of their node (as many as its prefix has at most): a pair is reported by
    the least larger key that it shares, with the number of these.
    """
    keys = rows.where(F.col("n") > most).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    few = rows.where(F.col("n") <= most).withColumn("keys", F.expr("cast(array() as array<bigint>)"))
    all_rows = few.unionByName(rows.where(F.col("n") > most).join(keys.hint("merge"), "node").select(*few.columns))
    parts = F.ceil(F.col("n") / F.lit(most))
    dealt = all_rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
    # Part i meets every part j from i up: its rows go to the tries (i, j) and (j, i), j the larger one.
    met = dealt.select("key", "node", "size", "fp", "root", "part", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    tries = met.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "node", "size", "root", "keys")

    def settle(x, lists):
        """The pairs of one trie: columns key, i, j, part, fp, node, size, root of its rows, and their larger keys."""
        order = np.lexsort((x[7], x[4].view(np.uint64)))
        key, i, j, part, fp, node, size, root = (c[order] for c in x)
        ends = (np.array([0]), np.array([len(key)]))
        if uniform_pairs(root, *ends, *ends)[0]:
            return None
        if len(key) <= FEW:  # not worth a walk
            a, b = np.triu_indices(len(key), 1)
            near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= bits
            a, b = a[near], b[near]
        else:
            a, b = walk(fp.view(np.uint64), *ends, bits, lambda *r: uniform_pairs(root, *r))
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        good = (root[a] != root[b]) & ((i[0] == j[0]) | (part[a] != part[b])) & (low >= like * high - TINY)
        a, b = a[good], b[good]
        if not len(a):
            return None
        shared = np.ones(len(a), dtype=np.int64)
        if len(lists[0]):
            found, before = (m[a, b] for m in common_keys([lists[k] for k in order], key[0]))
            a, b, shared = a[~before], b[~before], found[~before].astype(np.int64)
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return node[a], node[b], size[a], size[b], shared

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            table = pa.Table.from_batches(held)
            lists = table.column(8).combine_chunks()
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            got = settle([table.column(k).to_numpy() for k in range(8)], [values[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]) if table.num_rows > 1 else None
            if got:
                for cut in range(0, len(got[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[cut : cut + 100_000]) for c in got], names=["a", "b", "na", "nb", "shared"])

        for batch in batches:
            # The rows come sorted by trie, of which one is held at a time.
            key, i, j = (batch.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(key)]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if p == q:
                    continue
                own = (int(key[p]), int(i[p]), int(j[p]))
                if own != last and held:
                    yield from flush()
                    held = []
                held.append(batch.slice(p, q - p))
                last = own
        if held:
            yield from flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tries.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long, na long, nb long, shared long")


def _row_key(key="id", h="h"):
    return F.xxhash64(key, h)


def not_ruled_out(pairs: DataFrame, classes: DataFrame, like: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow a Jaccard similarity of `like`: with n and m shingles, (1 - like) / (1 + like) of n + m differ at most."""
    most = (1 - like) / (1 + like)
    nodes = compact(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    some = maybe(classes.select("node", "size", "odd"), F.col("node"), sketch(nodes, F.col("node")))
    some = reliable(some.join(nodes.hint("merge"), "node", "left_semi"))
    one = lambda c, size, odd: some.select(F.col("node").alias(c), F.col("size").alias(size), F.col("odd").alias(odd))
    sized = pairs.join(one("a", "na", "x").hint("merge"), "a").join(one("b", "nb", "y").hint("merge"), "b")
    sized = sized.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(like) - TINY)

    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = [least_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            good = pa.array(np.array(differ, dtype=np.int64) <= total * most + TINY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return sized.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, named: DataFrame, words: int, like: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of `like` or more.

    One text of each class is read again; it is picked where it lies, so only sets are moved.
    """
    nodes = compact(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    wanted = classes.select("node", "least").join(nodes.hint("merge"), "node", "left_semi")
    some = maybe(named, _row_key(), sketch(wanted.select(_row_key("least.id", "least.h").alias("k")), F.col("k")))
    sets = reliable(_sets(some, words).select("node", "hashes").join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return counted.where(F.col("shared") >= (F.col("total") - F.col("shared")) * F.lit(like) - TINY).select("a", "b")


def _fresh(df: DataFrame) -> DataFrame:
    """df without the size that Spark estimates from its joins: a product whose digits double with each joined round, checkpoints or not."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def _flat(df: DataFrame) -> DataFrame:
    """df in as many partitions as a shuffle makes at most: unions add theirs up."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _joined(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """rows (key, ...) joined to keys (key, n, ...); the rows of the largest keys stay where they are."""
    hot = compact(keys.where(F.col("n") > most).orderBy(F.desc("n"), "key").limit(BROADCAST_ROWS))
    cold = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    return _flat(cold.join(keys.hint("merge"), "key").unionByName(rows.join(F.broadcast(hot), "key")))


def _open(rows: DataFrame, classes: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """rows (key, node) with size, fp, root and n, of the keys whose classes are not all in one component of found."""
    roots = _fresh(components(_fresh(found))).withColumnRenamed("node", "at")
    about = classes.select("node", "size", "fp").join(roots.hint("merge"), F.col("node") == F.col("at"), "left").select("node", "size", "fp", F.coalesce("root", "node").alias("root"))
    rooted = compact(rows.join(about.hint("merge"), "node").select("key", "node", "size", "fp", "root"))
    keys = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "n")
    return compact(_joined(rooted, compact(keys), most))


def _stars(rows: DataFrame, turn: int, most: int, centres: int = 1) -> DataFrame:
    """(a, b, na, nb, shared): the pairs of some classes of each key, the least by hashes of this turn, with the others of the key in other components."""
    one = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(turn * CENTRES + k)).alias("h"), "node", "size", "root"))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(one(k).alias(f"t{k}") for k in range(centres))).where("n > 1")
    tops = F.array_distinct(F.array(*(F.struct(f"t{k}.node", f"t{k}.size", f"t{k}.root") for k in range(centres))))
    met = _joined(rows.select("key", "node", "size", "root"), compact(keys.select("key", "n", tops.alias("tops"))), most)
    met = met.select("key", "node", "size", "root", F.explode("tops").alias("top")).where("root <> top.root")
    low = F.col("node") < F.col("top.node")
    return met.select(
        F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"),
        F.when(low, F.col("size")).otherwise(F.col("top.size")).alias("na"), F.when(low, F.col("top.size")).otherwise(F.col("size")).alias("nb"), F.lit(1).alias("shared"),
    )


def shared_keys(classes: DataFrame, most: int) -> DataFrame:
    """(key, node): the prefix shingles that two classes share at least, which are few of all."""
    rows = classes.select(F.explode("hashes").alias("key"), "node")
    keys = compact(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return compact(_joined(maybe(rows, F.col("key"), sketch(keys, F.col("key"))), keys, most).select("key", "node"))


def near_prints(classes: DataFrame) -> DataFrame:
    """(a, b): the first class of each fingerprint with its other classes, and with the first classes of linked fingerprints."""
    heads = compact(classes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = classes.join(heads.hint("merge"), "fp").where("node <> head").select("node", "head")
    found = link(heads.select("fp"))
    left, right = (heads.select(F.col("fp").alias(c), F.col("head").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    linked = found.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("x", "y")
    return equal.unionByName(linked.toDF("node", "head")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def links(classes: DataFrame, named: DataFrame, words: int = WORDS, like: float = LIKE, most: int = GROUP) -> DataFrame:
    """(a, b): links whose components are those of all pairs of `like` or more, of classes (node, least, size, fp, hashes, odd)."""
    tried = found = None

    def settle(pairs):
        nonlocal tried, found
        if tried is not None:
            pairs = pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
        pairs = compact(_flat(pairs))
        open_ = compact(_flat(not_ruled_out(pairs, classes, like)))
        got = compact(_flat(verified(open_, classes, named, words, like)))
        share = got.count() / max(pairs.count(), 1)
        tried = pairs if tried is None else _flat(tried.unionByName(pairs))
        found = got if found is None else _flat(found.unionByName(got))
        return share

    rows = shared_keys(classes, most)
    about = rows.join(classes.select("node", "size", F.col("node").alias("root")).hint("merge"), "node")
    settle(near_prints(classes).unionByName(possible(_stars(compact(about.select("key", "node", "size", "root")), 0, most), like)).distinct())
    rows = _open(rows, classes, found, most)
    # More turns of stars over the hot keys only save comparisons: what they leave open is compared in full.
    for turn in range(1, TURNS):
        hot = rows.where(F.col("n") > most // 4)
        if hot.isEmpty():
            break
        share = settle(_stars(hot, turn, most, CENTRES).where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(like) - TINY).select("a", "b").distinct())
        rows = _open(rows.select("key", "node"), classes, found, most)
        if share < WORTH:
            break
    settle(possible(trie_pairs(rows, most, like=like), like))
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: float = LIKE, most: int = GROUP) -> DataFrame:
    """(id, h, first, first_h): the key of each row (id and hash of the text), and that of the row of its group that stays."""
    named = _named(docs, id_col, text_col)
    common, counts = _common(named, words)
    sets = reliable(_sets(named, words, lambda h: prefix(h, common, counts, like)))
    rows = sets.select("id", "h", "node")
    # Rows without an id come last.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    classes = reliable(sets.groupBy("node").agg(F.min(order).alias("least"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("hashes").alias("hashes"), F.min("odd").alias("odd")))
    found = _fresh(components(_fresh(links(classes, named, words, like, most))))
    linked = classes.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = linked.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "top")
    first = linked.join(firsts, F.bitwise_not("root") == F.bitwise_not("top")).select(F.col("node").alias("other"), "first")
    return rows.join(first, F.bitwise_not("node") == F.bitwise_not("other")).select("id", "h", F.col("first.id").alias("first"), F.col("first.h").alias("first_h"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: float = LIKE) -> DataFrame:
    """docs without the near copies of another row; all columns as they are."""
    found = compact(groups(docs, id_col, text_col, words, like))
    keys = found.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h"))).alias("stays"))
    keys = compact(keys.where("n > 1 or not stays"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(F.col(f"row.`{text_col}`")).alias("h"))

    def match(some):  # the list grows with the input, so the same join at every size
        some = some.select(F.col("id").alias("_id"), F.col("h").alias("_h")).hint("merge")
        return some, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))

    # Only rows that the sketch cannot clear are moved.
    key = _row_key()
    sketched = sketch(keys, key)
    kept = maybe(row, key, sketched, also=False).unionByName(maybe(row, key, sketched).join(*match(keys), "left_anti")).select("row.*")
    again = keys.where("stays and n > 1")  # rows of equal id and text: one of them
    if again.isEmpty():
        return kept
    return kept.unionByName(maybe(row, key, sketched).join(*match(again), "left_semi").dropDuplicates(["id", "h"]).select("row.*"))
