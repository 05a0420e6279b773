"""Packing of documents into fixed-length rows of token ids, by best-fit decreasing.

Texts are tokenised where they lie; their token ids are dealt into groups of about GROUP_DOCS
documents by a hash of id and text, and every group is packed by itself: the fit is best within
a group. Groups, and so the rows, do not depend on the partitions of the input. Documents
longer than a row are split without loss. A segment tree over the free capacities 0..length
finds the fullest row that still takes a piece.

Defined cases: a null or empty text is the end-of-document id alone; a text of any length is
kept whole, as several pieces; pieces of equal length are placed in the order of their
documents' hashes; repeated rows are packed once each; a group of over GROUP_TOKENS tokens is
packed in parts; an empty table gives no row; a length over 65,536 is an error, as its
positions need more than 16 bits. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import EOD, VOCABULARY, encoder

LENGTH = 2048
#: Documents of a group on average, and tokens of a group that are packed at once.
GROUP_DOCS, GROUP_TOKENS = 1024, 4_000_000


class Capacities:
    """Segment tree over capacities 0..most; a node counts the open rows below it."""

    def __init__(self, most: int):
        self.width = 1 << (most + 1 - 1).bit_length() if most else 1
        while self.width < most + 1:
            self.width *= 2
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = capacity + self.width
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the least capacity that is at least size."""
        count, k = self.count, size + self.width
        if not count[k]:
            # Up to the first subtree on the right that has a row, then down to its first leaf.
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity, up = k - self.width, k
        while up:
            count[up] -= 1
            up >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes into sizes; the sizes of a row sum to length at most."""
    open_rows, rows = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_rows.take(sizes[k])
        if found is None:
            rows.append([k])
            left, row = length - sizes[k], len(rows) - 1
        else:
            row = found[1]
            rows[row].append(k)
            left = found[0] - sizes[k]
        if left:
            open_rows.add(left, row)
    return rows


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id, h, ids): the 16-bit token ids of every whole text, with the end-of-document id; h is a hash of id and text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        encode, end = encoder(vocabulary).encode, np.asarray([EOD], dtype="<u2").tobytes()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                cut = b.slice(start, 256)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array([encode(t or "") + end for t in cut.column(2).to_pylist()], pa.binary())], names=["id", "h", "ids"])

    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(key.alias("id"), F.xxhash64(key, text).alias("h"), text.alias("text")).mapInArrow(write, f"id {kind}, h long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each packed sequence.

    part, row: its group and its place there; ids: `length` 16-bit ids, filled up with the
    end-of-document id; position_ids: `length` 16-bit positions that start again at every
    segment; cu_seqlens: the cumulative lengths of its segments, from 0; doc_ids and
    doc_offsets: the document of each segment and where in its tokens the segment starts;
    n_tokens: without the filling.
    """
    if not 0 < length <= 1 << 16:
        raise ValueError("length must be from 1 to 65536")
    kind = docs.schema[id_col].dataType.simpleString()
    groups = max(1, -(-docs.count() // group_docs))

    def write(batches):
        end = np.asarray([EOD], dtype="<u2").tobytes()
        count_up = np.arange(length, dtype="<u2").tobytes()
        id_type = pa.int64()
        pieces: list[tuple] = []  # (document, offset, bytes)
        part, n, held = None, 0, 0

        def flush():
            nonlocal n
            rows = best_fit_decreasing([len(p[2]) // 2 for p in pieces], length)
            for first in range(0, len(rows), 256):
                out: list[list] = [[] for _ in range(8)]
                for row in rows[first : first + 256]:
                    own = [pieces[k] for k in row]
                    sizes = [len(p[2]) // 2 for p in own]
                    used = sum(sizes)
                    values = (
                        part, n, b"".join(p[2] for p in own) + end * (length - used),
                        b"".join(count_up[: 2 * s] for s in sizes) + bytes(2 * (length - used)),
                        np.concatenate(([0], np.cumsum(sizes))), [p[0] for p in own], [p[1] for p in own], used,
                    )
                    n += 1
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["part", "row", "ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets", "n_tokens"])

        for b in batches:
            id_type = b.schema[1].type
            for at, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if at != part or held >= GROUP_TOKENS:
                    if pieces:
                        yield from flush()
                    pieces, held, n = [], 0, n if at == part else 0
                    part = at
                data = ids.as_buffer().to_pybytes()
                held += len(data) // 2
                for k in range(0, len(data), 2 * length):
                    pieces.append((key, k // 2, data[k : k + 2 * length]))
        if pieces:
            yield from flush()

    schema = f"part int, row long, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<long>, n_tokens int"
    tokens = tokenised(docs, id_col, text_col, vocabulary)
    dealt = tokens.select(F.pmod("h", F.lit(groups)).cast("int").alias("part"), "id", "h", "ids")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "part").sortWithinPartitions("part", "h", "id").mapInArrow(write, schema)


def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, position_ids) of collected rows as two matrices."""
    return tuple(np.stack([np.frombuffer(r[c], dtype="<u2") for r in rows]) for c in ("ids", "position_ids"))
