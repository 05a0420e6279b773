"""Separator scan of flat token files: documents and their token counts without an index.

A flat file is a run of 16-bit token ids in which every document ends with the
end-of-document id. It is read as blocks that cut documents anywhere. Each block is searched
at once as an array; a prefix scan over the blocks' summaries (tokens, separators, last
separator) then stitches the documents that cross blocks. The scan has two levels, so no task
gets more than SUPER blocks, or one summary for each SUPER blocks of a file.

Defined cases: a null or empty text is a document of no token; two separators in a row bound
such a document; tokens after the last separator are a last, open document (ends false); an
empty block or table adds nothing; repeated documents are separate documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillspark.llm.common import reliable
from quillspark.llm.tokens import EOD, VOCABULARY, encoder

#: Tokens of a block, and blocks that one task of the inner scan gets.
BLOCK, SUPER = 65_536, 1024


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Tokenise documents into flat files: (file, block, ids, doc_ids).

    Each partition of docs becomes a file, in the order of its rows. doc_ids is the manifest of
    a block: the ids of the documents whose separator lies in it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        encode, at = encoder(vocabulary).encode, TaskContext.get().partitionId()
        end = np.asarray([EOD], dtype="<u2").tobytes()
        size, n, parts, held, ended = 2 * block, 0, [], 0, []

        def row(data, ids):
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(id_type))], names=["file", "block", "ids", "doc_ids"])

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema[0].type
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                for key, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    parts.append(ids)
                    held += len(ids)
                    while held > size or held == size:
                        data = b"".join(parts)
                        closes = held == size  # the separator is the block's last token
                        yield row(data[:size], [*ended, key] if closes else ended)
                        n, ended = n + 1, []
                        parts, held = ([data[size:]], held - size) if held > size else ([], 0)
                        if closes:
                            break
                    else:
                        ended.append(key)
        if held:
            yield row(b"".join(parts), ended)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(write, f"file int, block long, ids binary, doc_ids array<{kind}>")


def cut_blocks(files: DataFrame, file_col: str = "path", content_col: str = "content", block: int = BLOCK) -> DataFrame:
    """(file, block, ids) of token files read whole, as by Spark's binaryFile source.

    A row holds 2 GB at most, so a larger file must lie in several rows: parts of one name are
    not joined, give each a name of its own.
    """

    def cut(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in range(0, len(data or b""), 2 * block):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // (2 * block)], pa.int64()), pa.array([data[k : k + 2 * block]], pa.binary())], names=["file", "block", "ids"])

    return files.select(F.col(file_col).cast("string"), content_col).mapInArrow(cut, "file string, block long, ids binary")


def find_separators(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """All columns of blocks but ids, with n_tokens and the separators' positions in the block (columns of these names are replaced)."""
    kept = [c for c in blocks.columns if c not in ("ids", "n_tokens", "separators")]

    def search(batches):
        for b in batches:
            found, sizes = [], []
            for data in b.column(b.schema.get_field_index("ids")):
                x = np.frombuffer(data.as_buffer(), dtype="<u2") if data.is_valid else np.zeros(0, "<u2")
                found.append(np.flatnonzero(x == eod))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=[*kept, "n_tokens", "separators"])

    schema = StructType([blocks.schema[c] for c in kept] + [StructField("n_tokens", LongType()), StructField("separators", ArrayType(IntegerType()))])
    return blocks.mapInArrow(search, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, ends[, doc_id]): the documents of all files, from find_separators()."""
    with_ids = "doc_ids" in scanned.columns
    s = reliable(scanned.withColumn("super", F.expr(f"block div {SUPER}")))
    inside = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("separators") > 0, F.element_at("separators", -1))
    inner = s.withColumn("base", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).withColumn("count", F.coalesce(F.sum(F.size("separators")).over(inside), F.lit(0)))
    inner = inner.withColumn("last", F.col("base") + last).withColumn("before", F.max("last").over(inside))
    outer = inner.groupBy("file", "super").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("separators")).alias("seps"), F.max("last").alias("last"), F.max("block").alias("end_block"))
    over = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    outer = (
        outer.withColumn("s_base", F.coalesce(F.sum("tokens").over(over), F.lit(0)))
        .withColumn("s_count", F.coalesce(F.sum("seps").over(over), F.lit(0)))
        .withColumn("s_last", F.max(F.col("s_base") + F.col("last")).over(over))
        .withColumn("final", F.max("super").over(Window.partitionBy("file")) == F.col("super"))
        .select("file", "super", "s_base", "s_count", "s_last", "final", "end_block")
    )
    joined = inner.join(outer, ["file", "super"]).select(
        "file",
        F.col("s_base").alias("s_base"),
        (F.col("s_base") + F.col("base")).alias("at"),
        (F.col("s_count") + F.col("count")).alias("n"),
        F.coalesce(F.col("s_base") + F.col("before"), F.col("s_last"), F.lit(-1)).alias("previous"),
        "separators",
        "n_tokens",
        (F.col("final") & (F.col("block") == F.col("end_block"))).alias("is_last"),
        *(["doc_ids"] if with_ids else []),
    )
    ids = ", 'doc_id', doc_ids[i]" if with_ids else ""
    none = ", 'doc_id', doc_ids[size(separators)]" if with_ids else ""
    closed = f"""transform(separators, (x, i) -> named_struct('ordinal', n + i, 'start', if(i = 0, previous, at + separators[greatest(i - 1, 0)]) + 1,
        'n_tokens', at + x - if(i = 0, previous, at + separators[greatest(i - 1, 0)]) - 1, 'ends', true{ids}))"""
    tail = "if(size(separators) = 0, previous, at + element_at(separators, -1))"
    open_end = f"""if(is_last and at + n_tokens - 1 > {tail}, array(named_struct('ordinal', n + size(separators), 'start', {tail} + 1,
        'n_tokens', at + n_tokens - 1 - {tail}, 'ends', false{none.replace('doc_ids[size(separators)]', 'get(doc_ids, size(separators))')})), array())"""
    open_end = open_end.replace(tail, tail.replace("element_at(separators, -1)", "get(separators, size(separators) - 1)"))
    rows = joined.select("file", F.explode(F.concat(F.expr(closed), F.expr(open_end))).alias("d"))
    return rows.select("file", "d.ordinal", "d.start", "d.n_tokens", "d.ends", *(["d.doc_id"] if with_ids else []))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) of every document, counted in the flat files that it is written to."""
    found = stitch(find_separators(write_flat(docs, id_col, text_col, vocabulary)))
    return found.select(F.col("doc_id").alias(id_col), "file", "ordinal", "start", "n_tokens")
