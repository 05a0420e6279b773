"""Phrase collocations: counts of frequent word n-grams over fixed-width keys, and cut scores.

Words are encoded by a dictionary of 64-bit ids, a polynomial hash of their bytes and their
language under a seed for which no two words of the table share an id (checked over all words;
another seed is taken if they do). Pieces are broken at words that are not frequent. The id
n-grams of a piece are packed into binary keys of 8 bytes a word, which Spark deals into ranges
of a mixed 64-bit prefix and radix-sorts by it; equal keys are then run-length counted.

A phrase is as rare as its rarest part, so n-grams are counted order by order and pieces are
also broken where a shorter part is not frequent. Which parts are frequent is told to the tasks
by a bitmap of bounded size that misses none; strangers that it lets through are counted and
then fall below the limit. Each task sorts and counts its own n-grams in chunks first, so a
phrase that makes up a third of all text is a row for each chunk, not one for each occurrence.

Defined cases: a null or empty text has no words; a null language counts as "und"; repeated rows
count as often as they come; a very long text is read in parts that end at a piece's end;
an empty table gives an empty result. Only the two named columns are read, so other columns may
have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SKETCH_ROW, compact, named, reliable, sketch

# Fixed values of the contract.
LEAST, LONGEST, TOP, INSIDE_PERCENT = 30, 4, 2000, 80
BREAKS, BLANKS, NO_LANG = b".,;:!?\n\x0b\x0c\r", b" \t", "und"

#: Bytes of text that a task holds as arrays at a time, and n-grams that it sorts at a time.
PART_BYTES, CHUNK = 1 << 21, 1 << 21
#: Ids are the same for one seed only; the next is tried when two words share an id.
SEEDS = 16

_BREAK = re.compile(b"[" + BREAKS + b"]")
_U = np.uint64
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(32))


def _mix_keys(ids: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for each n-gram whose words are in the columns ids."""
    out = np.zeros(len(ids[0]), _U)
    for column in ids:
        out = _mixed((out + _U(0x9E3779B97F4A7C15)) ^ column)
    return out


class _Tokens:
    """Words of some texts: start, stop (places in data), piece and id of each."""

    def __init__(self, data: np.ndarray, owner: np.ndarray, langs: np.ndarray, seed: int):
        """data: bytes with a break between texts; owner: the text of each byte; langs: a number for each text."""
        self.data = data = _LOWER[data]
        kind = _CLASS[data]
        inside = np.concatenate(([False], kind == 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[self.start] if len(self.start) else self.start
        self.text = owner[self.start]
        length = self.stop - self.start
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        base = _U((0x100000001B3 + 2 * seed * 0x51ED27) | 1)
        power = np.cumprod(np.full(int(length.max()) if len(length) else 1, base, _U))
        place = at + np.repeat(self.start, length)
        terms = _mixed(np.arange(256, dtype=_U) + _U(1 + seed))[data[place]] * power[at]
        sums = np.add.reduceat(terms, np.cumsum(length) - length) if len(length) else np.zeros(0, _U)
        # 0 stands for no word.
        self.id = np.maximum(_mixed(sums ^ langs[self.text]), _U(1))

    def same_word(self, first: np.ndarray) -> bool:
        """Whether each word equals, byte by byte, the word of index first."""
        length, other = self.stop - self.start, (self.stop - self.start)[first]
        if (length != other).any():
            return False
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return bool((self.data[at + np.repeat(self.start, length)] == self.data[at + np.repeat(self.start[first], length)]).all())

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.stop[k]].tobytes()


def _lang_number(lang: str, seed: int) -> int:
    out = np.array([seed + 1], _U)
    for byte in lang.encode():
        out = _mixed((out + _U(0x9E3779B97F4A7C15)) ^ _U(byte))
    return int(out[0])


def _parts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[_Tokens, list[str]]]:
    """Tokens of about PART_BYTES of text at a time, with the language of each text."""
    held: list[bytes] = []
    langs: list[str] = []
    size, numbers = 0, {}

    def tokens() -> _Tokens:
        for lang in set(langs) - numbers.keys():
            numbers[lang] = _lang_number(lang, seed)
        owner = np.repeat(np.arange(len(held)), [len(x) + 1 for x in held])
        return _Tokens(np.frombuffer(b"\n".join(held) + b"\n", np.uint8), owner, np.array([numbers[x] for x in langs], _U), seed)

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            whole, lang = (text.as_py() or "").encode(), lang.as_py()
            while whole:
                # Nothing is counted across a break, so a long text may be cut there.
                end = _BREAK.search(whole, PART_BYTES)
                cut = end.start() if end else len(whole)
                held.append(whole[:cut])
                langs.append(lang)
                size, whole = size + cut, whole[cut:]
                if size >= PART_BYTES:
                    yield tokens(), langs
                    held, langs, size = [], [], 0
    if held:
        yield tokens(), langs


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(named(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), named(text_col).alias("text"))


def _count_words(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes, int], int] = {}

        def emit() -> pa.RecordBatch:
            rows = list(held)
            out = pa.RecordBatch.from_pydict(
                {"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string()),
                 "id": pa.array(np.array([r[2] for r in rows], _U).view(np.int64)), "n": pa.array(list(held.values()), pa.int64())}
            )
            held.clear()
            return out

        for tokens, langs in _parts(batches, seed):
            if not len(tokens.id):
                continue
            ids, first, of, n = np.unique(tokens.id, return_index=True, return_inverse=True, return_counts=True)
            if tokens.same_word(first[of]):
                found = zip(first.tolist(), ids.tolist(), n.tolist(), strict=True)
            else:  # two words share an id: each is told, so that the check over all words sees both
                found = zip(range(len(of)), tokens.id.tolist(), [1] * len(of), strict=True)
            for k, i, count in found:
                key = (langs[tokens.text[k]], tokens.word(k), i)
                held[key] = held.get(key, 0) + count
            if len(held) > 1 << 18:
                yield emit()
        if held:
            yield emit()

    return run


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(words: lang, word, id, f of the frequent words; sizes: lang, n of all words; the seed under which ids are unique)."""
    texts = _texts(docs, lang_col, text_col)
    for s in range(seed, seed + SEEDS):
        counted = texts.mapInArrow(_count_words(s), "lang string, word string, id long, n long")
        every = reliable(counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("f")))
        if not every.groupBy("id").count().where("count > 1").limit(1).count():
            sizes = compact(every.groupBy("lang").agg(F.sum("f").alias("n")))
            return compact(every.where(F.col("f") >= least)), sizes, s
    raise RuntimeError("no seed gives each word an id of its own")


class _Bitmap:
    """A sketch of common.sketch() as one run of bytes, at most 16 MB."""

    def __init__(self, keys: DataFrame, key: str):
        rows, self.bits = sketch(keys, F.col(key))
        whole = np.zeros(self.bits // 8, np.uint8)
        for r in rows.collect():  # SKETCH_BITS / SKETCH_ROW rows at most
            part = np.frombuffer(r["_bits"], np.uint8)[: SKETCH_ROW // 8]
            whole[r["_row"] * (SKETCH_ROW // 8) :][: len(part)] = part
        self.bytes = keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _held(bitmap: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    at = mixed & _U(len(bitmap) * 8 - 1)
    return (bitmap[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _run_lengths(columns: list[np.ndarray], mixed: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different rows of columns with the sums of n, by a radix sort: one stable pass for each 16 bits of the mixed prefix, then of the ids where prefixes meet."""

    def radix(keys: list[np.ndarray]) -> np.ndarray:
        order = np.arange(len(mixed))
        for key in keys:
            for shift in (0, 16, 32, 48):
                order = order[np.argsort(((key[order] >> _U(shift)) & _U(0xFFFF)).astype(np.uint16), kind="stable")]
        return order

    def differ(a: np.ndarray) -> np.ndarray:
        return a[1:] != a[:-1]

    order = radix([mixed])
    same = ~differ(mixed[order])
    if any((same & differ(c[order])).any() for c in columns):
        order = radix([*reversed(columns), mixed])
    new = np.concatenate(([True], np.logical_or.reduce([differ(mixed[order]), *(differ(c[order]) for c in columns)])))
    at = np.flatnonzero(new)
    return [c[order][at] for c in columns], mixed[order][at], np.add.reduceat(n[order], at)


def _packed(columns: list[np.ndarray]) -> pa.Array:
    """Keys of fixed width: 8 bytes a word, most significant first."""
    rows = np.stack(columns, axis=1).astype(">u8")
    width = 8 * len(columns)
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


_KEYED = "mixed long, key binary, n long"


def _batch(columns: list[np.ndarray], mixed: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), _packed(columns), pa.array(n)], ["mixed", "key", "n"])


def _count_grams(size: int, seed: int, words: Broadcast, parts: Broadcast | None) -> Callable:
    """N-grams of size frequent words whose two parts of size - 1 words are frequent, counted chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(words.value, np.uint8)
        shorter = np.frombuffer(parts.value, np.uint8) if parts is not None else None
        held: list[list[np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            columns = [np.concatenate([h[k] for h in held]) for k in range(size)]
            held.clear()
            return _batch(*_run_lengths(columns, _mix_keys(columns), np.ones(len(columns[0]), np.int64)))

        for tokens, _ in _parts(batches, seed):
            good, n = _held(known, _mix_keys([tokens.id])), len(tokens.id) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero((tokens.piece[:n] == tokens.piece[size - 1 :]) & np.logical_and.reduce([good[k : n + k] for k in range(size)]))
            if shorter is not None:
                for first in (0, 1):
                    at = at[_held(shorter, _mix_keys([tokens.id[at + first + k] for k in range(size - 1)]))]
            held.append([tokens.id[at + k] for k in range(size)])
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield emit()
        if sum(len(h[0]) for h in held):
            yield emit()

    return run


def _sum_runs(size: int) -> Callable:
    """Sums of the runs of equal keys in rows sorted by mixed; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.frombuffer(b"".join(batch["key"].to_pylist()), ">u8").astype(_U).reshape(-1, size)
            mixed, n = np.asarray(batch["mixed"]).view(_U), np.asarray(batch["n"])
            if rest is not None:
                ids, mixed, n = np.concatenate([rest[0], ids]), np.concatenate([rest[1], mixed]), np.concatenate([rest[2], n])
            columns, mixed, n = _run_lengths([np.ascontiguousarray(ids[:, k]) for k in range(size)], mixed, n)
            last = int(np.searchsorted(mixed, mixed[-1]))
            rest = np.stack([c[last:] for c in columns], axis=1), mixed[last:], n[last:]
            if last:
                yield _batch([c[:last] for c in columns], mixed[:last], n[:last])
        if rest is not None:
            yield _batch([np.ascontiguousarray(rest[0][:, k]) for k in range(size)], rest[1], rest[2])

    return run


def _unsigned(column):
    """Order of signed numbers as that of unsigned ones."""
    return F.expr(f"{column} ^ cast(-9223372036854775808 as bigint)")


def count_grams(texts: DataFrame, size: int, seed: int, words: _Bitmap, parts: _Bitmap | None, least: int) -> DataFrame:
    """(mixed, key, f): the n-grams of size words that occur least times or more."""
    counted = texts.mapInArrow(_count_grams(size, seed, words.bytes, parts.bytes if parts else None), _KEYED)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of equal width of the mixed prefix, which spreads evenly whatever the words are.
    ranged = counted.repartitionById(n, F.expr(f"cast((shiftrightunsigned(mixed, 32) * {n}) >> 32 as int)"))
    # Unsigned order: the sort key is one long, so that Spark sorts by radix.
    ordered = ranged.withColumn("_order", _unsigned("mixed")).sortWithinPartitions("_order").drop("_order")
    return ordered.mapInArrow(_sum_runs(size), _KEYED).where(F.col("n") >= least).withColumnRenamed("n", "f")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, sizes, phrases): the dictionary, the number of words of each language, and (size, key, f) of all frequent phrases of 1 to longest words."""
    words, sizes, seed = dictionary(docs, lang_col, text_col, least)
    texts = _texts(docs, lang_col, text_col)
    to_key = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    single = words.mapInArrow(_mixed_ids, "id long, mixed long")
    known, parts = _Bitmap(single, "mixed"), None
    found = [words.select(F.lit(1).alias("size"), to_key.alias("key"), "f")]
    for size in range(2, longest + 1):
        grams = compact(count_grams(texts, size, seed, known, parts, least))
        found.append(grams.select(F.lit(size).alias("size"), "key", "f"))
        parts = _Bitmap(grams, "mixed")
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return words, sizes, phrases


def _mixed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch["id"])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_mix_keys([ids.view(_U)]).view(np.int64))], ["id", "mixed"])


def _part(first, size):
    """The key of size words from the word first (from 0)."""
    return F.expr(f"substring(key, ({first}) * 8 + 1, ({size}) * 8)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    The score of a cut is 2000000 * a // (l + r), in decimals of 38 digits; the least of a phrase's cuts counts, of
    equal ones the first. A phrase goes when a longer one that holds it has inside_percent of its count or more.
    """
    words, sizes, phrases = frequent_phrases(docs, lang_col, text_col, least, longest)
    many = phrases.where("size > 1")
    counts = phrases.select(F.col("key").alias("_key"), F.col("f").alias("_f"))
    cuts = many.select("size", "key", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    left = cuts.withColumn("_key", _part("0", "k")).join(counts, "_key").withColumnRenamed("_f", "l").drop("_key")
    both = left.withColumn("_key", _part("k", "size - k")).join(counts, "_key").withColumnRenamed("_f", "r").drop("_key")
    scored = both.withColumn("score", F.expr("cast((cast(a as decimal(38, 0)) * 2000000) div (cast(l as decimal(38, 0)) + r) as long)"))
    worst = scored.groupBy("key", "size", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_cut"))
    inner = many.where("size > 2").select("f", "size", "key", F.explode(F.expr("sequence(2, size - 1)")).alias("_n"))
    inner = inner.select("f", "key", "_n", F.explode(F.expr("sequence(0, size - _n)")).alias("_at")).select(_part("_at", "_n").alias("key"), "f")
    covered = inner.groupBy("key").agg(F.max("f").alias("_longer"))
    kept = worst.join(covered, "key", "left").where(f"_longer is null or 100 * _longer < {inside_percent} * a").select("key", "size", "a", "_cut.l", "_cut.r", "_cut.score")
    # The words of each key, by place.
    spelled = kept.select("key", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> substring(key, i * 8 + 1, 8))")).alias("_at", "_id"))
    book = words.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("_id"), "lang", "word")
    phrase = spelled.join(book, "_id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(phrase, "key").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
