"""Quality rules by the frequency of lines across documents, in DataFrame functions alone.

Lines are normalised and hashed, the distinct documents of a host that hold a line are
counted, lines above the limits are removed, and documents that lose too much are rejected. A
document is a text of a host: exact copies count once, so that copies alone make no line
frequent (to thin them out is another operator's work).

Only hashes are shuffled. Counting goes by (line, text) first, so a line that a third of all
documents hold is dealt over all tasks; the frequent lines then meet their texts in salted
joins, after a bitmap of bounded size has kept all other lines where they are.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host
of its own; a very long text is judged whole; repeated rows get the same row each; lines
without a word are never counted nor removed; an empty table gives an empty result. Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, compact, maybe, named, reliable, sketch

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

#: A line is frequent in a host when more documents hold it than both of these say.
LEAST_DOCS, DOC_SHARE = 20, 0.01
#: A document is depleted when it keeps fewer words than this, or a smaller share of its words.
KEPT_WORDS, KEPT_SHARE = 20, 0.5
#: Parts of a hot line or of a large group of copies in joins.
SALT = 32


def normal_line(line):
    """Lowered, digits to one 0, white space to one blank, none at the ends."""
    one = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
    return F.trim(one)


def _normal_lines(text):
    """All lines of a text that hold a word, normalised as normal_line() does."""
    one = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(one, "\n", -1), F.trim), lambda x: x != "")


#: Repeated windows of one text that are looked up one by one; texts with more sort all their windows with their places.
LOOKED_UP = 64


def repeated_words(windows: str):
    """Words in windows of three that occur twice or more in the array windows of a text, in order of place.

    The windows that occur twice are the neighbours of a sort; the words that they cover are
    counted by the distances of their places.
    """
    twice = "element_at(transform(array(sort_array(g)), s -> array_distinct(filter(s, (e, k) -> k > 0 and s[k - 1] = e))), 1)"
    few = "filter(sequence(0, size(g) - 1), i -> array_contains(d, g[i]))"
    same = "(k > 0 and s[k - 1].x = e.x) or (k < size(s) - 1 and s[k + 1].x = e.x)"
    many = f"""sort_array(transform(element_at(transform(array(sort_array(transform(g, (x, i) -> named_struct('x', x, 'i', i)))),
        s -> filter(s, (e, k) -> {same})), 1), e -> e.i))"""
    count = "aggregate({}, named_struct('n', 0, 'last', -3), (t, i) -> named_struct('n', t.n + least(3, i - t.last), 'last', i), t -> t.n)"
    chosen = f"element_at(transform(array({twice}), d -> case when size(d) <= {LOOKED_UP} then {count.format(few)} else {count.format(many)} end), 1)"
    sql = f"case when size(array_distinct(g)) = size(g) then 0 else {chosen} end"
    return F.expr(re.sub(r"\bg\b", windows, sql)).cast("long")


def _keys(host_col: str, text_col: str) -> tuple:
    """(host, text of the host) as hashes."""
    host = F.xxhash64(named(host_col))
    return host, F.xxhash64(named(host_col), F.lit("text"), F.coalesce(named(text_col), F.lit("")))


def read_texts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One pass over the texts: row, id, host and text (hashes), lines (hash and words of each line with a word), and the base rules' columns."""
    text = F.coalesce(named(text_col), F.lit(""))
    host, key = _keys(host_col, text_col)
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    line = lambda x: F.struct(F.xxhash64(named(host_col), F.lit("line"), x).alias("line"), words(x).alias("words"))
    given = docs.select(
        F.monotonically_increasing_id().alias("row"),
        named(id_col).alias("id"),
        host.alias("host"),
        key.alias("text"),
        F.transform(_normal_lines(text), line).alias("lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.transform(F.array(with_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).alias("_plain"),
    )
    # A window starts at each word that two more follow.
    windows = F.regexp_extract_all("_plain", F.lit(r"(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), F.lit(1))
    first = ["row", "id", "host", "text", "lines", "n_symbols", "n_dup_lines"]
    counted = given.select(
        *first,
        F.when(F.col("_plain") == "", 0).otherwise(words(F.col("_plain"))).cast("long").alias("n_words"),
        F.length(F.replace("_plain", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        windows.alias("_windows"),
    )
    ruled = counted.select(*first, "n_words", "word_chars", repeated_words("_windows").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return ruled.withColumn("base_failed", failed)


def _lines_of(read: DataFrame) -> DataFrame:
    return read.select("row", "host", "text", F.explode("lines").alias("_line")).select("row", "host", "text", "_line.line", "_line.words")


def frequent_lines(read: DataFrame, least: int = LEAST_DOCS, share: float = DOC_SHARE) -> DataFrame:
    """(line, n_docs) of read_texts(): lines that more than least documents of their host hold, and more than share of its documents."""
    counted = _lines_of(read).select("host", "line", "text").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    many = compact(counted.where(F.col("n_docs") > least))
    sizes = read.select("host", "text").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_of"))
    return many.join(sizes, "host").where(F.col("n_docs") > share * F.col("_of")).select("line", "n_docs")


def _salted(many: DataFrame, few: DataFrame, key: str, spread, how: str) -> DataFrame:
    """many joined with few, of one row a key: the rows of a key go to SALT tasks by the hash of spread."""
    parts = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(parts, [key, "_salt"], how).drop("_salt")


def removed_lines(read: DataFrame, least: int = LEAST_DOCS, share: float = DOC_SHARE) -> DataFrame:
    """(text, lines, words) of read_texts(): for each text of a host that holds frequent lines, these lines and their words."""
    frequent = compact(frequent_lines(read, least, share))
    near = maybe(_lines_of(read), F.col("line"), sketch(frequent, F.col("line")))
    # A document's repetitions of a line add up; copies of the document, whose rows are equal, do not.
    each = near.groupBy("line", "text", "row").agg(F.sum("words").alias("words"))
    once = each.groupBy("line", "text").agg(F.max("words").alias("words"))
    met = _salted(once, frequent.select("line"), "line", F.col("text"), "inner")
    return met.groupBy("text").agg(F.collect_list("line").alias("lines"), F.sum("words").alias("words"))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, share: float = DOC_SHARE) -> DataFrame:
    """id_col, the base rules' counts, base_failed, kept, n_removed (words in frequent lines): one row for each document."""
    read = reliable(read_texts(docs, id_col, host_col, text_col))
    lost = compact(removed_lines(read, least, share).select("text", F.col("words").alias("_lost")))
    met = _salted(read.drop("lines"), lost, "text", F.col("row"), "left").withColumn("n_removed", F.coalesce("_lost", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (F.col("n_removed") > 0) & ((left < KEPT_WORDS) | (left < KEPT_SHARE * F.col("n_words")))
    return met.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "n_removed"
    )


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, share: float = DOC_SHARE) -> DataFrame:
    """docs with the frequent lines taken out of text_col; a null text stays null. All columns and rows stay."""
    key, read = _keys(host_col, text_col)[1], reliable(read_texts(docs, text_col, host_col, text_col).drop("id"))
    lost = compact(removed_lines(read, least, share).select("text", "lines"))
    # Texts without a frequent line are not moved.
    packed = docs.select(F.struct("*").alias("_given"), key.alias("text"))
    marks = sketch(lost, F.col("text"))
    hit = _salted(maybe(packed, F.col("text"), marks), lost, "text", F.col("_given"), "left")
    hit = hit.unionByName(maybe(packed, F.col("text"), marks, also=False).withColumn("lines", F.lit(None).cast("array<bigint>")))
    host, text = (F.col("_given")[c] for c in (host_col, text_col))
    stays = lambda x: ~F.array_contains("lines", F.xxhash64(host, F.lit("line"), normal_line(x))) | (normal_line(x) == "")
    made = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))
    return hit.select(F.col("_given").withField("`" + text_col.replace("`", "``") + "`", made).alias("_given")).select("_given.*")
