"""Text functions on STRING columns, JVM-side but for the alignment with a back trace."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five entities of XML.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def edit_distance(a, b): return F.levenshtein(a, b)


def clean_for_evaluation(s: Column, spaces: bool = True, alnum_only: bool = False, alpha_only: bool = False, fold: bool = False) -> Column:
    """Printable ASCII only; optionally without spaces, or letters and digits only, or letters only; lower case if folded."""
    s = F.regexp_replace(s, r"[^\x20-\x7F]", "")
    if not spaces:
        s = F.regexp_replace(s, " ", "")
    if alnum_only:
        s = F.regexp_replace(s, "[^A-Za-z0-9]", "")
    if alpha_only:
        s = F.regexp_replace(s, "[^A-Za-z]", "")
    return F.lower(s) if fold else s


def chomp(s): return F.regexp_replace(s, r"\n$", "")
def remove_spaces(s): return F.regexp_replace(s, " ", "")
def chomp_extension(s): return F.regexp_replace(s, r"\.[^/]*$", "")
def split_string(s, delimiters=r"[ \t\n]"): return F.filter(F.split(s, delimiters), lambda x: x != "")
def code_points(s): return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


def unescape(s: Column) -> Column:
    """The named entities; numeric references are left to unescape_all()."""
    for k, v in ENTITIES:
        s = F.replace(s, F.lit(k), F.lit(v))
    return s


def unescape_all(df: DataFrame, column: str) -> DataFrame:
    """All references, in Arrow batches; an unknown entity is an error."""


    known = {k[1:-1]: v for k, v in ENTITIES}

    def one(m):
        name = m[1]
        if name[:1] == "#":
            return chr(int(name[2:], 16) if name[1:2] in "xX" else int(name[1:]))
        if name not in known:
            raise ValueError(f"unknown entity &{name};")
        return known[name]

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else re.sub(r"&([^;\s]+);", one, x))

    return df.withColumn(column, decode(column))


def fix_quotes(s): return F.regexp_replace(s, r"['`]{2}", '"')
def fix_hyphens(s): return F.regexp_replace(s, r"[-~]{2}", "-")
def flip_zero(s): return F.regexp_replace(F.regexp_replace(s, r"(?<=[0-9])[oO](?=[0-9])", "0"), r"(?<=[A-Za-z])0(?=[A-Za-z])", "O")
def one_ell(s): return s.rlike(r"[1Il]")
def word_shape(s): return F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0"), "", "")
def acceptable_word(s): return s.rlike(r"^[('\"]?(?:[a-z]+|[A-Z][a-z]*|[A-Z]+)(?:[-'][A-Za-z]+)?[.,:;!?)'\"]{0,2}$")
def acceptable_number(s): return s.rlike(r"^[($]?[0-9]+(?:[.,][0-9]+)*[%)]?[.,;:]?$")
def case_ok(s): return s.rlike(r"^[^A-Za-z]*(?:[a-z]+|[A-Z][a-z]*|[A-Z]+)[^A-Za-z]*$")
def punctuation_ok(s): return s.rlike(r"^[(\[{'\"]{0,2}[A-Za-z0-9]+(?:[-'/][A-Za-z0-9]+)*[.,;:!?)\]}'\"]{0,3}$")


def garbage_score(s: Column) -> Column:
    """Class changes between letters and digits plus other symbols, over the length."""
    changes = F.regexp_count(s, F.lit(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    strange = F.regexp_count(s, F.lit(r"[^A-Za-z0-9.,;:!?'\"() -]"))
    return (changes + strange) / F.greatest(F.length(s), F.lit(1))


def matches_wildcard(word: Column, pattern: Column, wildcard: str = "?") -> Column:
    """Words of the pattern's length that agree outside of its wildcards."""
    return word.like(F.replace(F.replace(pattern, F.lit("_"), F.lit("\\_")), F.lit(wildcard), F.lit("_")))


def aligned_confusions(a: str, b: str, kept: int | None = None) -> dict[tuple[str, str], int]:
    """(character of a, of b) -> how often a least-cost alignment takes one for the other; empty for a missing one.

    Only each kept-th row of the table of costs is held (the square root of the length of a, if
    not told); the rows between are made again on the way back, one stretch at a time.
    """
    codes, steps = np.array([ord(c) for c in b], dtype=np.int64), np.arange(len(b) + 1, dtype=np.int32)
    kept = kept or int(len(a) ** 0.5) + 1

    def after(row: np.ndarray, i: int) -> np.ndarray:
        """The row of the first i characters of a, from that of i - 1."""
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (codes != ord(a[i - 1])))
        best[0] = i
        return np.minimum.accumulate(best - steps) + steps

    row, held = steps.copy(), [steps.copy()]
    for i in range(1, len(a) + 1):
        row = after(row, i)
        if i % kept == 0:
            held.append(row)
    found: dict[tuple[str, str], int] = {}
    i, j = len(a), len(b)
    first, d = len(a) + 1, []
    while i or j:
        if i - 1 < first and i:
            first = (i - 1) // kept * kept
            d = [held[first // kept]]
            while len(d) <= i - first:
                d.append(after(d[-1], first + len(d)))
        here = d[i - first] if d else held[0]
        if i and here[j] == d[i - 1 - first][j] + 1:
            key, i = (a[i - 1], ""), i - 1
        elif j and here[j] == here[j - 1] + 1:
            key, j = ("", b[j - 1]), j - 1
        else:
            key, i, j = (a[i - 1], b[j - 1]), i - 1, j - 1
            if key[0] == key[1]:
                continue
        found[key] = found.get(key, 0) + 1
    return found


def confusions(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(t, p, n): characters taken for others by a least-cost alignment; empty for a missing one.

    Of equal ways back, a deletion comes first, then an insertion, then a substitution.
    """

    def run(batches):
        for pdf in batches:
            found: dict[tuple[str, str], int] = {}
            for a, b in zip(pdf["a"].fillna(""), pdf["b"].fillna(""), strict=True):
                for key, n in aligned_confusions(a, b).items():
                    found[key] = found.get(key, 0) + n
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["t", "p", "n"])

    parts = df.select(F.col(truth).alias("a"), F.col(predicted).alias("b")).mapInPandas(run, "t string, p string, n long")
    return parts.groupBy("t", "p").agg(F.sum("n").alias("n"))


def block_move_cost(df: DataFrame, source: str, target: str, jump: float = 5.0) -> DataFrame:
    """A column `cost`: least cost to write the target from the source with unit edits and cursor jumps of cost `jump`."""

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            codes, steps = np.array([ord(c) for c in x], dtype=np.int64), np.arange(len(x) + 1, dtype=float)
            row = np.minimum(steps, jump)
            for c in y:
                now = row + 1
                if len(x):
                    now[1:] = np.minimum(now[1:], row[:-1] + (codes != ord(c)))
                now = np.minimum.accumulate(now - steps) + steps
                row = np.minimum(now, now.min() + jump)
            out.append(float(row.min()))
        return pd.Series(out)

    return df.withColumn("cost", cost(source, target))
