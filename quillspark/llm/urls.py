"""URL filter: rules on hosts and paths, and gradient-boosted trees on lexical features.

The trees are boosted logistic regression trees over quantised features (second-order gains,
leaf values shrunk), fitted on the driver from a bounded sample of labelled URLs and applied
to every URL in Arrow batches. Two features are the count and the rate of the host's suffix
over all labelled URLs.

Defined cases: a null URL, or one without "://", has an empty host and path and is judged on
the features of the empty string; ties between rules of equal length go to the one listed
first; repeated rows give repeated results; an empty table gives an empty result; with no
labelled URL, or one class only, the model is a constant (allow without any label). Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, reliable
from quillspark.llm.simhash import BROADCAST_ROWS

#: Fixed values of the contract: (verdict, host, path), written as they are reported.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Parts of host names that label a URL as unwanted in the training sample.
SEED_TERMS = ("casino", "bets", "spam", "pills", "adult", "ads-")
#: Most labelled URLs that the trees are fitted on: those of the smallest hash.
SAMPLE_URLS = 20_000

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy",
    "hyphens", "host_hyphens", "parameters", "has_query", "has_fragment", "longest_token", "vowel_ratio", "is_https",
    "suffix_rate", "suffix_count",
)


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, u, host, path): u is the URL, null as empty."""
    u = pages.select(F.col(id_col).alias(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    rest = u.withColumn("rest", F.expr("if(instr(u, '://') > 0, substring(u, instr(u, '://') + 3), '')"))
    host = ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1))
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return rest.select(id_col, "u", host.alias("host"), path.alias("path"))


def rule_columns(host, path, rules: Sequence[tuple[str, str]] = RULES) -> tuple:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(reversed(list(rules)), key=lambda r: len(r[1])):  # the last one put on top wins
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def suffix(host: str) -> str:
    """The last two labels."""
    return ".".join(host.split(".")[-2:])


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str], suffixes: dict[str, tuple[float, int]], prior: float) -> np.ndarray:
    """One row of FEATURES for each URL."""
    out = np.zeros((len(urls), len(FEATURES)))
    for k, (u, h, p) in enumerate(zip(urls, hosts, paths, strict=True)):
        n = max(len(u), 1)
        rate, count = suffixes.get(suffix(h), (prior, 0))
        tail = u.partition("?")[2].partition("#")[0]
        tokens = h.replace("-", ".").split(".") + p.split("/")
        letters = sum(c.isalpha() for c in h)
        out[k] = (
            len(u), len(h), len(p), p.count("/"), h.count(".") + 1, sum(c.isdigit() for c in u) / n,
            sum(c.isdigit() for c in h) / max(len(h), 1), _entropy(u), _entropy(h), u.count("-"), h.count("-"),
            tail.count("&") + 1 if tail else 0, "?" in u, "#" in u, max(map(len, tokens)),
            sum(c in "aeiou" for c in h) / max(letters, 1), u.startswith("https"), rate, math.log1p(count),
        )
    return out


def suffix_column(host="host"):
    """suffix() as a column."""
    return F.substring_index(host, ".", -2)


def suffix_statistics(labelled: DataFrame, weight: float = 20.0) -> tuple[DataFrame, float]:
    """((suffix, rate, n), prior) over all rows (u, host, path, label): smoothed share of unwanted URLs and number of URLs for each host suffix."""
    counts = reliable(labelled.groupBy(suffix_column().alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("double").alias("bad")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = total["bad"] / total["n"] if total["n"] else 0.0
    return counts.select("suffix", ((F.col("bad") + weight * prior) / (F.col("n") + weight)).alias("rate"), "n"), prior


def with_suffix(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    """urls with rate and n of the host's suffix, null if it is unknown; the largest suffixes are broadcast."""
    hot = reliable(statistics.orderBy(F.desc("n"), "suffix").limit(BROADCAST_ROWS))
    keyed = urls.withColumn("suffix", suffix_column())
    if statistics.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(hot), "suffix", "left")
    known = F.broadcast(hot.select("suffix"))
    cold = keyed.join(known, "suffix", "left_anti").join(statistics.hint("merge"), "suffix", "left")
    return keyed.join(F.broadcast(hot), "suffix").unionByName(cold)


class Boosted:
    """Gradient-boosted trees for log-odds; each tree is an array form of a full binary tree."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int):
        self.base, self.trees, self.depth = base, trees, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
        """Newton boosting over at most `bins` quantiles of each feature."""
        p = float(y.mean()) if len(y) else 0.0
        if not 0 < p < 1:
            return Boosted(50.0 if p else -50.0, [], depth)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        width = bins + 1
        margin, trees, base = np.full(len(y), math.log(p / (1 - p))), [], math.log(p / (1 - p))
        inner = 2**depth - 1
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(depth):
                first, nodes = 2**level - 1, 2**level
                local = at - first
                best = np.full(nodes, 1e-9)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = local * width + coded[:, f]
                    gs = np.bincount(key, g, nodes * width).reshape(nodes, width)
                    hs = np.bincount(key, h, nodes * width).reshape(nodes, width)
                    gl, hl = gs.cumsum(1)[:, : len(c)], hs.cumsum(1)[:, : len(c)]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    k = gain.argmax(1)
                    won = gain[np.arange(nodes), k]
                    for node in np.flatnonzero(won > best):
                        best[node], feature[first + node], cut[first + node] = won[node], f, c[k[node]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            at -= inner
            leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
            margin += leaf[at]
            trees.append((feature, cut, leaf))
        return Boosted(base, trees, depth)


def seed_labels(urls: DataFrame, terms: Sequence[str] = SEED_TERMS) -> DataFrame:
    """split_urls() with a label column: 1 if the host holds a seed term, else 0."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains("host", F.lit(t))
    return urls.withColumn("label", hit.cast("int"))


def fit(labelled: DataFrame, most: int = SAMPLE_URLS) -> dict:
    """Trees and suffix statistics from (u, host, path, label), null labels left out.

    The statistics count all distinct URLs; only the trees are fitted on a sample, bounded by
    `most` distinct URLs, those of the smallest hash.
    """
    known = reliable(labelled.where("label is not null").groupBy("u", "host", "path").agg(F.max("label").alias("label")))
    statistics, prior = suffix_statistics(known)
    sample = known.withColumn("h", F.xxhash64("u")).orderBy("h", "u").limit(most)
    rows = with_suffix(sample, statistics).orderBy("h", "u").select("u", "host", "path", "label", "suffix", "rate", "n").collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    x = features([r["u"] for r in rows], [r["host"] for r in rows], [r["path"] for r in rows], {r["suffix"]: (r["rate"], r["n"]) for r in rows}, prior)
    return {"trees": Boosted.fit(x, y), "suffixes": statistics, "prior": prior}


def score(urls: DataFrame, model: dict, id_col: str = "page_id") -> DataFrame:
    """(id_col, host, path, score): the probability that a URL is unwanted, for each row of split_urls().

    The suffix statistics are joined to the URLs; 40 small trees are sent with the task.
    """
    trees, prior = model["trees"], model["prior"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, h, p, rate, n = (b.column(c).to_pylist() for c in range(1, 6))
            own = {suffix(host): (r, c) for host, r, c in zip(h, rate, n, strict=True) if c is not None}
            z = 1 / (1 + np.exp(-np.clip(trees.margin(features(u, h, p, own, prior)), -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(z, pa.float64())], names=["id", "host", "path", "score"])

    kind = urls.schema[id_col].dataType.simpleString()
    rows = with_suffix(urls.withColumnRenamed(id_col, "_id"), model["suffixes"]).select(F.col("_id").alias("id"), "u", "host", "path", "rate", "n")
    return rows.mapInArrow(judge, f"id {kind}, host string, path string, score double").withColumnRenamed("id", id_col)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for every row of pages."""
    urls = split_urls(pages, id_col, url_col)
    scored = score(urls, fit(seed_labels(urls) if labelled is None else labelled), id_col)
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
