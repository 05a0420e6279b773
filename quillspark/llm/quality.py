"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Eleven labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of all vote patterns estimates their accuracies, whose posterior labels train a logistic
scorer on hashed words, word shapes and votes. Two labellers use a list of words that mark toxic
documents; it is learned from labelled rows.

Bounds: the list is learned from the LABELLED labelled documents of the smallest hash and has
LEXICON entries at most; the scorer is fitted on the SAMPLE documents of the smallest hash of
each class. Vote patterns are counted over all documents; the driver gets a row for each
pattern, 3**11 at most.

Defined cases: a null or empty text gets no vote and is kept unless most documents are bad; a
long text is read whole; rows that repeat are judged alike; an empty table gives an empty
result; without labels the list is empty and its two labellers are silent; any label above 0 is toxic. Only the named
columns are read; the filter returns the columns of its input untouched, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import reliable

LABELLED, LEXICON, SAMPLE = 20_000, 5_000, 2_500
#: Buckets of the hashed features.
BUCKETS = 1 << 18
#: A listed word or stem is in so many toxic documents and such a share of them at least, and so many times as often there as elsewhere.
LEXICON_DOCS, LEXICON_SHARE, LEXICON_ODDS = 3, 0.01, 30.0
#: Lengths of the stems of a word that the list may hold.
STEMS = range(4, 9)
#: Words whose terms a process remembers.
MEMORY = 50_000

#: Sketches that tell near copies among the labelled documents.
SKETCHES = 3

LABELLERS = ("symbols", "bars", "exclamations", "capitals", "stutter", "poverty", "prose", "variety", "toxic_words", "toxic_density", "marks")
GOOD, SILENT, BAD = 0, 1, 2

_SYMBOLS = re.compile(r"[#$%&*@~^=_<>\\]{2,}")
_EDGE = ".,;:!?\"'()[]#$%&*|"


def terms(word: str) -> tuple[str, ...]:
    """What of a word the list may hold: the word and its stems."""
    w = word.strip(_EDGE).lower()
    return (w, *(w[:k] + "+" for k in STEMS if k < len(w))) if len(w) > 2 else ()


class Lexicon:
    """A set of terms; tells whether it holds a term of a word."""

    def __init__(self, listed: frozenset[str]):
        self.listed, self.known = listed, {}
        self.lengths = sorted({len(t) - 1 for t in listed if t[-1] == "+"})

    def holds(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            w = word.strip(_EDGE).lower()
            got = len(w) > 2 and (w in self.listed or any(k < len(w) and w[:k] + "+" in self.listed for k in self.lengths))
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = got
        return got


def sketches(text: str) -> list[int]:
    """The least hashes of the text's pairs of words; documents that differ in a few words share most of them."""
    words = text.encode("utf-8", "replace").lower().split()
    pairs = {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or {b" ".join(words)}
    return [min(xxhash.xxh64_intdigest(p, seed) for p in pairs) >> 1 for seed in range(SKETCHES)]


def votes(text: str, lexicon: Lexicon) -> tuple[list[int], Counter]:
    """One vote for each of LABELLERS, and the counts of the text's words."""
    words = text.split()
    n, counts = len(words), Counter(words)
    out = [SILENT] * len(LABELLERS)
    if not n:
        return out, counts
    symbols, bars = len(_SYMBOLS.findall(text)) / n, text.count("|") / n
    exclamations = text.count("!!") / n
    capitals = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper()) / n
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    variety = len(counts) / n
    toxic = sum(c for w, c in counts.items() if lexicon.holds(w)) if lexicon.listed else 0
    out[0] = BAD if symbols > 0.05 else SILENT
    out[1] = BAD if bars > 0.05 else SILENT
    out[2] = BAD if exclamations > 0.05 else SILENT
    out[3] = BAD if capitals > 0.3 and n >= 5 else SILENT
    out[4] = BAD if stutter > 0.15 and n >= 10 else SILENT
    out[5] = BAD if n >= 50 and variety < min(0.2, 8 / n**0.5) else SILENT
    if n >= 20:
        out[6] = GOOD if max(symbols, bars, exclamations) < 0.02 and stutter < 0.05 and not toxic else SILENT
        out[7] = GOOD if max(symbols, bars, exclamations) < 0.05 and variety >= min(0.3, 12 / n**0.5) and capitals < 0.2 and not toxic else SILENT
    out[8] = BAD if toxic >= 2 else SILENT
    out[9] = BAD if toxic >= 2 and toxic / n > 0.004 or toxic and toxic / n > 0.03 else SILENT
    out[10] = BAD if sum(map(text.count, "#$%&*@~^=_<>\\|!")) > 0.02 * len(text) and n >= 5 else SILENT
    return out, counts


def shape(word: str) -> str:
    """The word's character classes, repeats as one; empty for ordinary words."""
    core = word.rstrip(".,;:?!") if word[-1:] in ".,;:?" else word
    if core.isalpha() and not (len(core) > 1 and core.isupper()):
        return ""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


def hashed(cast: list[int], counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): words and shapes share a unit of length, votes have 1 each."""
    total = max(sum(counts.values()), 1)
    shapes: Counter = Counter()
    for w, c in counts.items():
        if s := shape(w):
            shapes[s] += c
    keys = [zlib.crc32(b"w" + w.encode("utf-8", "replace")) % BUCKETS for w in counts]
    values = [c / total for c in counts.values()]
    keys += [zlib.crc32(b"s" + s.encode("utf-8", "replace")) % BUCKETS for s in shapes]
    values += [2 * c / total for c in shapes.values()]
    keys += [zlib.crc32(b"v%d:%d" % (j, v)) % BUCKETS for j, v in enumerate(cast) if v != SILENT]
    values += [1.0] * (len(keys) - len(values))
    return np.array(keys, dtype=np.int32), np.array(values, dtype=np.float32)


def accuracies(patterns: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, float, dict[int, float]]:
    """Accuracy of each labeller, share of bad documents, and P(bad) of each pattern.

    Expectation-maximisation for voters that are independent given the class, with a prior of
    0.85 on the accuracies; a silent labeller tells nothing. A pattern is a number in base 3.
    """
    k = len(LABELLERS)
    codes = np.array(list(patterns), dtype=np.int64)
    weight = np.array([patterns[c] for c in codes], dtype=float)
    cast = codes[:, None] // 3 ** np.arange(k) % 3 if len(codes) else np.zeros((0, k), dtype=np.int64)
    acc, bad, p = np.full(k, 0.85), 0.2, np.zeros(len(codes))
    for _ in range(rounds):
        says = np.where(cast == BAD, np.log(acc / (1 - acc)), np.where(cast == GOOD, -np.log(acc / (1 - acc)), 0.0))
        p = 1 / (1 + np.exp(-np.clip(says.sum(1) + np.log(bad / (1 - bad)), -50, 50)))
        right = (weight[:, None] * (np.where(cast == BAD, p[:, None], 0) + np.where(cast == GOOD, 1 - p[:, None], 0))).sum(0)
        spoke = (weight[:, None] * (cast != SILENT)).sum(0)
        strength = 20 + 0.05 * spoke
        acc = np.clip((right + 0.85 * strength) / (spoke + strength), 0.55, 0.995)
        bad = float(np.clip(((weight * p).sum() + 2) / (weight.sum() + 10), 0.01, 0.45))
    return acc, bad, dict(zip(codes.tolist(), p.tolist(), strict=True))


def fit_scorer(rows: Iterable[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by Adagrad over the whole sample; the classes weigh the same."""
    rows = list(rows)
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    key = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(float)
    hard = target >= 0.5
    share = np.where(hard, 0.5 / max(hard.sum(), 1), 0.5 / max((~hard).sum(), 1))
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(at, w[key] * value, len(rows)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        g = np.bincount(key, error[at] * value, BUCKETS) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        gb = float(error.sum())
        seen_bias += gb * gb
        bias -= rate * gb / seen_bias**0.5
    return w, bias


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> frozenset[str]:
    """Words and stems that mark toxic documents, from the bounded labelled sample; LEXICON of them at most."""
    few = labels.where("toxic is not null").groupBy(id_col).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64(id_col), id_col).limit(LABELLED)
    few = reliable(few.withColumnRenamed(id_col, "id"))
    texts = reliable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id"))

    def sketch(batches):
        for b in batches:
            keys = [sketches(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([k[j] for k in keys], pa.int64()) for j in range(SKETCHES))], names=["id", *(f"k{j}" for j in range(SKETCHES))])

    # Copies of one toxic document must not make its rare words look telling.
    kind = few.schema["id"].dataType.simpleString()
    alone = texts.select("id", "toxic", "text").mapInArrow(sketch, f"id {kind}, " + ", ".join(f"k{j} long" for j in range(SKETCHES)))
    for j in range(SKETCHES):
        alone = alone.groupBy(f"k{j}").agg(F.min(F.struct("id", *(f"k{i}" for i in range(j + 1, SKETCHES)))).alias("first")).select("first.*")
    texts = texts.join(F.broadcast(reliable(alone.select("id").distinct())), "id").select("toxic", "text")

    def count(among: frozenset[str] | None):
        """Counts documents (of the empty term) and documents of each term; only terms of `among`, if given."""

        def run(batches):
            found, seen = Counter(), 0
            for b in batches:
                for part in range(0, b.num_rows, 256):
                    for text in b.slice(part, 256).column(0).to_pylist():
                        seen += 1
                        own = {t for w in set((text or "").split()) for t in terms(w)}
                        found.update(own if among is None else own & among)
            yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([seen, *found.values()], pa.int64())], names=["term", "n"])

        return run

    def counted(toxic: int, among: frozenset[str] | None) -> DataFrame:
        rows = texts.where(f"toxic = {toxic}").select("text").mapInArrow(count(among), "term string, n long")
        return rows.groupBy("term").agg(F.sum("n").alias("n"))

    # The terms of toxic documents first: only these are looked for in the others.
    toxic = reliable(counted(1, None).where(f"term = '' or n >= {LEXICON_DOCS}").withColumnRenamed("n", "toxic"))
    among = frozenset(r["term"] for r in toxic.where("term <> ''").collect())  # of LABELLED documents at most
    sums = reliable(toxic.join(counted(0, among).withColumnRenamed("n", "clean"), "term", "left").na.fill(0, ["clean"]))
    totals = sums.where("term = ''").first()
    if not totals or not totals["toxic"]:
        return frozenset()
    odds = (F.col("toxic") / F.lit(float(totals["toxic"]))) / ((F.col("clean") + F.lit(0.5)) / F.lit(float(totals["clean"] + 1)))
    rows = sums.where("term <> ''").where(F.col("toxic") >= LEXICON_SHARE * totals["toxic"]).where(odds >= LEXICON_ODDS).orderBy(F.desc("toxic"), "term").limit(LEXICON).collect()
    return frozenset(r["term"] for r in rows)


def _code(cast: list[int]) -> int:
    return sum(v * 3**j for j, v in enumerate(cast))


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The whole model: list, accuracies, posterior of each pattern, scorer."""
    listed = learn_lexicon(docs, labels, id_col, text_col) if labels is not None else frozenset()
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cast_votes(batches):
        lexicon = Lexicon(listed)
        for b in batches:
            out = [_code(votes(t, lexicon)[0]) for part in range(0, b.num_rows, 256) for t in b.slice(part, 256).column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["h", "code"])

    cast = reliable(texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(cast_votes, "h long, code long"))
    patterns = {r["code"]: r["count"] for r in cast.groupBy("code").count().collect()}
    acc, bad, posterior = accuracies(patterns)

    # The sample of each class: the hashes up to the SAMPLE-th smallest distinct one.
    codes = {c for c, p in posterior.items() if p >= 0.5}
    chosen: dict[int, float] = {}
    for is_bad in (True, False):
        own = F.col("code").isin(*codes) if codes else F.lit(False)
        for r in cast.where(own if is_bad else ~own).groupBy("h").agg(F.min("code").alias("code")).orderBy("h").limit(SAMPLE).collect():
            chosen[r["h"]] = posterior[r["code"]]

    def pick(batches):
        given, lexicon = set(), Lexicon(listed)
        for b in batches:
            hashes = b.column(0).to_pylist()
            take = [k for k, h in enumerate(hashes) if h in chosen and h not in given and not given.add(h)]
            if take:
                rows = [hashed(*votes(t, lexicon)) for t in b.column(1).take(pa.array(take)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashes[k] for k in take], pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["h", "keys", "vals"])

    picked = texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(pick, "h long, keys array<int>, vals array<float>").dropDuplicates(["h"]).toArrow() if chosen else None
    rows, target = [], []
    if picked is not None:
        for h, k, v in sorted(zip(picked.column(0).to_pylist(), picked.column(1), picked.column(2), strict=True), key=lambda r: r[0]):
            rows.append((k.values.to_numpy(), v.values.to_numpy()))
            target.append(chosen[h])
    weights, bias = fit_scorer(rows, np.array(target))
    return {"listed": listed, "accuracies": dict(zip(LABELLERS, acc.tolist(), strict=True)), "bad_share": bad, "posterior": posterior, "weights": weights.astype(np.float32), "bias": bias}


def _judge(model: dict):
    lexicon, w, bias, posterior, start = Lexicon(model["listed"]), model["weights"], model["bias"], model["posterior"], model["bad_share"]

    def one(text: str | None) -> tuple[int, float, float]:
        cast, counts = votes(text or "", lexicon)
        code = _code(cast)
        if not counts:
            return code, posterior.get(code, start), start
        keys, values = hashed(cast, counts)
        z = float(np.dot(w[keys], values)) + bias
        return code, posterior.get(code, start), 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))

    return one


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, votes, posterior, score, keep) for every row; score is P(bad), keep is score < 0.5."""
    kind = docs.schema[id_col].dataType.simpleString()
    judge = _judge(model)

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                got = [judge(t) for t in cut.column(1).to_pylist()]
                said = ["".join("+.-"[g[0] // 3**j % 3] for j in range(len(LABELLERS))) for g in got]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(said), pa.array([g[1] for g in got]), pa.array([g[2] for g in got]), pa.array([g[2] < 0.5 for g in got])], names=["id", "votes", "posterior", "score", "keep"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, votes string, posterior double, score double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, all columns as they are."""
    judge, at = _judge(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                yield cut.filter(pa.array([judge(t)[2] < 0.5 for t in cut.column(at).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
