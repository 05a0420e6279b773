"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Texts and passages are folded to lower-case letters, digits and single spaces. A place of a
text within k edits of a passage of n characters shares n - q + 1 - k * q of its character
q-grams at least, all on neighbouring diagonals. Shared q-grams are counted in overlapping
bands of diagonals, regions that reach the bound are kept, and a banded alignment decides.

Passages longer than WINDOW characters are cut into overlapping windows, so that a part of one
of WINDOW + STEP characters is found too, whatever the length of the passage. Passages go
through in blocks of BLOCK characters at most, so what a task holds is bounded; every block is
matched against all texts, and one block or many give the same hits.

Defined cases: a null or empty text or passage matches nothing; a passage of fewer than q
folded characters cannot be told from chance and matches nothing; a passage so short that the
bound would be empty is matched with as many edits as leave one q-gram; a passage under
several ids is reported under each, a repeated row of benchmark once; ids may have any type;
repeated rows are judged alike, row by row; empty tables give empty results or no matches.
Only the named columns are read; the filter returns its input's columns untouched, whatever
their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
#: Edits for each character of a passage.
EDITS = 0.05
#: Passages over WINDOW folded characters become windows of WINDOW, one each STEP.
WINDOW, STEP = 240, 80
#: Folded characters of a block of passages, and characters of texts that are looked up at once.
BLOCK, TEXTS = 1_000_000, 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """What each character of the basic plane becomes: a lower-case letter or digit, a space, or 0 for 0."""
    out = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(1, 0x10000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0] = 0
    return out


def fold(points: np.ndarray) -> np.ndarray:
    """Code points folded, runs of spaces as one. Characters beyond the basic plane stay."""
    x = points.copy()
    basic = x < 0x10000
    x[basic] = folding()[x[basic]]
    space = x == 32
    drop = np.zeros(len(x), dtype=bool)
    drop[1:] = space[1:] & (space[:-1] | (x[:-1] == 0))
    return x[~drop]


def fold_text(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").replace("\0", " ").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint32)
    x = fold(points)
    a, b = 0, len(x)
    if b and x[0] == 32:
        a = 1
    if b > a and x[-1] == 32:
        b -= 1
    return x[a:b]


def grams(x: np.ndarray) -> np.ndarray:
    """Hashes of all windows of Q characters, made by doubling."""
    h = x.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    power, have, out, done = {1: h}, 1, None, 0
    factor = {1: _BASE}
    with np.errstate(over="ignore"):
        while have * 2 <= Q:
            power[have * 2] = power[have][:-have] * factor[have] + power[have][have:]
            factor[have * 2] = factor[have] * factor[have]
            have *= 2
        n = len(x) - Q + 1
        for size in sorted(power, reverse=True):
            if Q & size:
                part = power[size][done : done + n]
                out = part.copy() if out is None else out * factor[size] + part
                done += size
    return out


class Index:
    """Q-grams of a block of passages.

    pieces: (item, offset, folded characters); bits tells most strange q-grams at once.
    """

    WIDTH = 22

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]]):
        self.pieces = [p for p in pieces if len(p[2]) >= Q]
        hashes = [grams(p[2]) for p in self.pieces]
        total = sum(map(len, hashes))
        h = np.concatenate(hashes) if total else np.zeros(0, dtype=np.uint64)
        piece = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        at = np.concatenate([np.arange(len(x)) for x in hashes]) if total else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.piece, self.at = h[order], piece[order], at[order]
        self.bits = np.zeros(1 << self.WIDTH, dtype=bool)
        self.bits[self.h >> np.uint64(64 - self.WIDTH)] = True
        n = np.array([len(p[2]) for p in self.pieces], dtype=np.int64)
        # As many edits as leave a bound of one shared q-gram at least.
        self.edits = np.maximum(0, np.minimum((EDITS * n).astype(np.int64), (n - Q) // Q))
        self.bound = n - Q + 1 - self.edits * Q
        self.length = n

    def regions(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, lowest diagonal, highest diagonal) of the regions of x that reach the bound.

        The diagonal of a shared q-gram is its place in x less its place in the piece. Bands are
        twice as wide as the edits allow and overlap by half, so every alignment lies in one.
        """
        if len(x) < Q or not len(self.h):
            return []
        h = grams(x)
        place = np.flatnonzero(self.bits[h >> np.uint64(64 - self.WIDTH)])
        if not len(place):
            return []
        key = h[place]
        lo = np.searchsorted(self.h, key, side="left")
        n = np.searchsorted(self.h, key, side="right") - lo
        real = n > 0
        place, lo, n = place[real], lo[real], n[real]
        if not len(place):
            return []
        out: list[tuple[int, int, int]] = []
        # Expanded in slices, so that a frequent q-gram does not fill the memory.
        counts: dict[int, int] = {}
        ends = np.cumsum(n)
        start = 0
        span = int(self.length.max() + len(x)) + 1
        width = 2 * (self.edits + 1)
        while start < len(place):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000, side="right")))
            reps = n[start:stop]
            entry = np.repeat(lo[start:stop], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
            piece = self.piece[entry]
            diagonal = np.repeat(place[start:stop], reps) - self.at[entry] + self.length[piece]  # from 0 up
            half = diagonal // (width[piece] // 2)
            # A band is named by its first half; a q-gram counts in both bands that hold it.
            code = np.concatenate((piece * span * 2 + half, piece * span * 2 + np.maximum(half - 1, 0)))
            code = np.concatenate((code[: len(half)], code[len(half) :][half > 0]))
            got, times = np.unique(code, return_counts=True)
            if not counts and stop == len(place):
                pairs = zip(got.tolist(), times.tolist(), strict=True)
                out = [self._band(c, span, width) for c, t in pairs if t >= self.bound[c // (span * 2)]]
                break
            for c, t in zip(got.tolist(), times.tolist(), strict=True):
                counts[c] = counts.get(c, 0) + t
            start = stop
        else:
            out = [self._band(c, span, width) for c, t in counts.items() if t >= self.bound[c // (span * 2)]]
        return sorted(out)

    def _band(self, code: int, span: int, width: np.ndarray) -> tuple[int, int, int]:
        piece, half = divmod(code, span * 2)
        low = half * (int(width[piece]) // 2) - int(self.length[piece])
        return piece, low, low + int(width[piece]) - 1

    def matches(self, x: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, offset of the piece, start, end, edits) of the best place of every piece in x; start and end in folded characters."""
        best: dict[int, tuple[int, int, int]] = {}
        for piece, low, high in self.regions(x):
            if best.get(piece, (1,))[0] == 0:
                continue
            p, k = self.pieces[piece][2], int(self.edits[piece])
            start, stop = max(0, low - k), min(len(x), high + len(p) + k)
            found = align(p, x[start:stop], low - k - start, high + k - start, k)
            if found and (piece not in best or found[0] < best[piece][0]):
                best[piece] = (found[0], start + found[1], start + found[2])
        return sorted({(self.pieces[p][0], self.pieces[p][1], a, b, d) for p, (d, a, b) in best.items()}, key=lambda h: (h[0] is not None, h))


def align(p: np.ndarray, x: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of all of p with a part of x on the diagonals low..high, if within `most`.

    Row by row over p; cell j of a row stands for the diagonal low + j. Insertions run along a
    row, which a running minimum settles at once.
    """
    m, width = len(p), high - low + 1
    far = m + len(x) + 1
    steps = np.arange(width)
    at = low + steps  # place in x after i characters of p is i + diagonal
    cost = np.where((at >= 0) & (at <= len(x)), 0, far)
    begin = at.copy()
    padded = np.concatenate((np.full(max(0, -low) + 1, 0, dtype=x.dtype), x, np.full(width + m + max(0, low) + 1, 0, dtype=x.dtype)))
    shift = max(0, -low) + 1
    for i in range(m):
        c = i + low + shift
        take = cost + (padded[c : c + width] != p[i])
        skip = np.append(cost[1:] + 1, far)  # p[i] has no partner
        now = np.where(take <= skip, take, skip)
        begin = np.where(take <= skip, begin, np.append(begin[1:], 0))
        at = i + 1 + low + steps
        now[(at < 0) | (at > len(x))] = far
        run = now - steps
        least = np.minimum.accumulate(run)
        # The cell that the running minimum came from.
        source = np.maximum.accumulate(np.where(run == least, steps, 0))
        begin = begin[source]
        cost = np.minimum(least + steps, far)
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    return (int(cost[j]), int(begin[j]), int(m + low + j)) if cost[j] <= most else None


def pieces_of(item: int, text: str | None) -> list[tuple[int, int, np.ndarray]]:
    x = fold_text(text)
    if len(x) <= WINDOW:
        return [(item, 0, x)]
    starts = [*range(0, len(x) - WINDOW, STEP), len(x) - WINDOW]
    return [(item, s, x[s : s + WINDOW]) for s in starts]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Lists of pieces of BLOCK characters at most (or one passage), in the order of the ids; one block is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).orderBy("id", "text").toLocalIterator():
        own = pieces_of(r["id"], r["text"])
        n = sum(len(p[2]) for p in own)
        if held and size + n > BLOCK:
            yield held
            held, size = [], 0
        held, size = held + own, size + n
    yield held


def _texts_matches(index: Index, texts: list[str | None]):
    """matches() of each text; texts are folded and looked up together, up to TEXTS characters at once."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= TEXTS):
            size += len(texts[stop] or "")
            stop += 1
        joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts[at:stop]) + "\0"
        x = fold(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint32))
        edges = np.flatnonzero(x == 0)
        # Texts without any q-gram of the block are done here.
        live = np.zeros(stop - at, dtype=bool)
        if len(x) >= Q and len(index.h):
            hit = np.flatnonzero(index.bits[grams(x) >> np.uint64(64 - Index.WIDTH)])
            per = np.bincount(np.searchsorted(edges, hit, side="right") - 1, minlength=stop - at)[: stop - at]
            live = per >= int(index.bound.min())
        for k in range(stop - at):
            if not live[k]:
                yield []
                continue
            a, b = int(edges[k]) + 1, int(edges[k + 1])
            if b > a and x[a] == 32:
                a += 1
            if b > a and x[b - 1] == 32:
                b -= 1
            yield index.matches(x[a:b])
        at = stop


def _hit(benchmark: DataFrame, id_col: str) -> str:
    return f"struct<item:{benchmark.schema[id_col].dataType.simpleString()},offset:int,start:int,end:int,edits:int>"


def _hits(found: list[tuple]) -> list[dict]:
    return [dict(zip(("item", "offset", "start", "end", "edits"), h, strict=True)) for h in found]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, contaminated, item_ids, hits) for every row of docs.

    hits: (item, offset of the window in the passage, start, end, edits), places in folded
    characters of the text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, hit = docs.schema[id_col].dataType.simpleString(), _hit(benchmark, item_col)
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    one = pa.struct([("item", item_type), *((n, pa.int32()) for n in ("offset", "start", "end", "edits"))])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def report(pieces):
        def run(batches):
            index = Index(pieces)
            for b in batches:
                hits = pa.array([_hits(f) for f in _texts_matches(index, b.column(1).to_pylist())], pa.list_(one))
                yield pa.RecordBatch.from_arrays([b.column(0), hits], names=["id", "hits"])

        return run

    def sparse(pieces):
        """(h, hit) of the texts that match a block."""

        def run(batches):
            index = Index(pieces)
            for b in batches:
                keys, hits = [], []
                for h, found in zip(b.column(0).to_pylist(), _texts_matches(index, b.column(1).to_pylist()), strict=True):
                    keys += [h] * len(found)
                    hits += _hits(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hits, one)], names=["h", "hit"])

        return rows.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"h long, hit {hit}")

    first, union, n = None, None, 0
    for pieces in blocks(benchmark, item_col):
        n += 1
        if n == 1:
            first = pieces
            continue
        # Further blocks: by text, as only its hits are moved.
        union = (sparse(first) if union is None else union).unionByName(sparse(pieces))
    if union is None:
        done = rows.mapInArrow(report(first), f"id {kind}, hits array<{hit}>")
    else:
        grouped = union.groupBy("h").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
        done = rows.select("id", F.xxhash64("text").alias("h")).join(grouped, "h", "left").select("id", F.coalesce("hits", F.expr(f"cast(array() as array<{hit}>)")).alias("hits"))
    return done.select(F.col("id").alias(id_col), (F.size("hits") > 0).alias("contaminated"), F.expr("array_sort(array_distinct(transform(hits, h -> h.item)))").alias("item_ids"), "hits")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that match no passage, all columns as they are; nothing is shuffled."""
    at, schema = docs.columns.index(text_col), docs.schema

    def cleaner(pieces):
        def run(batches):
            index = Index(pieces)
            for b in batches:
                yield b.filter(pa.array([not found for found in _texts_matches(index, b.column(at).to_pylist())], pa.bool_()))

        return run

    for pieces in blocks(benchmark):
        docs = docs.mapInArrow(cleaner(pieces), schema)
    return docs
