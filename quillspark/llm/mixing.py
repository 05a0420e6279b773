"""Mixing of sources to target weights, in DataFrame functions.

Source weights are token shares raised to an exponent and normalised. The exponent is found by
bisection so that the mixture meets a target entropy or a repetition limit. The weights are
realised as block permutations: the documents of a source fall into blocks of a bounded size,
each epoch visits the blocks in an order of its own, and an epoch that the token budget does
not fill ends inside one block.

The budget is a number of tokens; by default it is the least that uses every source once
whole, so that no document is lost and others are repeated.

Defined cases: a null source is a source of its own; a null text has no token; a source
without tokens gets each document once; an empty table gives an empty result; repeated rows
count and are drawn as often as they occur; ties in the hash order go by id. Only the named
columns are read; extra columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import reliable, word_count

#: Documents of a block, on average.
BLOCK_DOCS = 256
REPETITION = 2.0
SEED = 17
#: Exponents tried at once in a round of the bisection, and its rounds.
STEPS, ROUNDS = 15, 8
#: A table of sources up to so many rows is broadcast (under 1 MB).
BROADCAST_SOURCES = 10_000


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, docs, tokens) from rows of (source, n_tokens): partial sums before the shuffle."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def _measure(totals: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy in nats and highest repetition of each exponent's mixture; one row of each comes to the driver."""
    grid = totals.where("tokens > 0").select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    w = F.pow(F.col("tokens").cast("double"), F.col("a"))
    got = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wlogw"), F.max(w / F.col("tokens")).alias("most"), F.min(w / F.col("tokens")).alias("least")).collect()
    return {r["a"]: (math.log(r["z"]) - r["wlogw"] / r["z"], r["most"] / r["least"]) for r in got}


def find_exponent(totals: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None) -> float:
    """The exponent in [0, 1] by bisection, several halvings to a round.

    With `entropy` (nats): the largest exponent whose mixture has that entropy at least. Else
    the smallest whose most repeated source occurs `repetition` times as often as the least
    repeated one at most. 1 keeps the shares as they are, 0 makes all sources equal.
    """
    fits = (lambda h, r: h < entropy) if entropy is not None else (lambda h, r: r <= repetition)
    low, high = 0.0, 1.0
    ends = _measure(totals, [0.0, 1.0])
    if not ends:
        return 1.0
    if entropy is not None and not fits(*ends[1.0]):
        return 1.0
    if fits(*ends[0.0]):
        return 0.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / (STEPS + 1) for k in range(1, STEPS + 1)]
        got = _measure(totals, tried)
        good = [a for a in tried if fits(*got[a])]
        high = min(good, default=high)
        low = max((a for a in tried if a < high and not fits(*got[a])), default=low)
        if high - low < 1e-12:
            break
    return low if entropy is not None else high


def plan(totals: DataFrame, exponent: float, budget: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source, docs, tokens, weight, passes, whole, rest_tokens, blocks): what each source gives.

    passes = weight * budget / tokens; whole of them are full epochs, and the next one ends
    after rest_tokens tokens.
    """
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0)
    weighted = totals.withColumn("w", w)
    z = weighted.agg(F.sum("w").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("w"))).alias("most")).first()
    total = z["z"] or 1.0
    tokens_out = float(budget) if budget is not None else (z["most"] or 0.0) * total
    # A pass that misses a whole number only by rounding counts as whole.
    passes = F.when(F.col("tokens") > 0, F.round(F.col("w") / F.lit(total) * F.lit(tokens_out) / F.col("tokens"), 9)).otherwise(1.0)
    return weighted.select(
        "source", "docs", "tokens", (F.col("w") / total).alias("weight"), passes.alias("passes"), F.floor(passes).cast("int").alias("whole"),
        F.floor((passes - F.floor(passes)) * F.col("tokens")).cast("long").alias("rest_tokens"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long").alias("blocks"),
    )


def _cuts(rows: DataFrame, shares: DataFrame, seed: int, small: bool) -> DataFrame:
    """(source, cut_rank, cut_block, cut_order, cut_id): the last document of each source's unfinished epoch.

    Blocks come in the order of their rank and documents in that of their hash, so one place
    for each source tells for every row by itself whether it is drawn once more.
    """
    hint = F.broadcast if small else (lambda x: x)
    placed = rows.join(hint(shares.where("rest_tokens > 0").select("source", "blocks", "whole", "rest_tokens")), "source").withColumn("block", block_of(seed))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("b_tokens"), F.max("rest_tokens").alias("rest_tokens"), F.max("whole").alias("whole"))
    before = _running(sums.withColumn("rank", rank_of(seed, F.col("whole"))))
    last = before.where("b_before < rest_tokens").groupBy("source").agg(F.max(F.struct("rank", "block", (F.col("rest_tokens") - F.col("b_before")).alias("left"))).alias("last"))
    last = reliable(last.select("source", F.col("last.block").alias("cut_block"), F.col("last.rank").alias("cut_rank"), F.col("last.left").alias("left")))
    inside = Window.partitionBy("source").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.join(hint(last), "source").where("block = cut_block").withColumn("order", order_of(seed, F.col("whole")))
    some = some.withColumn("b", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("b < left")
    return some.groupBy("source").agg(F.max("cut_rank").alias("cut_rank"), F.max("cut_block").alias("cut_block"), F.max(F.struct("order", "id")).alias("cut"))


def block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks"))


def rank_of(seed: int, epoch: Column) -> Column:
    """A block's place in an epoch of its source."""
    return F.xxhash64(F.lit(seed), F.col("source"), epoch, F.col("block"))


def order_of(seed: int, epoch: Column) -> Column:
    """A document's place in its block."""
    return F.xxhash64(F.lit(seed), epoch, F.col("id"))


def _keyed(docs: DataFrame, id_col: str, source_col: str) -> list[Column]:
    """id, and source as a text that no null and no other source shares."""
    source = F.col(f"`{source_col}`")
    return [F.col(f"`{id_col}`").alias("id"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("source")]


def _draw(rows: DataFrame, shares: DataFrame, seed: int, small: bool) -> DataFrame:
    """rows (id, source, ...) once for each time that they are drawn, with epoch, block and both orders. Nothing is shuffled."""
    at = rows.join(F.broadcast(shares) if small else shares, "source").withColumn("block", block_of(seed))
    rank, order = rank_of(seed, F.col("whole")), order_of(seed, F.col("whole"))
    more = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & ((F.col("block") < F.col("cut_block")) | ((F.col("block") == F.col("cut_block")) & (F.struct(order.alias("order"), F.col("id")) <= F.col("cut")))))
    times = F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")
    drawn = at.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return drawn.withColumn("block_rank", rank_of(seed, F.col("epoch"))).withColumn("slot", order_of(seed, F.col("epoch")))


def _shares(rows: DataFrame, repetition: float | None, entropy: float | None, budget: int | None, seed: int, block_docs: int) -> tuple[DataFrame, bool]:
    totals = reliable(source_totals(rows))
    shares = plan(totals, find_exponent(totals, repetition, entropy), budget, block_docs)
    small = totals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    shares = reliable(shares)
    return reliable(shares.join(_cuts(rows, shares, seed, small), "source", "left")), small


def mix(docs: DataFrame, n_tokens: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The mixture: a row for each time that a document is drawn.

    (id_col, source_col, n_tokens, epoch, block, block_rank, slot, weight, passes). An epoch of
    a source is read in the order of (block_rank, slot).
    """
    tokens = word_count(F.col(f"`{text_col}`")) if n_tokens is None else n_tokens
    rows = reliable(docs.select(*_keyed(docs, id_col, source_col), F.col(f"`{source_col}`").alias("given"), tokens.alias("n_tokens")))  # the texts are read once
    shares, small = _shares(rows, repetition, entropy, budget, seed, block_docs)
    drawn = _draw(rows, shares, seed, small)
    return drawn.select(F.col("id").alias(id_col), F.col("given").alias(source_col), "n_tokens", "epoch", "block", "block_rank", "slot", "weight", "passes")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All columns of docs, a row for each time that a document is drawn; the texts stay where they lie."""
    rows = reliable(docs.select(*_keyed(docs, id_col, source_col), word_count(F.col(f"`{text_col}`")).alias("n_tokens")))
    shares, small = _shares(rows, repetition, entropy, budget, seed, block_docs)
    packed = docs.select(*_keyed(docs, id_col, source_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return _draw(packed, shares, seed, small).select("row.*")


def _running(sums: DataFrame, groups: int = 256) -> DataFrame:
    """sums with b_before, the tokens of a source's blocks of a lower rank.

    Two levels: ranks fall into `groups` ranges, so that no task gets all blocks of a source.
    """
    width = 2**64 // groups
    ranged = sums.withColumn("range", F.floor(F.col("rank") / F.lit(float(width))))
    inside = Window.partitionBy("source", "range").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    top = ranged.groupBy("source", "range").agg(F.sum("b_tokens").alias("t")).withColumn("r_before", F.coalesce(F.sum("t").over(over), F.lit(0))).drop("t")
    return ranged.withColumn("in_before", F.coalesce(F.sum("b_tokens").over(inside), F.lit(0))).join(top, ["source", "range"]).withColumn("b_before", F.col("in_before") + F.col("r_before"))
