"""Secret scan in DataFrame functions: fixed patterns plus a character Markov likelihood ratio.

Two first-order character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A run of key characters is reported when the
log-likelihood ratio per transition is above a threshold. Everything runs as JVM expressions
over one pass of the texts; nothing is shuffled but hashes and counts of the training sample.

Defined cases: a null or empty text has no spans; a very long text is scanned whole; repeated
rows give repeated results; an empty table gives an empty result; a model trained on an empty
sample scores every run 0 and so reports none. Only the two named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import named

# Fixed values of the contract.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Runs that the Markov models judge.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Nats per transition in favour of the random model.
THRESHOLD = 0.35
#: The bounded labelled sample: documents whose whole texts lend ordinary identifiers, and counters whose digests are the random strings.
SAMPLE_DOCS, RANDOM_STRINGS = 2000, 4000

_SPAN = "struct<kind:int,start:int,end:int,score:double>"


def labelled_samples(docs: DataFrame, text: str = "text", n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random, n): ordinary identifiers from a bounded sample of documents, and digest strings; n counts a value's occurrences.

    The sample is the n_docs texts of the smallest hash, so it does not depend on the order of
    the rows. Ordinary: all words of these whole texts, pairs of words joined by an underscore, slash or hyphen or
    in camel case, and decimal numbers. Random: SHA-256 digests of a counter up to RANDOM_STRINGS in hexadecimal and base64.
    """
    spark = docs.sparkSession
    body = F.coalesce(named(text), F.lit(""))
    # The n_docs-th smallest hash first, so that no text is moved.
    last = docs.select(F.xxhash64(body).alias("h")).distinct().orderBy("h").limit(n_docs).agg(F.max("h").alias("h")).first()["h"]
    few = docs.select(body.alias("body"), F.xxhash64(body).alias("h")).where(F.col("h") <= F.lit(last if last is not None else 0)).dropDuplicates(["h"])
    # Words are counted before their forms are made, so each different word is taken apart once.
    word = few.select(F.explode(F.regexp_extract_all("body", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    forms = ("w", "concat(w, '_', lower(reverse(w)))", "concat(lower(w), 'Of', initcap(w))", "concat('/', w, '/', w)", "concat(w, '-', w)")
    plain = word.select(F.explode(F.array(*map(F.expr, forms))).alias("value"), "n")
    counter = spark.range(0, RANDOM_STRINGS, 1, 1).select(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("d"))
    numbers = counter.select(F.regexp_replace(F.conv(F.substring("d", 1, 15), 16, 10), "^$", "0").alias("value"), F.lit(1).cast("long").alias("n"))
    random = counter.select(F.explode(F.array("d", F.regexp_replace(F.base64(F.unhex("d")), "=", ""), F.substring(F.upper("d"), 1, 40))).alias("value"))
    return plain.unionByName(numbers).select("value", F.lit(0).alias("random"), "n").unionByName(random.select("value", F.lit(1).alias("random"), F.lit(1).cast("long").alias("n")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the transitions, row-major over (ALPHABET size + 1) squared, from labelled samples (value, random, n); without a column n each row counts once.

    Index 0 stands for every other character. The driver gets one count per label and pair of
    characters: at most 2 * 67 * 67 rows, whatever the input.
    """
    n = len(ALPHABET) + 1
    weight = F.col("n") if "n" in samples.columns else F.lit(1).cast("long")
    at = samples.where("length(value) > 1").select(
        "random", weight.alias("n"), F.expr(f"transform(filter(split(value, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))").alias("x")
    )
    pairs = at.select("random", "n", F.explode(F.expr(f"zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x)), (a, b) -> a * {n} + b)")).alias("k"))
    counts = {0: [0.0] * (n * n), 1: [0.0] * (n * n)}
    for r in pairs.groupBy("random", "k").agg(F.sum("n").alias("n")).collect():
        counts[r["random"]][r["k"]] = float(r["n"])
    out = [0.0] * (n * n)
    if not (sum(counts[0]) and sum(counts[1])):
        return out
    for a in range(n):
        total = [sum(counts[label][a * n : a * n + n]) + smoothing * n for label in (0, 1)]
        for b in range(n):
            p, q = ((counts[label][a * n + b] + smoothing) / total[label] for label in (0, 1))
            out[a * n + b] = math.log(q / p)
    return out


#: Spans whose lengths are added up together.
STRIDE = 64


def _starts(kind: int) -> str:
    """SQL of the places of the matches m{kind} between the pieces p{kind}: sums of lengths in two levels, so no array is grown."""
    lengths = f"zip_with(p{kind}, m{kind}, (p, m) -> length(p) + coalesce(length(m), 0))"
    sums = f"transform(sequence(0, (size(m{kind}) - 1) div {STRIDE}), c -> aggregate(slice(x, c * {STRIDE} + 1, {STRIDE}), 0, (s, v) -> s + v))"
    before = "transform(y, (v, c) -> aggregate(slice(y, 1, c), 0, (s, w) -> s + w))"
    place = f"transform(m{kind}, (m, i) -> z[i div {STRIDE}] + aggregate(slice(x, i - i % {STRIDE} + 1, i % {STRIDE}), 0, (s, v) -> s + v) + length(p{kind}[i]))"
    bind = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return bind("x", lengths, bind("y", sums, bind("z", before, place)))


def _spans(kind: int) -> str:
    """SQL of the spans of the matches m{kind}, in code points."""
    empty = f"cast(array() as array<{_SPAN}>)"
    return f"""if(size(m{kind}) = 0, {empty}, zip_with({_starts(kind)}, m{kind},
        (a, m) -> named_struct('kind', {kind}, 'start', a, 'end', a + length(m), 'score', cast(null as double))))"""


def find_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, spans): all spans of every text, sorted by start and kind.

    spans is an array of (kind, start, end, score); kind indexes KINDS, positions are code
    points with the end exclusive, score is set for the Markov kind only. A Markov span never
    overlaps a span of the fixed patterns.
    """
    n = len(ALPHABET) + 1
    none = F.expr("cast(array() as array<string>)")
    t = F.col("t")
    found = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("t")).select(
        "id",
        "t",
        F.when(F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")), F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0))).otherwise(none).alias("m0"),
        F.when(F.contains(t, F.lit("AKIA")), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0))).otherwise(none).alias("m1"),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)).alias("m2"),
        F.regexp_extract_all(t, F.lit(RUN), F.lit(0)).alias("m3"),
    )
    between = lambda k, pattern: F.when(F.size(f"m{k}") > 0, F.split(t, pattern, -1)).otherwise(none).alias(f"p{k}")
    cut = found.select(
        "id", "m0", "m1", "m2", "m3",
        F.when(F.size("m0") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("v0"),
        between(0, ASSIGN), between(1, ACCESS), between(2, HEX), between(3, RUN),
    )
    placed = cut.select("id", "v0", "m3", *(F.expr(_spans(k)).alias(f"s{k}") for k in range(4)))
    base = placed.select("id", "m3", "s3", F.expr(f"filter(s0, (s, i) -> length(v0[i]) >= {ASSIGN_VALUE_LEAST})").alias("a0"), "s1", "s2")
    base = base.select("id", "m3", "s3", "a0", F.concat("a0", "s1", "s2").alias("base"))
    ratios = ",".join(f"{x:.5g}" for x in model)
    score = f"""transform(m3, w -> aggregate(transform(array(transform(filter(split(w, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))),
        x -> aggregate(zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x)), (a, b) -> split('{ratios}', ',')[a * {n} + b]), 0D, (s, v) -> s + cast(v as double)) / (size(x) - 1)), 0D, (s, v) -> s + v))"""
    scored = base.select("id", "base", "a0", "m3", "s3", F.when(F.size("m3") > 0, F.expr(score)).otherwise(F.expr("cast(array() as array<double>)")).alias("z"))
    # An access or hex span lies inside one run, so the run itself tells; assign spans may reach beyond.
    free = f"""filter(transform(s3, (s, i) -> named_struct('kind', 3, 'start', s.start, 'end', s.end, 'score', z[i])),
        (s, i) -> s.score > {threshold} and not m3[i] rlike '{ACCESS}|{HEX}' and not exists(a0, b -> b.start < s.end and b.end > s.start))"""
    order = """array_sort(concat(base, {}), (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1
        when a.kind < b.kind then -1 when a.kind > b.kind then 1 else 0 end)"""
    return scored.select(F.col("id").alias(id_col), F.expr(order.format(free)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans of find_secrets()' result."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], cast(s.start as string), cast(s.end as string))), ',')"
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)")
    return found.select(
        named(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(joined("filter(spans, s -> s.kind < 3)")), 256).alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
        count(3).alias("n_markov"),
    )


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Train on the bounded labelled sample, scan every whole text, return the digest columns."""
    return digest(find_secrets(docs, train(labelled_samples(docs))))
