"""Queries over the quantised vectors of `embeddings`: element-wise algebra, edits, order and norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import arrays as A
from quillspark.plans.query import Query, table

V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS a FROM embeddings) "
P = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS a FROM embeddings), p AS (SELECT vec_id, a, list_reverse(a) AS b FROM v) "
L = "WITH v AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), l AS (SELECT vec_id, i, CAST(round(CAST(e AS DOUBLE) * 100) AS INTEGER) AS x FROM v) "


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.quantize(F.col("embedding")).alias("a"))


def elementwise(spark, d):
    a = F.col("a")
    t = A.total
    return vectors(spark, d).select(
        "vec_id", t(A.add(a, 3)).alias("s_add"), t(A.sub(a, 3)).alias("s_sub"), t(A.rsub(3, a)).alias("s_rsub"), t(A.mul(a, 2)).alias("s_mul"),
        t(A.largest(a, 5)).alias("s_max"), t(A.smallest(a, 5)).alias("s_min"), t(A.neg(a)).alias("s_neg"), t(A.absolute(a)).alias("s_abs"),
        t(A.greater(a, 4)).alias("s_greater"), t(A.less(a, 4)).alias("s_less"), t(A.clip(a, -10, 10)).alias("s_clip"),
        t(A.linear(a, 2, 1, -30, 30)).alias("s_linear"), t(A.power(a, 2)).alias("s_pow"),
    )


_S = "CAST(list_sum(list_transform(a, lambda x: {})) AS DOUBLE) AS {}"
ELEMENTWISE = V + "SELECT vec_id, " + ", ".join(
    _S.format(e, n)
    for e, n in (
        ("x + 3", "s_add"), ("x - 3", "s_sub"), ("3 - x", "s_rsub"), ("x * 2", "s_mul"), ("greatest(x, 5)", "s_max"), ("least(x, 5)", "s_min"), ("-x", "s_neg"), ("abs(x)", "s_abs"),
        ("CASE WHEN x > 4 THEN 1 ELSE 0 END", "s_greater"), ("CASE WHEN x < 4 THEN 1 ELSE 0 END", "s_less"), ("least(greatest(x, -10), 10)", "s_clip"), ("least(greatest(x * 2 + 1, -30), 30)", "s_linear"), ("x * x", "s_pow"),
    )
) + " FROM v"


def transcendental(spark, d):
    a = F.col("a")
    r = lambda x, n: F.round(A.total(x), 5).alias(n)
    one = A.add(A.absolute(a), 1)
    return vectors(spark, d).select(
        "vec_id", r(A.log(one), "s_log"), r(A.exp(A.div(a, 50)), "s_exp"), r(A.sin(a), "s_sin"), r(A.cos(a), "s_cos"),
        r(A.div(a, 7), "s_div"), r(A.rdiv(7, one), "s_rdiv"), r(A.gamma(one, 1.5, 0.5, 0.0, 9.0), "s_gamma"), r(A.expand_range(a, 0, 255), "s_expand"),
    )


_R = "round(list_sum(list_transform(a, lambda x: {})), 5) AS {}"
TRANSCENDENTAL = V + "SELECT vec_id, " + ", ".join(
    _R.format(e, n)
    for e, n in (
        ("ln(abs(x) + 1)", "s_log"), ("exp(x / 50)", "s_exp"), ("sin(x)", "s_sin"), ("cos(x)", "s_cos"), ("x / 7", "s_div"), ("7 / (abs(x) + 1)", "s_rdiv"), ("least(greatest(1.5::DOUBLE * sqrt(abs(x) + 1), 0), 9)", "s_gamma"),
        ("CASE WHEN list_max(a) = list_min(a) THEN 0 ELSE (x - list_min(a)) * 255 / (list_max(a) - list_min(a)) END", "s_expand"),
    )
) + " FROM v"


def pairs(spark, d):
    v = vectors(spark, d).withColumn("b", A.reverse(F.col("a")))
    a, b = F.col("a"), F.col("b")
    t = A.total
    return v.select(
        "vec_id", t(A.add(a, b)).alias("p_add"), t(A.sub(a, b)).alias("p_sub"), t(A.mul(a, b)).alias("p_mul"), t(A.largest(a, b)).alias("p_max"), t(A.smallest(a, b)).alias("p_min"),
        t(A.ifelse(A.greater(a, 0), a, b)).alias("p_ifelse"), t(A.blend(A.greater(a, 0), b, a)).alias("p_blend"), A.dist2squared(a, b).alias("d2"), F.round(A.dist2(a, b), 6).alias("d"), A.hamming(a, b, 0).alias("hamming"),
    )


_Z = "CAST(list_sum(list_transform(list_zip(a, b), lambda z: {})) AS DOUBLE) AS {}"
PAIRS = P + "SELECT vec_id, " + ", ".join(
    _Z.format(e, n)
    for e, n in (
        ("z[1] + z[2]", "p_add"), ("z[1] - z[2]", "p_sub"), ("z[1] * z[2]", "p_mul"), ("greatest(z[1], z[2])", "p_max"), ("least(z[1], z[2])", "p_min"),
        ("CASE WHEN z[1] > 0 THEN z[1] ELSE z[2] END", "p_ifelse"), ("CASE WHEN z[1] > 0 THEN z[2] ELSE z[1] END", "p_blend"), ("(z[1] - z[2]) * (z[1] - z[2])", "d2"),
    )
) + ", round(sqrt(CAST(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS DOUBLE)), 6) AS d, CAST(len(list_filter(list_zip(a, b), lambda z: (z[1] > 0) <> (z[2] > 0))) AS INTEGER) AS hamming FROM p"


def edits(spark, d):
    a = F.col("a")
    return vectors(spark, d).select(
        "vec_id", A.first_index_of(a, 3).alias("first_3"), F.size(A.remove_value(a, 3)).alias("n_without_3"), A.total(A.remove_element(a, 2)).alias("s_without_2"),
        F.get(A.insert_at(a, 1, 77), F.lit(1)).alias("inserted"), F.get(A.insert_at(a, 1, 77), F.lit(2)).alias("moved"), F.get(A.reverse(a), F.lit(0)).alias("last"),
        A.bounded_at(a, 5000, -1).alias("outside"), A.clamped_at(a, 5000).alias("clamped"), A.total(A.pick(a, F.array(F.lit(0), F.lit(2), F.lit(4)))).alias("s_pick"),
        A.contains_only(A.greater(a, 0), (0, 1)).alias("only_bits"), A.has_nan(a).alias("has_nan"), A.total(A.iota(F.size(a))).alias("s_iota"), A.argmax(A.unit_vector(9, 4)).alias("unit_at"),
    )


EDITS = V + """SELECT vec_id, CAST(coalesce(list_position(a, 3), 0) - 1 AS INTEGER) AS first_3, CAST(len(list_filter(a, lambda x: x <> 3)) AS INTEGER) AS n_without_3,
    CAST(list_sum(a) - a[3] AS DOUBLE) AS s_without_2, 77 AS inserted, a[2] AS moved, a[len(a)] AS last, -1 AS outside, a[len(a)] AS clamped,
    CAST(a[1] + a[3] + a[5] AS DOUBLE) AS s_pick, true AS only_bits, false AS has_nan, CAST(len(a) * (len(a) - 1) // 2 AS DOUBLE) AS s_iota, 4 AS unit_at FROM v"""


def norms(spark, d):
    a = F.col("a")
    r = lambda x, n: F.round(x, 6).alias(n)
    return vectors(spark, d).select(
        "vec_id", F.array_max(a).alias("most"), F.array_min(a).alias("least"), F.array_max(A.absolute(a)).alias("absmax"), A.total(a).alias("total"), A.argmax(a).alias("argmax"), A.argmin(a).alias("argmin"),
        A.norm1(a).alias("norm1"), r(A.norm2(a), "norm2"), r(A.total(A.absolute(A.normalize1(a))), "unit1"), r(A.norm2(A.normalize2(a)), "unit2"),
        F.round(A.product(A.clip(A.add(A.absolute(F.slice(a, 1, 5)), 1), 1, 9)), 0).alias("product5"), A.popcount(a, 0).alias("popcount"),
        r(A.entropy(A.normalize1(A.absolute(a))), "entropy"), r(A.perplexity(A.normalize1(A.absolute(a))), "perplexity"),
    )


NORMS = V + """SELECT vec_id, list_max(a) AS most, list_min(a) AS least, list_max(list_transform(a, lambda x: abs(x))) AS absmax, CAST(list_sum(a) AS DOUBLE) AS total,
    CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS argmax, CAST(list_position(a, list_min(a)) - 1 AS INTEGER) AS argmin, CAST(list_sum(list_transform(a, lambda x: abs(x))) AS DOUBLE) AS norm1,
    round(sqrt(CAST(list_sum(list_transform(a, lambda x: x * x)) AS DOUBLE)), 6) AS norm2, 1.0::DOUBLE AS unit1, 1.0::DOUBLE AS unit2,
    CAST(list_product(list_transform(a[1:5], lambda x: least(abs(x) + 1, 9))) AS DOUBLE) AS product5, CAST(len(list_filter(a, lambda x: x > 0)) AS INTEGER) AS popcount,
    round(list_sum(list_transform(a, lambda x: CASE WHEN x = 0 THEN 0 ELSE -(abs(x) / list_sum(list_transform(a, lambda y: abs(y)))) * ln(abs(x) / list_sum(list_transform(a, lambda y: abs(y)))) END)), 6) AS entropy,
    round(exp(list_sum(list_transform(a, lambda x: CASE WHEN x = 0 THEN 0 ELSE -(abs(x) / list_sum(list_transform(a, lambda y: abs(y)))) * ln(abs(x) / list_sum(list_transform(a, lambda y: abs(y)))) END))), 6) AS perplexity FROM v"""


def order(spark, d):
    a = F.col("a")
    weigh = lambda x: A.total(F.transform(x, lambda v, i: v * i))
    return vectors(spark, d).select(
        "vec_id", weigh(A.argsort(a)).alias("w_argsort"), weigh(A.ranks(a)).alias("w_ranks"), weigh(A.permute(a, A.argsort(a))).alias("w_sorted"),
        weigh(A.n_smallest(a, 5)).alias("w_small"), weigh(A.n_largest(a, 5)).alias("w_large"), A.fractile(a, 0.25).alias("q25"), A.upper_median(a).alias("median"), A.middle_median(a).alias("middle"),
        F.size(A.uniq(a)).alias("n_uniq"), A.binsearch(F.array_sort(a), 0).alias("below"), A.is_sorted(a).alias("sorted"), A.total(A.sparsify(a, 10)).alias("s_sparse"),
    )


ORDER = L + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1 AS up, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS down,
        row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC) AS m, count(*) OVER (PARTITION BY vec_id) AS n FROM l),
    s AS (SELECT *, max(CASE WHEN m = 10 THEN abs(x) END) OVER (PARTITION BY vec_id) AS cut, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM r)
    SELECT vec_id, CAST(sum(i * up) AS DOUBLE) AS w_argsort, CAST(sum(i * up) AS DOUBLE) AS w_ranks, CAST(sum(x * up) AS DOUBLE) AS w_sorted, CAST(sum(CASE WHEN up < 5 THEN i * up ELSE 0 END) AS DOUBLE) AS w_small,
    CAST(sum(CASE WHEN down < 5 THEN i * down ELSE 0 END) AS DOUBLE) AS w_large, max(CASE WHEN up = n // 4 THEN x END) AS q25, max(CASE WHEN up = n // 2 THEN x END) AS median,
    (max(CASE WHEN up = (n - 1) // 2 THEN x END) + max(CASE WHEN up = n // 2 THEN x END)) / 2 AS middle, CAST(count(DISTINCT x) AS INTEGER) AS n_uniq,
    CAST(sum(CASE WHEN x <= 0 THEN 1 ELSE 0 END) - 1 AS INTEGER) AS below, bool_and(before IS NULL OR before <= x) AS sorted, CAST(sum(CASE WHEN abs(x) >= cut THEN x ELSE 0 END) AS DOUBLE) AS s_sparse FROM s GROUP BY vec_id"""


def rows(spark, d):
    """Row operators: sums by row and column, the mean row, and the nearest row to it."""
    v = vectors(spark, d).select("vec_id", F.posexplode("a").alias("k", "x"))
    return v.groupBy("k").agg(F.sum("x").alias("colsum"), F.round(F.avg("x"), 6).alias("mean"), F.max_by("vec_id", F.struct("x", -F.col("vec_id"))).alias("argmax_row"))


ROWS = L + "SELECT CAST(i AS INTEGER) AS k, CAST(sum(x) AS BIGINT) AS colsum, round(avg(x), 6) AS mean, arg_max(vec_id, x * 1000000 - vec_id) AS argmax_row FROM l GROUP BY i"


def prefix(spark, d):
    """Rows whose first two values equal a prefix, and counts of equal neighbours in sorted order."""
    v = vectors(spark, d).withColumn("key", F.slice(A.greater(F.col("a"), 0), 1, 6))
    return v.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws("", F.col("key").cast("array<string>")).alias("prefix"), "n", (F.col("n") - 1).alias("duplicates"))


PREFIX = V + "SELECT array_to_string(list_transform(a[1:6], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), '') AS prefix, count(*) AS n, count(*) - 1 AS duplicates FROM v GROUP BY 1"


QUERIES = {
    "array_elementwise": Query(elementwise, ELEMENTWISE),
    "array_transcendental": Query(transcendental, TRANSCENDENTAL),
    "array_pairs": Query(pairs, PAIRS),
    "array_edits": Query(edits, EDITS),
    "array_norms": Query(norms, NORMS),
    "array_order": Query(order, ORDER),
    "array_rows": Query(rows, ROWS),
    "array_prefix_select": Query(prefix, PREFIX),
}
