"""Queries that compare segmentations, measure pages, fit, draw and resample."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillspark.operators import edges as G
from quillspark.operators import evaluation as E
from quillspark.operators import resample as M
from quillspark.operators import stats as S
from quillspark.plans.image_queries import PX, pixels
from quillspark.plans.query import Query, table

CELLS = "WITH t AS (SELECT l_linenumber AS a, CASE WHEN l_quantity < 50 - 3 * l_linenumber THEN l_linenumber ELSE l_linenumber % 7 + 1 END AS b, l_quantity FROM lineitem), cells AS (SELECT a, b, count(DISTINCT l_quantity) AS n FROM t GROUP BY a, b) "
SIDES = CELLS + ", s AS (SELECT 'model' AS side, a AS label, n, b <> 3 AS clear FROM cells WHERE a <> 7 UNION ALL SELECT 'image', b, n, a <> 7 FROM cells WHERE b <> 3), tot AS (SELECT side, label, sum(CASE WHEN clear THEN n ELSE 0 END) AS total FROM s GROUP BY 1, 2), p AS (SELECT s.*, tot.total FROM s JOIN tot USING (side, label) WHERE side = 'model' OR clear) "
HEIGHTS = "WITH h AS (SELECT p_brand, p_size AS bucket, count(*) AS n FROM part WHERE p_size < 200 GROUP BY 1, 2), top AS (SELECT p_brand, max(bucket) AS top FROM h GROUP BY 1), g AS (SELECT p_brand, top, unnest(range(0, top + 1)) AS bucket FROM top), k AS (SELECT unnest(range(-13, 14)) AS d), sm AS (SELECT g.p_brand, g.bucket, round(sum(coalesce(h.n, 0) * exp(-d * d / 32.0)) / (SELECT sum(exp(-d * d / 32.0)) FROM k), 9) AS v FROM g CROSS JOIN k LEFT JOIN h ON h.p_brand = g.p_brand AND h.bucket = least(greatest(g.bucket + d, 0), g.top) WHERE g.bucket >= 2 GROUP BY 1, 2) "
MEDIAN = "WITH h AS (SELECT l_linestatus, CAST(round(l_discount * 100) AS INTEGER) * 7 AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY l_linestatus ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY l_linestatus) AS total FROM h), i AS (SELECT l_linestatus, min(bucket) + (arg_min(total, bucket) / 2.0 - (arg_min(upto, bucket) - arg_min(n, bucket))) / arg_min(n, bucket)::DOUBLE AS p FROM c WHERE upto * 2 >= total GROUP BY 1) "
SKEW = "WITH r AS (SELECT l_suppkey, l_discount, l_extendedprice, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_suppkey) AS top FROM lineitem), u AS (SELECT * FROM r WHERE l_linenumber >= 6 OR top < 6), s AS (SELECT l_suppkey, list_sort(list(l_discount)) AS g, list_sort(list(l_extendedprice)) AS e FROM u GROUP BY 1) "
FIT = "WITH t AS (SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 10 AS DOUBLE) AS b FROM part), m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, avg(y) AS y, avg(a) AS a, avg(b) AS b FROM t), w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb FROM m) "
DRAWS = "WITH c AS (SELECT p_partkey AS id, CAST(sum(p_size) OVER (ORDER BY p_partkey % 1024, p_partkey) - p_size AS DOUBLE) AS low FROM part), d AS (SELECT o_orderkey AS draw, ((o_orderkey * 7919) % 10007 + 0.5::DOUBLE) / 10007 * (SELECT sum(p_size)::DOUBLE FROM part) AS at FROM orders) "
#: A turn of 0.3.
COS, SIN = math.cos(0.3), math.sin(0.3)
_LINE = "SELECT a.img, a.x, a.y, sum(b.v * exp(-d * d / {q})) / (SELECT sum(exp(-d * d / {q})) FROM {k}) AS v FROM (SELECT *, min({c}) OVER w AS lo, max({c}) OVER w AS hi FROM {t} WINDOW w AS (PARTITION BY img, {o})) a CROSS JOIN {k} JOIN {t} b ON b.img = a.img AND b.{o} = a.{o} AND b.{c} = least(greatest(a.{c} + d, lo), hi) GROUP BY ALL"
GAUSS = PX + ", ky AS (SELECT unnest(range(-4, 5)) AS d), kx AS (SELECT unnest(range(-7, 8)) AS d), g1 AS (" + _LINE.format(q="2.0", k="ky", c="y", o="x", t="px") + "), g2 AS (" + _LINE.format(q="8.0", k="kx", c="x", o="y", t="g1") + ") "
_SCALED = PX + ", z AS (SELECT DISTINCT img, max(x1) OVER (PARTITION BY img) AS w, max(y1) OVER (PARTITION BY img) AS h FROM e), n AS (SELECT *, greatest(1, CAST(floor(w * 1.5) AS INTEGER)) AS nx, greatest(1, CAST(floor(h * 0.7) AS INTEGER)) AS ny FROM z), gx AS (SELECT *, unnest(range(0, nx)) AS x FROM n), gy AS (SELECT *, unnest(range(0, ny)) AS y FROM gx), pl AS (SELECT *, {px} AS px, {py} AS py FROM (SELECT *, x * w / nx::DOUBLE AS ux, y * h / ny::DOUBLE AS uy FROM gy)) SELECT pl.img, CAST(pl.x AS INTEGER) AS x, CAST(pl.y AS INTEGER) AS y, round(sum(v * (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END)), 6) AS v FROM pl CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) f(i, j) JOIN px b ON b.img = pl.img AND b.x = least(w - 1, floor(px) + i) AND b.y = least(h - 1, floor(py) + j) GROUP BY 1, 2, 3"
GRAD = PX + ", d AS (SELECT a.img, a.x, a.y, r.v - a.v AS gx, u.v - a.v AS gy FROM px a LEFT JOIN px r ON r.img = a.img AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN px u ON u.img = a.img AND u.x = a.x AND u.y = a.y + 1), g AS (SELECT img, x, y, CASE WHEN gx + gy IS NULL THEN 0 ELSE gx END AS gx, CASE WHEN gx + gy IS NULL THEN 0 ELSE gy END AS gy, CASE WHEN gx + gy IS NULL THEN 0 ELSE sqrt(gx * gx + gy * gy) END AS gm FROM d) "
SUPPRESSED = GRAD + ", q AS (SELECT a.*, CASE WHEN a.gx >= 0 THEN 1 ELSE -1 END AS bx, CASE WHEN a.gy >= 0 THEN 1 ELSE -1 END AS \"by\", abs(a.gx) > abs(a.gy) AS flat, greatest(abs(a.gx), abs(a.gy)) AS hi, least(abs(a.gx), abs(a.gy)) AS lo FROM g a JOIN g b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING count(*) = 9), f AS (SELECT q.*, o.x - q.x AS ox, o.y - q.y AS oy, o.gm AS og FROM q JOIN g o ON o.img = q.img AND abs(o.x - q.x) <= 1 AND abs(o.y - q.y) <= 1), w AS (SELECT img, x, y, gm, hi, lo, max(CASE WHEN ox = -bx AND oy = -\"by\" THEN og END) AS d0, max(CASE WHEN ox = bx AND oy = \"by\" THEN og END) AS d1, max(CASE WHEN ox = -(CASE WHEN flat THEN bx ELSE 0 END) AND oy = -(CASE WHEN flat THEN 0 ELSE \"by\" END) THEN og END) AS u0, max(CASE WHEN ox = CASE WHEN flat THEN bx ELSE 0 END AND oy = CASE WHEN flat THEN 0 ELSE \"by\" END THEN og END) AS u1 FROM f GROUP BY ALL), sup AS (SELECT * FROM w WHERE hi * gm > lo * d0 + (hi - lo) * u0 AND hi * gm >= lo * d1 + (hi - lo) * u1) "
FRACTILE = GRAD + ", nz AS (SELECT img, gm, min(gm) OVER w AS lo, max(gm) OVER w AS hi, count(*) OVER w AS n FROM g WHERE gm <> 0 WINDOW w AS (PARTITION BY img)), b AS (SELECT *, least(999, floor(1000 / (hi - lo) * (gm - lo))) AS b FROM nz), k AS (SELECT img, lo, hi, n, b, count(*) AS c FROM b GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY img ORDER BY b) AS upto FROM k) SELECT img, round(max(lo) + (max(hi) - max(lo)) * (min(b) + 1) / 1000, 6) AS fractile FROM r WHERE upto >= floor(n * 0.3) GROUP BY img"
HYSTERESIS = "WITH RECURSIVE " + PX[5:] + ", reach AS (SELECT img, x, y FROM px WHERE v >= 230 UNION SELECT o.img, o.x, o.y FROM reach q JOIN px o ON o.img = q.img AND o.v >= 150 AND abs(o.x - q.x) <= 1 AND abs(o.y - q.y) <= 1 AND NOT (o.x = q.x - 1 AND o.y = q.y - 1)) SELECT px.img, px.x, px.y, CASE WHEN r.img IS NOT NULL THEN 1.0 WHEN v >= 150 THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM px LEFT JOIN reach r ON r.img = px.img AND r.x = px.x AND r.y = px.y"
CURVATURE = PX + ", n AS (SELECT a.img, a.x, a.y, " + ", ".join(f"max(CASE WHEN b.x = a.x + {i} AND b.y = a.y + {j} THEN b.v END)::DOUBLE AS n{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1)) + " FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9), c AS (SELECT *, (n21 - n01) / 2 AS dx, (n12 - n10) / 2 AS dy FROM n) SELECT img, x, y, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE ((2 * n11 - n01 - n21) * dy * dy - 2 * (n00 + n22 - n20 - n02) * dx * dy + (2 * n11 - n10 - n12) * dx * dx) / (dx * dx + dy * dy) END, 6) AS v FROM c"


def cells(s, d):
    k = F.col("l_linenumber")
    t = table(s, d, "lineitem").select(k.alias("a"), F.when(F.col("l_quantity") < 50 - 3 * k, k).otherwise(k % 7 + 1).alias("b"), "l_quantity")
    return t.groupBy("a", "b").agg(F.count_distinct("l_quantity").alias("n"))


def discounts(s, d): return S.histogram(table(s, d, "lineitem"), F.round(F.col("l_discount") * 100).cast("int") * 7, ["l_linestatus"])
def rounded(df, *names): return df.withColumns({n: F.round(n, 6) for n in names})


def fit(s, d):
    t = table(s, d, "part").select(F.col("p_retailprice").alias("y"), F.lit(1.0).alias("one"), F.col("p_size").alias("a"), (F.col("p_partkey") % 10).alias("b"))
    return E.least_squares(t, ["one", "a", "b"], "y").withColumn("weight", F.round("weight", 4))


def draws(s, d):
    o = F.col("o_orderkey")
    return E.weighted_draws(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("weight")), table(s, d, "orders").select(o.alias("draw"), (((o * 7919) % 10007 + 0.5) / 10007).alias("u")))


def chi_squared(s, d):
    return s.createDataFrame([(k, a, E.chi_squared_limit(k, a)) for k in (1, 2, 4, 9, 30) for a in (0.5, 0.05, 0.001)], "degrees int, alpha double, critical double")


def datasets(s, d):
    v = table(s, d, "embeddings")
    return E.merge_datasets(v.select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.size("embedding").alias("n")), table(s, d, "labels").select(F.col("doc_id").alias("id"), F.lit(2).alias("n")))


QUERIES = {
    "seg_report": Query(lambda s, d: E.segment_report(cells(s, d), 0.3, 15, (7, 3)), SIDES + ", l AS (SELECT side, label, total, CASE WHEN total > 0 THEN count(CASE WHEN n > 0.3 * total OR n >= 15 THEN 1 END) ELSE 0 END AS k FROM p GROUP BY 1, 2, 3) SELECT side, count(*) AS segments, CAST(sum(CASE WHEN total = 0 THEN 1 ELSE k END) AS BIGINT) AS parts, CAST(sum(CASE WHEN total > 0 AND k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS split, CAST(sum(CASE WHEN total = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM l GROUP BY 1"),
    "seg_share_histogram": Query(lambda s, d: E.share_histogram(cells(s, d), 10, (7, 3)), SIDES + "SELECT side, CAST(least(9, floor(n / total * 10)) AS INTEGER) AS bucket, count(*) AS n FROM p WHERE total > 0 GROUP BY 1, 2"),
    "seg_one_to_one": Query(lambda s, d: E.one_to_one(cells(s, d), 0.2, 10, (7, 3)), CELLS + ", c AS (SELECT * FROM cells WHERE a <> 7 AND b <> 3) SELECT a, b, n FROM c WHERE n >= 10 AND n >= 0.8 * (SELECT sum(n) FROM c o WHERE o.a = c.a) AND n >= 0.8 * (SELECT sum(n) FROM c o WHERE o.b = c.b) AND NOT EXISTS (SELECT 1 FROM c o WHERE o.n >= 10 AND ((o.a = c.a) <> (o.b = c.b)))"),
    "stats_settled_median": Query(lambda s, d: rounded(E.settled_median(discounts(s, d), ["l_linestatus"]), "median"), MEDIAN + "SELECT l_linestatus, round(CASE WHEN count(CASE WHEN bucket = floor(p) THEN 1 END) = 0 AND sum(n) > 1 THEN (max(CASE WHEN bucket < p THEN bucket END) + min(CASE WHEN bucket > p THEN bucket END)) / 2.0 ELSE max(p) END, 6) AS median FROM h JOIN i USING (l_linestatus) GROUP BY 1"),
    "page_x_height": Query(lambda s, d: E.x_height(table(s, d, "part"), "p_size", "p_brand"), HEIGHTS + "SELECT p_brand, CAST(max(bucket) AS INTEGER) AS x_height FROM sm s WHERE v = (SELECT max(v) FROM sm o WHERE o.p_brand = s.p_brand) GROUP BY 1"),
    "page_skew": Query(lambda s, d: E.page_skew(table(s, d, "lineitem"), "l_suppkey", "l_discount", "l_extendedprice", "l_linenumber", 6), SKEW + "SELECT l_suppkey, g[CAST(floor(len(g) * 0.5) AS BIGINT) + 1] AS gradient, e[CAST(floor(len(e) * 0.5) AS BIGINT) + 1] AS error FROM s"),
    "chi_squared_limits": Query(chi_squared),
    "least_squares_fit": Query(fit, FIT + "SELECT 0 AS k, round(y - wa * a - wb * b, 4) AS weight FROM w UNION ALL SELECT 1, round(wa, 4) FROM w UNION ALL SELECT 2, round(wb, 4) FROM w"),
    "weighted_draws": Query(draws, DRAWS + "SELECT d.draw, c.id FROM d ASOF JOIN c ON d.at >= c.low"),
    "dataset_merge": Query(datasets, "SELECT vec_id AS id, label AS cls, CAST(len(embedding) AS INTEGER) AS n FROM embeddings UNION ALL SELECT doc_id, NULL, 2 FROM labels"),
    "image_gauss2d": Query(lambda s, d: rounded(M.gauss2d(pixels(s, d), 2.0, 1.0), "v"), GAUSS + "SELECT img, x, y, round(v, 6) AS v FROM g2"),
    "image_forward_gradients": Query(lambda s, d: rounded(M.forward_gradients(pixels(s, d)), "gm"), GRAD + "SELECT img, x, y, gx, gy, round(gm, 6) AS gm FROM g"),
    "image_suppress": Query(lambda s, d: rounded(G.suppress(M.forward_gradients(pixels(s, d))), "gm"), SUPPRESSED + "SELECT img, x, y, round(gm, 6) AS gm FROM sup"),
    "image_nonzero_fractile": Query(lambda s, d: rounded(G.nonzero_fractile(M.forward_gradients(pixels(s, d)), "gm", 0.3, 1000), "fractile"), FRACTILE),
    "image_hysteresis": Query(lambda s, d: G.hysteresis(pixels(s, d), "v", 150, 230), HYSTERESIS),
    "image_level_curvature": Query(lambda s, d: rounded(G.level_curvature(pixels(s, d)), "v"), CURVATURE),
    "sample_split": Query(lambda s, d: E.split_samples(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0.1), "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey % 1024, o_orderkey) <= (SELECT floor(count(*) * 0.1) FROM orders) AS testing FROM orders"),
    "image_rotate_sample": Query(lambda s, d: M.rotate_sample(pixels(s, d), COS, SIN), PX + f", q AS (SELECT img, x, y, x0, x1, y0, y1, floor((x - x1 / 2.0) * {COS}::DOUBLE - (y - y1 / 2.0) * {SIN}::DOUBLE + x1 / 2.0 + 1) AS sx, floor((x - x1 / 2.0) * {SIN}::DOUBLE + (y - y1 / 2.0) * {COS}::DOUBLE + y1 / 2.0 + 1) AS sy FROM e) SELECT q.img, q.x, q.y, b.v FROM q JOIN px b ON b.img = q.img AND b.x = greatest(x0, least(x1 - 1, sx)) AND b.y = greatest(y0, least(y1 - 1, sy))"),
    "image_scale_interpolate": Query(lambda s, d: rounded(M.scale_interpolate(pixels(s, d), 1.5, 0.7, False), "v"), _SCALED.format(px="ux", py="uy")),
    "image_scale_whole": Query(lambda s, d: rounded(M.scale_interpolate(pixels(s, d), 1.5, 0.7), "v"), _SCALED.format(px="floor(ux + 0.5)", py="floor(uy + 0.5)")),
}
