"""Queries over pixel, label and run tables that are made from `part`: 40 pixels wide images of 2000 parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import curves as C
from quillspark.operators import images as I
from quillspark.operators import nearest as N
from quillspark.operators import stats as S
from quillspark.operators import zones as Y
from quillspark.plans.query import Query, table

PX = "WITH px AS (SELECT p_partkey // 2000 AS img, CAST(p_partkey % 40 AS INTEGER) AS x, CAST((p_partkey % 2000) // 40 AS INTEGER) AS y, CAST(p_size * 5 AS INTEGER) AS v FROM part), e AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w + 1 AS x1, min(y) OVER w AS y0, max(y) OVER w + 1 AS y1, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY img)), bw AS (SELECT img, x, y, CASE WHEN v < 125 THEN 0 ELSE 255 END AS v FROM px) "
RUNS = PX + ", g AS (SELECT img, x, y, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS g FROM bw WHERE v <> 0), r AS (SELECT img, y AS line, min(x) AS start, max(x) + 1 AS \"end\" FROM g GROUP BY img, y, g) "


def pixels(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.expr("p_partkey div 2000").alias("img"), (k % 40).cast("int").alias("x"), F.expr("cast((p_partkey % 2000) div 40 as int)").alias("y"), (F.col("p_size") * 5).cast("int").alias("v"))


def black(spark, d): return I.binarize(pixels(spark, d), 125)
def run_table(spark, d): return I.runs(black(spark, d))
def _pixel(f): return lambda spark, d: f(pixels(spark, d))
def _black(f): return lambda spark, d: f(black(spark, d))
def _runs(f): return lambda spark, d: f(run_table(spark, d))


def seeds(spark, d):
    """Label images: some parts are seeds of 23 labels, some are undecided, the others are background."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.expr("p_partkey div 2000").alias("img"), (k % 40).cast("int").alias("x"), F.expr("cast((p_partkey % 2000) div 40 as int)").alias("y"), k)
    label = F.when(F.col("p_partkey") % 37 == 5, F.col("p_partkey") % 23 + 1).when(F.col("p_partkey") % 11 == 3, N.DONTCARE).otherwise(0)
    return p.select("img", "x", "y", label.cast("int").alias("label"))


SEEDS = f"WITH z AS (SELECT p_partkey // 2000 AS img, CAST(p_partkey % 40 AS INTEGER) AS x, CAST((p_partkey % 2000) // 40 AS INTEGER) AS y, CAST(CASE WHEN p_partkey % 37 = 5 THEN p_partkey % 23 + 1 WHEN p_partkey % 11 = 3 THEN {N.DONTCARE} ELSE 0 END AS INTEGER) AS label, p_size FROM part)"
# Of equally near seeds that of least x, in it the nearer row, then the upper one.
_NEAR_LABEL = "arg_min(z.label, CAST((z.x - a.x) * (z.x - a.x) + (z.y - a.y) * (z.y - a.y) AS BIGINT) * 100000000 + z.x * 10000 + abs(z.y - a.y) * 100 + z.y)"
_SPREAD = ", n AS (SELECT a.img, a.x, a.y, " + _NEAR_LABEL + " AS near FROM z a JOIN z ON a.img = z.img WHERE {of} GROUP BY 1, 2, 3) SELECT z.img, z.x, z.y, CASE WHEN {to} THEN coalesce(near, z.label) ELSE z.label END AS label FROM z LEFT JOIN n ON z.img = n.img AND z.x = n.x AND z.y = n.y"
_ONTO = ", n AS (SELECT a.img, a.x, a.y, " + _NEAR_LABEL + " AS near FROM z a JOIN z ON a.img = z.img WHERE z.label <> 0 GROUP BY 1, 2, 3) SELECT z.img, z.x, z.y, CASE WHEN p_size * 5 >= 125 THEN coalesce(near, 255) ELSE 0 END AS label FROM z LEFT JOIN n ON z.img = n.img AND z.x = n.x AND z.y = n.y"


def page_ink(spark, d):
    """Pages of sixty parts: two columns of five paragraphs of six lines, each line as long as its part's size."""
    line = F.expr("cast((p_partkey % 30) div 6 * 10 + p_partkey % 6 as int)")
    start = F.expr("cast((p_partkey % 60) div 30 * 60 as int)")
    p = table(spark, d, "part").select(F.expr("p_partkey div 60").alias("img"), line.alias("y"), start.alias("_from"), "p_size")
    return p.select("img", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("p_size") - 1)).alias("x"), "y", F.lit(120).alias("width"), F.lit(50).alias("height"))


def _skeleton(p):
    """A whole image whose ink is the skeleton of p."""
    return p.select("img", "x", "y").join(C.thin(p).withColumn("v", F.lit(255)), ["img", "x", "y"], "left").fillna(0, ["v"])


def _boxes_of(spark, d):
    return spark.sql("SELECT 0L AS img, 3 AS x0, 1 AS y0, 9 AS x1, 4 AS y1 UNION ALL SELECT 0L, 20, 2, 25, 5")


_N8 = "FROM px a LEFT JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y)"
_MORPH = "SELECT a.img, a.x, a.y, {f}(b.v) AS v FROM {t} a JOIN {t} b ON a.img = b.img AND abs(a.x - b.x) <= {rx} AND abs(a.y - b.y) <= {ry} GROUP BY a.img, a.x, a.y"
_DISC = "SELECT a.img, a.x, a.y, {f}(b.v) AS v FROM px a JOIN px b ON a.img = b.img AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY a.img, a.x, a.y"
_OPEN = PX + ", m1 AS (" + _MORPH.format(f="min", t="px", rx=1, ry=1) + "), m2 AS (" + _MORPH.format(f="max", t="m1", rx=1, ry=1) + ") SELECT * FROM m2"
_CLOSE = PX + ", m1 AS (" + _MORPH.format(f="max", t="px", rx=2, ry=1) + "), m2 AS (" + _MORPH.format(f="min", t="m1", rx=2, ry=1) + ") SELECT * FROM m2"


def _extrema(largest):
    f, c = ("max", ">") if largest else ("min", "<")
    return PX + f"SELECT a.img, a.x, a.y, a.v {_N8} GROUP BY a.img, a.x, a.y, a.v HAVING a.v {c} {f}(b.v)"


def _gauss(spark, d):
    """Sliding maxima and minima along x, and peaks: above the left and not below the right neighbour."""
    from pyspark.sql import Window

    w = Window.partitionBy("img", "y").orderBy("x")
    p = pixels(spark, d).select("*", F.lag("v").over(w).alias("l"), F.lead("v").over(w).alias("r"), F.min("v").over(w.rangeBetween(-2, 2)).alias("low"))
    peak = (F.col("l") < F.col("v")) & (F.col("r") < F.col("v"))
    valley = (F.col("v") <= F.col("low")) & (F.col("v") <= F.col("l")) & (F.col("v") < F.col("r")) & (F.col("v") <= 60)
    return p.groupBy("img", "y").agg(F.sum(peak.cast("long")).alias("peaks"), F.sum(valley.cast("long")).alias("minima"))


def _profile(spark, d):
    from quillspark.operators import profiles as P

    return P.profile_islands(I.projection(black(spark, d), "x"), 2, 3)


_NEAREST = "SELECT a.img, a.x, a.y, CAST(min({size}) AS BIGINT) AS distance FROM bw a LEFT JOIN bw b ON a.img = b.img AND b.v <> 0 GROUP BY a.img, a.x, a.y"

QUERIES = {
    "image_crop": Query(_pixel(lambda p: I.crop(p, 5, 1, 30, 4)), PX + "SELECT img, x - 5 AS x, y - 1 AS y, v FROM px WHERE x >= 5 AND x < 30 AND y >= 1 AND y < 4"),
    "image_shift": Query(_pixel(lambda p: I.shift(p, 3, -2)), PX + "SELECT img, x + 3 AS x, y - 2 AS y, v FROM px"),
    "image_circular_shift": Query(_pixel(lambda p: I.circular_shift(p, 7, 2)), PX + "SELECT img, (x + 7) % x1 AS x, (y + 2) % y1 AS y, v FROM e"),
    "image_flip_x": Query(_pixel(I.flip_x), PX + "SELECT img, x1 - 1 - x AS x, y, v FROM e"),
    "image_flip_y": Query(_pixel(I.flip_y), PX + "SELECT img, x, y1 - 1 - y AS y, v FROM e"),
    "image_rotate_right": Query(_pixel(I.rotate_right), PX + "SELECT img, y1 - 1 - y AS x, x AS y, v FROM e"),
    "image_transpose": Query(_pixel(I.transpose), PX + "SELECT img, y AS x, x AS y, v FROM px"),
    "image_pad": Query(_pixel(lambda p: I.pad(p, 2, 1, 9)), PX + ", a AS (SELECT img, x, y, v, y0, y1, unnest(generate_series(CASE WHEN x = x0 THEN x - 2 ELSE x END, CASE WHEN x = x1 - 1 THEN x + 2 ELSE x END)) AS p FROM e), b AS (SELECT *, unnest(generate_series(CASE WHEN y = y0 THEN y - 1 ELSE y END, CASE WHEN y = y1 - 1 THEN y + 1 ELSE y END)) AS q FROM a) SELECT img, CAST(p + 2 AS INTEGER) AS x, CAST(q + 1 AS INTEGER) AS y, CASE WHEN p = x AND q = y THEN v ELSE 9 END AS v FROM b"),
    "image_erase_boundary": Query(_pixel(lambda p: I.erase_boundary(p, 2, 1)), PX + "SELECT img, x, y, CASE WHEN x < x0 + 2 OR x >= x1 - 2 OR y < y0 + 1 OR y >= y1 - 1 THEN 0 ELSE v END AS v FROM e"),
    "image_tighten": Query(_black(I.tighten), PX + "SELECT b.img, b.x - t.x0 AS x, b.y - t.y0 AS y, b.v FROM bw b JOIN (SELECT img, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM bw WHERE v <> 0 GROUP BY img) t ON b.img = t.img WHERE b.x >= t.x0 AND b.x < t.x1 AND b.y >= t.y0 AND b.y < t.y1"),
    "image_binarize_middle": Query(_pixel(I.binarize_middle), PX + "SELECT img, x, y, CASE WHEN v < (lo + hi) // 2 THEN 0 ELSE 255 END AS v FROM e"),
    "image_binarize_range": Query(_pixel(lambda p: I.binarize_range(p, 0.25)), PX + "SELECT img, x, y, CASE WHEN v < lo + (hi - lo) * 0.25 THEN 0 ELSE 255 END AS v FROM e"),
    "image_binarize": Query(black, PX + "SELECT * FROM bw"),
    "image_invert": Query(_pixel(I.invert), PX + "SELECT img, x, y, 255 - v AS v FROM px"),
    "image_remove_boxes": Query(lambda s, d: I.remove_boxes(pixels(s, d), _boxes_of(s, d)), PX + "SELECT img, x, y, CASE WHEN img = 0 AND ((x >= 3 AND x < 9 AND y >= 1 AND y < 4) OR (x >= 20 AND x < 25 AND y >= 2 AND y < 5)) THEN 0 ELSE v END AS v FROM px"),
    "image_erode_rect": Query(_pixel(lambda p: I.erode_rect(p, 2, 1)), PX + _MORPH.format(f="min", t="px", rx=2, ry=1)),
    "image_dilate_rect": Query(_pixel(lambda p: I.dilate_rect(p, 2, 1)), PX + _MORPH.format(f="max", t="px", rx=2, ry=1)),
    "image_open_rect": Query(_pixel(lambda p: I.open_rect(p, 1, 1)), _OPEN),
    "image_close_rect": Query(_pixel(lambda p: I.close_rect(p, 2, 1)), _CLOSE),
    "image_erode_disc": Query(_pixel(lambda p: I.erode_disc(p, 2)), PX + _DISC.format(f="min")),
    "image_dilate_disc": Query(_pixel(lambda p: I.dilate_disc(p, 2)), PX + _DISC.format(f="max")),
    "image_median_filter": Query(_pixel(lambda p: I.median_filter(p, 1, 1)), PX + "SELECT a.img, a.x, a.y, list_sort(list(b.v))[count(*) // 2 + 1] AS v FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.x, a.y"),
    "image_local_mean": Query(_pixel(lambda p: I.local_mean(p, 2).withColumn("v", F.round("v", 6))), PX + "SELECT a.img, a.x, a.y, round(avg(b.v), 6) AS v FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.img, a.x, a.y"),
    "image_sauvola": Query(_pixel(lambda p: I.sauvola(p, 2, 0.3)), PX + "SELECT a.img, a.x, a.y, CASE WHEN a.v < avg(b.v) * (1 + 0.3 * (stddev_pop(b.v) / 128.0 - 1)) THEN 0 ELSE 255 END AS v FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.img, a.x, a.y, a.v"),
    "image_laplacian": Query(_pixel(I.laplacian), PX + "SELECT a.img, a.x, a.y, CAST(4 * a.v - coalesce(sum(b.v), 0) AS DOUBLE) AS v FROM px a LEFT JOIN px b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.img, a.x, a.y, a.v"),
    "image_plus_laplacian": Query(_pixel(lambda p: I.laplacian(p, -1)), PX + "SELECT a.img, a.x, a.y, CAST(coalesce(sum(b.v), 0) - 4 * a.v AS DOUBLE) AS v FROM px a LEFT JOIN px b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.img, a.x, a.y, a.v"),
    "image_gradient": Query(_pixel(lambda p: I.gradient(p).select("img", "x", "y", "gx", "gy", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 6).alias("mag"), F.round(F.atan2("gy", "gx"), 6).alias("ang"))), PX + "SELECT *, round(sqrt(gx * gx + gy * gy), 6) AS mag, round(atan2(gy, gx), 6) AS ang FROM (SELECT img, x, y, lead(v) OVER (PARTITION BY img, y ORDER BY x) - lag(v) OVER (PARTITION BY img, y ORDER BY x) AS gx, lead(v) OVER (PARTITION BY img, x ORDER BY y) - lag(v) OVER (PARTITION BY img, x ORDER BY y) AS gy FROM px) WHERE gx IS NOT NULL AND gy IS NOT NULL"),
    "image_local_maxima": Query(_pixel(lambda p: I.local_extrema(p, True)), _extrema(True)),
    "image_local_minima": Query(_pixel(lambda p: I.local_extrema(p, False)), _extrema(False)),
    "image_count_neighbours": Query(_black(lambda p: I.count_neighbours(p)), PX + "SELECT a.img, a.x, a.y, CAST(sum(CASE WHEN b.v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS v FROM bw a LEFT JOIN bw b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY a.img, a.x, a.y"),
    "image_projection_x": Query(_black(lambda p: I.projection(p, "x")), PX + "SELECT img, x AS at, count(*) AS n FROM bw WHERE v <> 0 GROUP BY img, x"),
    "image_projection_y": Query(_black(lambda p: I.projection(p, "y")), PX + "SELECT img, y AS at, count(*) AS n FROM bw WHERE v <> 0 GROUP BY img, y"),
    "image_centroid": Query(_pixel(lambda p: I.centroid(p).select("img", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))), PX + "SELECT img, round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy FROM px GROUP BY img"),
    "image_label_boxes": Query(_pixel(lambda p: I.boxes(p.withColumnRenamed("v", "label"))), PX + "SELECT img, v AS label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n FROM px WHERE v <> 0 GROUP BY img, v"),
    "image_border_mean": Query(_pixel(lambda p: I.border_mean(p).withColumn("mean", F.round("mean", 6))), PX + "SELECT img, round(avg(v), 6) AS mean FROM e WHERE x = x0 OR y = y0 OR x = x1 - 1 OR y = y1 - 1 GROUP BY img"),
    "image_integral": Query(_pixel(I.integral), PX + "SELECT a.img, a.x, a.y, CAST(sum(b.v) AS BIGINT) AS v FROM px a JOIN px b ON a.img = b.img AND b.x <= a.x AND b.y <= a.y GROUP BY a.img, a.x, a.y") ,
    "image_and_shifted": Query(_black(lambda p: I.pixel_and(p, p, 1, 0)), PX + "SELECT a.img, a.x, a.y, a.v FROM bw a JOIN bw b ON a.img = b.img AND a.x = b.x + 1 AND a.y = b.y WHERE a.v <> 0 AND b.v <> 0"),
    "image_or_shifted": Query(_black(lambda p: I.pixel_or(p, p, 1, 0)), PX + "SELECT DISTINCT img, x, y, 255 AS v FROM (SELECT img, x, y FROM bw WHERE v <> 0 UNION ALL SELECT img, x + 1, y FROM bw WHERE v <> 0)"),
    "image_otsu": Query(_pixel(lambda p: S.otsu(S.histogram(p, F.col("v"), ["img"]), ["img"])), PX + ", h AS (SELECT img, v AS bucket, count(*) AS n FROM px GROUP BY img, v), c AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum(bucket * n) OVER u AS DOUBLE) AS s0, CAST(sum(n) OVER p AS DOUBLE) AS w, CAST(sum(bucket * n) OVER p AS DOUBLE) AS s FROM h WINDOW u AS (PARTITION BY img ORDER BY bucket), p AS (PARTITION BY img)), f AS (SELECT img, bucket, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 3) AS b FROM c WHERE w0 < w) SELECT img, CAST(arg_min(bucket, -b * 1000 + bucket * 0.00001) AS INTEGER) AS threshold FROM f GROUP BY img"),
    "image_peaks": Query(_gauss, PX + "SELECT img, y, CAST(sum(CASE WHEN l < v AND r < v THEN 1 WHEN l IS NULL OR r IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS peaks, CAST(sum(CASE WHEN v <= low AND v <= l AND v < r AND v <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS minima FROM (SELECT *, lag(v) OVER (PARTITION BY img, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY img, y ORDER BY x) AS r, min(v) OVER (PARTITION BY img, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low FROM px) GROUP BY img, y"),
    "image_nearest_label": Query(lambda s, d: N.propagate_labels(seeds(s, d)), SEEDS + _SPREAD.format(of="z.label <> 0", to="z.label = 0")),
    "image_nearest_label_onto": Query(lambda s, d: N.propagate_labels_to(black(s, d).withColumnRenamed("v", "label"), seeds(s, d)), SEEDS + _ONTO),
    "image_remove_dontcares": Query(lambda s, d: N.remove_dontcares(seeds(s, d)), SEEDS + _SPREAD.format(of=f"z.label NOT IN (0, {N.DONTCARE})", to=f"z.label = {N.DONTCARE}")),
    "page_zones": Query(lambda s, d: Y.xy_cut(page_ink(s, d), least_x=5, least_y=2).select("img", "x0", "y0", "x1", "y1"), "SELECT p_partkey // 60 AS img, CAST(min(col * 60) AS INTEGER) AS x0, CAST(min(line) AS INTEGER) AS y0, CAST(max(col * 60 + p_size) AS INTEGER) AS x1, CAST(max(line) + 1 AS INTEGER) AS y1 FROM (SELECT p_partkey, p_size, (p_partkey % 60) // 30 AS col, (p_partkey % 30) // 6 AS par, (p_partkey % 30) // 6 * 10 + p_partkey % 6 AS line FROM part) GROUP BY p_partkey // 60, col, par"),
    "image_thin": Query(_black(C.thin)),
    "image_chains": Query(_black(lambda p: C.trace_chains(_skeleton(p)))),
    "image_polygons": Query(_black(lambda p: C.approximate(C.trace_chains(_skeleton(p)), ["img", "component", "nth"]))),
    "image_distance_squared": Query(_black(lambda p: N.distance_transform(p, "squared")), PX + _NEAREST.format(size="(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)")),
    "image_distance_l1": Query(_black(lambda p: N.distance_transform(p, "l1")), PX + _NEAREST.format(size="abs(a.x - b.x) + abs(a.y - b.y)")),
    "image_distance_max": Query(_black(lambda p: N.distance_transform(p, "max")), PX + _NEAREST.format(size="greatest(abs(a.x - b.x), abs(a.y - b.y))")),
    "image_components": Query(_black(lambda p: I.label_components(p).groupBy("img", "label").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0")).drop("label")), PX.replace("WITH px", "WITH RECURSIVE px") + ", f AS (SELECT img, x, y, y * 40 + x AS id FROM bw WHERE v <> 0), c(img, x, y, id) AS (SELECT img, x, y, id FROM f UNION SELECT f.img, f.x, f.y, c.id FROM c JOIN f ON f.img = c.img AND abs(f.x - c.x) + abs(f.y - c.y) = 1 AND f.id >= 0), m AS (SELECT img, x, y, min(id) AS id FROM c GROUP BY img, x, y) SELECT img, count(*) AS n, min(x) AS x0, min(y) AS y0 FROM m GROUP BY img, id"),
    "image_profile_islands": Query(_profile, PX + ", n AS (SELECT img, x AS at_x, count(*) AS n FROM bw WHERE v <> 0 GROUP BY 1, 2), g AS (SELECT *, at_x - row_number() OVER (PARTITION BY img ORDER BY at_x) AS g FROM n WHERE n >= 2), s AS (SELECT img, min(at_x) AS first, max(at_x) + 1 AS last FROM g GROUP BY img, g HAVING max(n) >= 3) SELECT img, CAST(row_number() OVER (PARTITION BY img ORDER BY first) AS INTEGER) AS island, CAST(first AS INTEGER) AS start, CAST(last AS INTEGER) AS \"end\" FROM s"),
    "runs_of_lines": Query(run_table, RUNS + 'SELECT img, line, start, "end" FROM r'),
    "runs_bits": Query(_runs(lambda r: r.groupBy("img").agg(F.sum(F.col("end") - F.col("start")).alias("bits"))), PX + "SELECT img, count(*) AS bits FROM bw WHERE v <> 0 GROUP BY img"),
    "runs_boxes": Query(_runs(lambda r: r.groupBy("img").agg(F.min("start").alias("x0"), F.min("line").alias("y0"), F.max("end").alias("x1"), (F.max("line") + 1).alias("y1"))), PX + "SELECT img, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM bw WHERE v <> 0 GROUP BY img"),
    "runs_lengths": Query(_runs(I.run_lengths), RUNS + 'SELECT img, "end" - start AS bucket, count(*) AS n FROM r GROUP BY 1, 2'),
    "runs_invert": Query(_runs(lambda r: I.invert_runs(r, 40)), RUNS + ', q AS (SELECT img, line, coalesce(lag("end") OVER (PARTITION BY img, line ORDER BY start), 0) AS start, start AS "end" FROM r UNION ALL SELECT img, line, max("end"), 40 FROM r GROUP BY img, line) SELECT * FROM q WHERE start < "end"'),
    "runs_erode": Query(_runs(lambda r: I.erode_runs(r, 3)), RUNS + 'SELECT img, line, start + 1 AS start, "end" - 1 AS "end" FROM r WHERE start + 1 < "end" - 1'),
    "runs_dilate": Query(_runs(lambda r: I.dilate_runs(r, 3, 40)), RUNS + ', d AS (SELECT DISTINCT img, line, x FROM (SELECT img, line, unnest(generate_series(greatest(0, start - 1), least(40, "end" + 1) - 1)) AS x FROM r)), k AS (SELECT img, line, x, x - row_number() OVER (PARTITION BY img, line ORDER BY x) AS g FROM d) SELECT img, line, CAST(min(x) AS INTEGER) AS start, CAST(max(x) + 1 AS INTEGER) AS "end" FROM k GROUP BY img, line, g'),
    "runs_and": Query(lambda s, d: I.and_runs(run_table(s, d), I.erode_runs(I.transpose_runs(I.transpose_runs(run_table(s, d))), 2)), RUNS + 'SELECT a.img, a.line, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM r a JOIN (SELECT img, line, start, "end" - 1 AS "end" FROM r WHERE start < "end" - 1) b ON a.img = b.img AND a.line = b.line AND a.start < b."end" AND b.start < a."end"'),
    "runs_or": Query(lambda s, d: I.or_runs(run_table(s, d), I.invert_runs(run_table(s, d), 40)), RUNS + 'SELECT DISTINCT img, line, 0 AS start, 40 AS "end" FROM r'),
    "runs_transpose": Query(_runs(I.transpose_runs), PX + ', g AS (SELECT img, x, y, y - row_number() OVER (PARTITION BY img, x ORDER BY y) AS g FROM bw WHERE v <> 0) SELECT img, x AS line, min(y) AS start, max(y) + 1 AS "end" FROM g GROUP BY img, x, g'),
}
