"""Queries over the star tables, events, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import arrays as A
from quillspark.functions import text as T
from quillspark.operators import automata as W
from quillspark.operators import images as I
from quillspark.operators import learning as N
from quillspark.operators import lms as L
from quillspark.operators import profiles as P
from quillspark.operators import relabel as R
from quillspark.operators import search as Z
from quillspark.operators import spatial as B
from quillspark.operators import stats as S
from quillspark.plans import components
from quillspark.plans.query import Query, table
from quillspark.sources import automaton_files as Q
from quillspark.sources import formats
from quillspark.streaming import frames

H = "WITH h AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2) "
C = "WITH h AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total FROM h) "
BOX = "WITH bx AS (SELECT p_partkey // 50 AS img, p_partkey AS id, CAST((p_partkey * 37) % 500 AS INTEGER) AS x0, CAST((p_partkey * 91) % 700 AS INTEGER) AS y0, p_size FROM part), a AS (SELECT img, id, x0, y0, x0 + p_size + 1 AS x1, y0 + p_size % 17 + 3 AS y1 FROM bx), b AS (SELECT img, id, (x0 * 3) % 480 AS x0, (y0 * 7) % 690 AS y0, (x0 * 3) % 480 + 20 AS x1, (y0 * 7) % 690 + 12 AS y1 FROM bx) "
#: All boxes on eight images, which grow with the table.
ALL_BOX = BOX.replace("p_partkey // 50 AS img", "p_partkey % 8 AS img")
LINES = "WITH t AS (SELECT item_id, regexp_replace(text, '[^\\x20-\\x7F]', '', 'g') AS truth FROM benchmark), l AS (SELECT item_id, truth, replace(replace(truth, 'th', 'tn'), 'er', 'e') AS predicted FROM t) "
ARCS = "WITH RECURSIVE arcs AS (SELECT l_suppkey % 20 AS fst, l_linenumber - 1 AS src, l_linenumber AS dst, CAST(97 + l_partkey % 26 AS INTEGER) AS lab, l_quantity AS cost FROM lineitem UNION ALL SELECT l_suppkey % 20, l_linenumber - 1, l_linenumber + 1, 0, l_quantity + 3 FROM lineitem WHERE l_linenumber < 7), best AS (SELECT fst, src, dst, min(cost) AS cost FROM arcs GROUP BY fst, src, dst) "
KNN = "WITH v AS (SELECT vec_id AS id, label AS cls, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 100)) AS a FROM embeddings), d AS (SELECT q.id, r.id AS other, q.cls AS own, r.cls AS cls, list_inner_product(q.a, q.a) + list_inner_product(r.a, r.a) - 2 * list_inner_product(q.a, r.a) AS distance FROM v q JOIN v r ON q.id <> r.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) "


def hist(s, d, by=("l_returnflag",)): return S.histogram(table(s, d, "lineitem"), F.col("l_quantity"), list(by))


def boxes(s, d, img="p_partkey div 50"):
    k = F.col("p_partkey")
    p = table(s, d, "part").select(F.expr(img).alias("img"), k.alias("id"), ((k * 37) % 500).cast("int").alias("x0"), ((k * 91) % 700).cast("int").alias("y0"), "p_size")
    a = p.select("img", "id", "x0", "y0", (F.col("x0") + F.col("p_size") + 1).alias("x1"), (F.col("y0") + F.col("p_size") % 17 + 3).alias("y1"))
    x, y = (F.col("x0") * 3) % 480, (F.col("y0") * 7) % 690
    return a, p.select("img", "id", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 12).alias("y1"))


def all_boxes(s, d): return boxes(s, d, "p_partkey % 8")


def lines(s, d):
    """Whole texts of printable ASCII characters, and the same with two systematic errors."""
    t = table(s, d, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x20-\x7F]", "").alias("truth"))
    return t.withColumn("predicted", F.replace(F.replace("truth", F.lit("th"), F.lit("tn")), F.lit("er"), F.lit("e")))


def arcs(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    n, lab = F.col("l_linenumber"), (97 + F.col("l_partkey") % 26).cast("int")
    plain = l.select((F.col("l_suppkey") % 20).alias("fst"), (n - 1).alias("src"), n.alias("dst"), lab.alias("inp"), lab.alias("out"), F.col("l_quantity").alias("cost"))
    skip = l.where("l_linenumber < 7").select((F.col("l_suppkey") % 20).alias("fst"), (n - 1).alias("src"), (n + 1).alias("dst"), F.lit(0).alias("inp"), F.lit(0).alias("out"), (F.col("l_quantity") + 3).alias("cost"))
    return plain.unionByName(skip)


def nodes(a): return a.select("fst", F.col("src").alias("id")).union(a.select("fst", "dst")).distinct().withColumn("accept", F.when(F.col("id") == 7, 0.0))
def points(s, d): return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), A.quantize(F.col("embedding")).cast("array<double>").alias("features"))


def user_runs(s, d):
    """Runs of equal event types of a user: gaps and islands in the order of time."""
    e = table(s, d, "events")
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    g = e.withColumn("g", F.row_number().over(w) - F.row_number().over(v))
    return g.groupBy("user_id", "event_type", "g").agg(F.count(F.lit(1)).alias("length")).groupBy("event_type", "length").agg(F.count(F.lit(1)).alias("n"))


def sliding(s, d):
    """Sliding extremes, mean and median of a user's values over five events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    v = F.col("value")
    return table(s, d, "events").select("event_id", F.min(v).over(w).alias("lo"), F.max(v).over(w).alias("hi"), F.round(F.avg(v).over(w), 6).alias("mean"))


def lms_lines(s, d):
    """Lines of least median squares of the account balances of each nation's customers by their key."""
    points = table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y"))
    return L.fit_lines(points, ["c_nationkey"]).select("c_nationkey", *(F.round(c, 4).alias(c) for c in ("m", "c", "error")))


LMS_LINES = f"""WITH p AS (SELECT c_nationkey AS g, c_custkey AS id, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y, t FROM customer, generate_series(0, {L.TRIALS - 1}) AS s(t)),
    a AS (SELECT g, t, arg_min(struct_pack(id := id, x := x, y := y), md5('first:' || t || ':' || id)) AS a FROM p GROUP BY ALL),
    b AS (SELECT p.g, p.t, arg_min(struct_pack(id := id, x := x, y := y), md5('second:' || p.t || ':' || id)) AS b FROM p JOIN a ON p.g = a.g AND p.t = a.t WHERE p.id <> a.a.id GROUP BY ALL),
    l AS (SELECT g, t, a, CASE WHEN a.x <> b.x THEN (b.y - a.y) / (b.x - a.x) ELSE 0 END AS m, b FROM a LEFT JOIN b USING (g, t)),
    c AS (SELECT g, t, m, CASE WHEN a.x <> b.x THEN a.y - m * a.x ELSE coalesce((a.y + b.y) / 2, a.y) END AS c FROM l),
    e AS (SELECT p.g, p.t, m, c, pow(y - m * x - c, 2) AS e, row_number() OVER (PARTITION BY p.g, p.t ORDER BY pow(y - m * x - c, 2)) - 1 AS k, count(*) OVER (PARTITION BY p.g, p.t) AS n FROM p JOIN c ON p.g = c.g AND p.t = c.t)
    SELECT g AS c_nationkey, round(arg_min(m, e), 4) AS m, round(arg_min(c, e), 4) AS c, round(min(e), 4) AS error FROM e WHERE k = n // 2 GROUP BY g"""


def labels_confusion(s, d): return S.confusion(table(s, d, "labels"), "quality", "toxic")
def posteriors(s, d): return N.knn_posterior(N.nearest(points(s, d), points(s, d), 5))


def gaussian(s, d):
    p = points(s, d)
    costs = N.gaussian_costs(p, N.gaussian_fit(p))
    return costs.groupBy("id").agg(F.min(F.struct(F.round("cost", 4).alias("cost"), "cls")).alias("m")).select("id", F.col("m.cls").alias("cls"))


def composed(s, d):
    """Two lattices composed on their labels: arcs for each pair of source states."""
    a = W.best_arcs_only(arcs(s, d))
    c = W.compose(a, a, nodes(a), nodes(a))
    return c.groupBy("fst", F.col("src.l").alias("l"), F.col("src.r").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("least"))


def composed_text(s, d):
    """Orders as lattices of letters (two readings and a skip for each line), read under a letter model of their customers' nation."""
    l = table(s, d, "lineitem")  # noqa: E741
    n, k, price = F.col("l_linenumber"), F.col("l_orderkey").alias("fst"), F.col("l_extendedprice")
    arc = lambda src, dst, inp, out, cost: F.struct(src.cast("long").alias("src"), dst.cast("long").alias("dst"), inp.cast("int").alias("inp"), out.cast("int").alias("out"), cost.alias("cost"))
    read = lambda letter, cost: arc(n - 1, n, letter, letter, cost)
    letter = lambda key: 97 + F.col(key) % 6
    # Arcs of a row stay in it, as one row is moved more cheaply than a row for each arc.
    lattice = l.select(k, F.array(read(letter("l_partkey"), price), read(letter("l_suppkey"), price * 1.25), read(F.lit(0), price * 3 + 1)).alias("arcs"))
    ends = l.groupBy(k).agg(F.max("l_linenumber").alias("n"))
    lattice_nodes = ends.select("fst", F.explode(F.sequence(F.lit(0), "n")).alias("id"), "n").select("fst", "id", F.when(F.col("id") == F.col("n"), 0.0).alias("accept"))
    # Two states: after a vowel and after a consonant; vowels after vowels cost more, and each order adds its own price.
    moves = [(src, letter, letter in (97, 101)) for src in (0, 1) for letter in range(97, 103)]
    rule = lambda src, letter, vowel: arc(*map(F.lit, (src, int(vowel), letter, letter - 32 * vowel)), F.lit(3.0 if src and vowel else 1.0) * F.col("_p") / 100)
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("fst"), F.col("o_totalprice").alias("_p"))
    model = orders.select("fst", F.array(*(rule(*m) for m in moves)).alias("arcs"))
    model_nodes = orders.select("fst", F.explode(F.array(F.lit(0), F.lit(1))).alias("id"), F.lit(0.0).alias("accept"))
    return Z.texts((lattice, lattice_nodes), (model, model_nodes)).select("fst", F.round("cost", 4).alias("cost"), "text")


COMPOSED = """WITH RECURSIVE a AS (SELECT l_orderkey AS fst, l_linenumber AS dst, 97 + l_partkey % 6 AS lab, l_extendedprice AS cost FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 97 + l_suppkey % 6, l_extendedprice * 1.25 FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 0, l_extendedprice * 3 + 1 FROM lineitem),
    p(fst, pos, vowel, cost, text) AS (SELECT DISTINCT l_orderkey, 0, false, CAST(0 AS DOUBLE), '' FROM lineitem
    UNION ALL SELECT p.fst, a.dst, CASE WHEN lab = 0 THEN vowel ELSE lab IN (97, 101) END, p.cost + a.cost + CASE WHEN lab = 0 THEN 0 WHEN vowel AND lab IN (97, 101) THEN 3 * o_totalprice / 100 ELSE o_totalprice / 100 END,
        text || CASE WHEN lab = 0 THEN '' WHEN lab IN (97, 101) THEN chr(CAST(lab - 32 AS INTEGER)) ELSE chr(CAST(lab AS INTEGER)) END
        FROM p JOIN a ON a.fst = p.fst AND a.dst = p.pos + 1 JOIN orders o ON o.o_orderkey = p.fst),
    n AS (SELECT l_orderkey AS fst, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT p.fst, round(min(cost), 4) AS cost, arg_min(text, cost) AS text FROM p JOIN n ON n.fst = p.fst AND p.pos = n.n GROUP BY p.fst"""


def text_lines(s, d):
    arcs_, nodes_ = W.line(lines(s, d), "item_id", "truth")
    return W.best_paths(arcs_, nodes_).select("fst", "cost", F.md5(W.to_text(F.col("labels"))).alias("text_md5"))


def png_round_trip(s, d):
    """Pixels encoded as PNG files and decoded again."""
    from quillspark.plans.image_queries import pixels

    files = formats.images(pixels(s, d)).select(F.col("img").cast("string").alias("path"), "content")
    return formats.pixels(files).select(F.col("path").cast("long").alias("img"), "x", "y", "v").where("v <> 0")


def hocr(s, d):
    from quillspark.plans.image_queries import run_table

    r = run_table(s, d)
    l = r.groupBy(F.col("img").alias("page"), "line").agg(F.min("start").alias("x0"), F.max("end").alias("x1"), F.count(F.lit(1)).cast("int").alias("n"))  # noqa: E741
    text = F.array_join(F.array_repeat(F.lit("x"), F.col("n")), " ")  # one letter for each run
    return formats.hocr_page(l.select("page", "line", formats.hocr_line(F.col("line"), text, F.col("x0"), F.col("line"), F.col("x1"), F.col("line") + 1, F.lit(100)).alias("html")))


def streamed(s, d):
    return frames.drain(frames.windowed_counts(frames.read_frames(s, f"{d}/events.parquet*"), "ts", "event_type", "1 day", "1 day"))


_CLEAN = "regexp_replace(text, '[^\\x20-\\x7F]', '', 'g')"

QUERIES = {
    "stats_histogram": Query(hist, H + "SELECT * FROM h"),
    "stats_histogram_clipped": Query(lambda s, d: S.histogram(table(s, d, "lineitem"), F.col("l_quantity"), ["l_returnflag"], (10, 40)), "SELECT l_returnflag, CAST(least(greatest(l_quantity, 10), 40) AS INTEGER) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "stats_mode": Query(lambda s, d: S.mode(hist(s, d), ["l_returnflag"]), H + "SELECT l_returnflag, CAST(arg_max(bucket, n * 1000 + bucket) AS INTEGER) AS mode FROM h GROUP BY 1"),
    "stats_moments": Query(lambda s, d: S.moments(hist(s, d), ["l_returnflag"]).select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")), "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1"),
    "stats_percentile": Query(lambda s, d: S.percentile(hist(s, d), 0.25, ["l_returnflag"]).withColumn("percentile", F.round("percentile", 6)), C + "SELECT l_returnflag, round(min(bucket) + (arg_min(total, bucket) * 0.25::DOUBLE - (arg_min(upto, bucket) - arg_min(n, bucket))) / arg_min(n, bucket), 6) AS percentile FROM c WHERE upto >= total * 0.25 GROUP BY 1"),
    "stats_half_mass": Query(lambda s, d: S.half_mass(hist(s, d), ["l_returnflag"]), C + "SELECT l_returnflag, min(bucket) + 1 AS half_mass FROM c WHERE 2 * upto >= total GROUP BY 1"),
    "stats_smooth": Query(lambda s, d: S.smooth(hist(s, d), 3, ["l_returnflag"]), H + "SELECT l_returnflag, CAST(bucket + k AS INTEGER) AS bucket, CAST(sum(n * (3 - abs(k))) AS BIGINT) AS n FROM h, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) GROUP BY 1, 2"),
    "lms_lines": Query(lms_lines, LMS_LINES),
    "stats_fractile": Query(lambda s, d: S.fractile(table(s, d, "lineitem"), "l_extendedprice", 0.9, ["l_returnflag"]), "SELECT l_returnflag, max(CASE WHEN k = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) THEN l_extendedprice END) AS fractile FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1"),
    "stats_line_fit": Query(lambda s, d: S.least_squares_line(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept")), "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1"),
    "stats_top_n": Query(lambda s, d: S.top_n(table(s, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.sum("l_quantity").alias("q")), 10, "q", "l_orderkey", ["l_returnflag"]), "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_orderkey) AS INTEGER) AS rank FROM (SELECT l_returnflag, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10"),
    "stats_segmentation_counts": Query(lambda s, d: S.segmentation_counts(table(s, d, "lineitem").selectExpr("l_suppkey a", "cast(l_partkey % 50 as int) b"), "a", "b"), "WITH c AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem WHERE l_suppkey <> 0 AND l_partkey % 50 <> 0) SELECT count(*) - count(DISTINCT a) AS over, count(*) - count(DISTINCT b) AS under, count(*) AS cells FROM c"),
    "stats_confusion": Query(labels_confusion, "SELECT quality AS pred, toxic AS true, count(*) AS n FROM labels WHERE quality >= 0 AND toxic >= 0 GROUP BY 1, 2"),
    "stats_confusion_error": Query(lambda s, d: S.confusion_error(labels_confusion(s, d)), "SELECT CAST(sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(*) AS total, round(sum(CASE WHEN quality <> toxic THEN 1 ELSE 0 END) / count(*), 9) AS error FROM labels WHERE quality >= 0 AND toxic >= 0"),
    "stats_confusions": Query(lambda s, d: S.confusions(labels_confusion(s, d)), "SELECT quality AS pred, toxic AS true, count(*) AS n FROM labels WHERE quality >= 0 AND toxic >= 0 AND quality <> toxic GROUP BY 1, 2"),
    "stats_class_counts": Query(lambda s, d: table(s, d, "embeddings").where("label >= 0").agg(F.countDistinct("label").alias("classes"), F.count(F.lit(1)).alias("samples")), "SELECT count(DISTINCT label) AS classes, count(*) AS samples FROM embeddings WHERE label >= 0"),
    "stats_entropy": Query(lambda s, d: table(s, d, "events").groupBy("event_type").count().withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy())).agg(F.round(F.sum(-F.col("p") * F.log("p")), 6).alias("entropy"), F.round(F.exp(F.sum(-F.col("p") * F.log("p"))), 6).alias("perplexity")), "WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) SELECT round(sum(-p * ln(p)), 6) AS entropy, round(exp(sum(-p * ln(p))), 6) AS perplexity FROM p"),
    "relabel_palette": Query(lambda s, d: table(s, d, "part").select("p_partkey", R.recolor(F.col("p_partkey"), (10, 20, 30, 40, 50)).alias("color")), "SELECT p_partkey, CAST([10, 20, 30, 40, 50][p_partkey % 5 + 1] AS INTEGER) AS color FROM part"),
    "feature_augment": Query(lambda s, d: table(s, d, "embeddings").select("vec_id", A.total(R.augment(A.quantize(F.col("embedding")), F.array(F.col("label")))).alias("total")), "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INTEGER))) + label AS total FROM embeddings"),
    "stats_group_median": Query(lambda s, d: R.group_median(table(s, d, "part"), "p_size", ["p_brand"]), "SELECT p_brand, CAST(median(p_size) AS DOUBLE) AS median FROM part GROUP BY 1"),
    "stats_accuracy_by_size": Query(lambda s, d: R.accuracy_by_size(table(s, d, "lineitem"), F.col("l_returnflag") == "N", F.col("l_quantity"), 10), "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS \"right\" FROM lineitem GROUP BY 1"),
    "relabel_dense": Query(lambda s, d: S.dense_relabel(table(s, d, "part").select("p_partkey", (F.col("p_size") % 7 * 11).alias("label")), "label").select("p_partkey", "dense"), "SELECT p_partkey, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size % 7 END AS INTEGER) AS dense FROM part"),
    "label_packing": Query(lambda s, d: table(s, d, "part").select("p_partkey", I.pack_label(F.col("p_size") % 31 + 1, F.col("p_size") % 200, F.col("p_size") % 250).alias("packed")), "SELECT p_partkey, CAST(((p_size % 31 + 1) << 16) | ((p_size % 200) << 8) | (p_size % 250) AS INTEGER) AS packed FROM part"),
    "box_overlap_join": Query(lambda s, d: B.overlap_join(*all_boxes(s, d)).select("img", "a_id", "b_id", F.col("shared").cast("long").alias("shared")), ALL_BOX + "SELECT a.img, a.id AS a_id, b.id AS b_id, CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS BIGINT) AS shared FROM a JOIN b ON a.img = b.img AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"),
    "box_best_overlap": Query(lambda s, d: B.best_overlap(*all_boxes(s, d)).withColumn("shared", F.col("shared").cast("long")), ALL_BOX + ", m AS (SELECT a.img, a.id AS a_id, b.id AS b_id, CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS BIGINT) AS shared FROM a JOIN b ON a.img = b.img AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT img, a_id, b_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY img, a_id ORDER BY shared DESC, b_id) AS k FROM m) WHERE k = 1"),
    "box_overlap_counts": Query(lambda s, d: B.overlap_counts(*all_boxes(s, d)), ALL_BOX + "SELECT a.img, a.id AS a_id, count(b.id) AS n FROM a LEFT JOIN b ON a.img = b.img AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY 1, 2"),
    "box_nearest_right": Query(lambda s, d: B.nearest_right(all_boxes(s, d)[0]), ALL_BOX + "SELECT img, id, gap, other FROM (SELECT a.img, a.id, o.x0 - a.x1 AS gap, o.id AS other, row_number() OVER (PARTITION BY a.img, a.id ORDER BY o.x0 - a.x1, o.id) AS k FROM a JOIN a o ON a.img = o.img AND o.x0 >= a.x1 AND o.y0 < a.y1 AND a.y0 < o.y1) WHERE k = 1"),
    "box_kinds": Query(lambda s, d: B.classify_boxes(boxes(s, d)[0], 30, 15, 3.0).select("id", "kind"), BOX + "SELECT id, CASE WHEN x1 - x0 > 30 AND x1 - x0 > (y1 - y0) * 3.0 THEN 'horizontal' WHEN y1 - y0 > 15 AND y1 - y0 > (x1 - x0) * 3.0 THEN 'vertical' WHEN x1 - x0 >= 30 OR y1 - y0 >= 15 THEN 'graphic' ELSE 'text' END AS kind FROM a"),
    "box_sort": Query(lambda s, d: boxes(s, d)[0].select("img", "id", F.row_number().over(Window.partitionBy("img").orderBy("x0", "id")).alias("place")), BOX + "SELECT img, id, CAST(row_number() OVER (PARTITION BY img ORDER BY x0, id) AS INTEGER) AS place FROM a"),
    "box_segment_groups": Query(lambda s, d: B.group_segments(all_boxes(s, d)[0].selectExpr("img", "cast(y0 div 100 as int) line", "x0", "x0 + 5 as x1"), 3, 12), ALL_BOX + ", s AS (SELECT img, CAST(y0 // 100 AS INTEGER) AS line, x0, x0 + 5 AS x1 FROM a), n AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS k, lag(x1) OVER w AS before FROM s WINDOW w AS (PARTITION BY img, line ORDER BY x0, x1)), c AS (SELECT *, sum(CASE WHEN x0 - before <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY img, line ORDER BY k) AS chain FROM n) SELECT f.img, f.line, f.k AS first, t.k AS last, f.x0, t.x1 FROM c f JOIN c t ON f.img = t.img AND f.line = t.line AND f.chain = t.chain AND t.k >= f.k AND t.k < f.k + 3"),
    "box_suppression": Query(lambda s, d: B.suppress_overlaps(boxes(s, d)[0]).select("img", "id")),
    "event_runs": Query(user_runs, "WITH g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events), r AS (SELECT event_type, count(*) AS length FROM g GROUP BY user_id, event_type, g) SELECT event_type, length, count(*) AS n FROM r GROUP BY 1, 2"),
    "event_sliding": Query(sliding, "SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "event_stream_windows": Query(streamed, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMPTZ) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"),
    "text_evaluate": Query(lambda s, d: S.evaluate_lines(lines(s, d), "truth", "predicted"), LINES + "SELECT CAST(sum(levenshtein(truth, predicted)) AS BIGINT) AS errors, CAST(sum(length(truth)) AS BIGINT) AS total, round(sum(levenshtein(truth, predicted)) / sum(length(truth)), 9) AS rate FROM l"),
    "text_edit_distance": Query(lambda s, d: lines(s, d).select("item_id", T.edit_distance(F.col("truth"), F.col("predicted")).cast("long").alias("distance")), LINES + "SELECT item_id, levenshtein(truth, predicted) AS distance FROM l"),
    "text_confusions": Query(lambda s, d: T.confusions(lines(s, d), "truth", "predicted")),
    "text_find_confusion": Query(lambda s, d: lines(s, d).where(F.contains("truth", F.lit("th")) & F.contains("predicted", F.lit("tn"))).select("item_id"), LINES + "SELECT item_id FROM l WHERE contains(truth, 'th') AND contains(predicted, 'tn')"),
    "text_block_moves": Query(lambda s, d: T.block_move_cost(lines(s, d), "truth", "predicted").select("item_id", "cost")),
    "text_cleanup": Query(lambda s, d: table(s, d, "benchmark").select("item_id", T.clean_for_evaluation(F.col("text")).alias("ascii"), T.clean_for_evaluation(F.col("text"), spaces=False, fold=True).alias("folded"), T.clean_for_evaluation(F.col("text"), alpha_only=True).alias("alpha"), T.clean_for_evaluation(F.col("text"), alnum_only=True).alias("alnum")), f"SELECT item_id, {_CLEAN} AS ascii, lower(replace({_CLEAN}, ' ', '')) AS folded, regexp_replace(text, '[^A-Za-z]', '', 'g') AS alpha, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS alnum FROM benchmark"),
    "text_split": Query(lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(T.split_string(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n]'), lambda x: x <> '')) AS word FROM benchmark) GROUP BY 1"),
    "text_code_points": Query(lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(T.code_points(F.col("text"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "SELECT c, count(*) AS n FROM (SELECT unicode(unnest(string_split(text, ''))) AS c FROM benchmark) GROUP BY 1"),
    "text_unescape": Query(lambda s, d: table(s, d, "pages").select("page_id", F.md5(T.unescape(F.col("html"))).alias("digest")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS digest FROM pages"),
    "text_extensions": Query(lambda s, d: table(s, d, "pages").select("page_id", T.chomp_extension(F.col("url")).alias("stem"), formats.by_extension(F.col("url")).alias("ext")), "SELECT page_id, regexp_replace(url, '\\.[^/]*$', '') AS stem, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS ext FROM pages"),
    "text_word_checks": Query(lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(T.split_string(F.col("text"))).alias("w")).groupBy("item_id").agg(F.sum(T.acceptable_word(F.col("w")).cast("long")).alias("words"), F.sum(T.acceptable_number(F.col("w")).cast("long")).alias("numbers"), F.sum(T.case_ok(F.col("w")).cast("long")).alias("case_ok"), F.sum(T.one_ell(F.col("w")).cast("long")).alias("ell")), "WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n]'), lambda x: x <> '')) AS w FROM benchmark) SELECT item_id, CAST(sum(CASE WHEN regexp_matches(w, '^[(''\"]?(?:[a-z]+|[A-Z][a-z]*|[A-Z]+)(?:[-''][A-Za-z]+)?[.,:;!?)''\"]{0,2}$') THEN 1 ELSE 0 END) AS BIGINT) AS words, CAST(sum(CASE WHEN regexp_matches(w, '^[($]?[0-9]+(?:[.,][0-9]+)*[%)]?[.,;:]?$') THEN 1 ELSE 0 END) AS BIGINT) AS numbers, CAST(sum(CASE WHEN regexp_matches(w, '^[^A-Za-z]*(?:[a-z]+|[A-Z][a-z]*|[A-Z]+)[^A-Za-z]*$') THEN 1 ELSE 0 END) AS BIGINT) AS case_ok, CAST(sum(CASE WHEN regexp_matches(w, '[1Il]') THEN 1 ELSE 0 END) AS BIGINT) AS ell FROM w GROUP BY 1"),
    "text_repairs": Query(lambda s, d: table(s, d, "customer").select("c_custkey", T.fix_hyphens(T.fix_quotes(F.concat(F.col("c_name"), F.lit("''--~")))).alias("fixed"), T.flip_zero(F.concat(F.lit("1o2"), F.col("c_name"))).alias("flipped")), "SELECT c_custkey, regexp_replace(regexp_replace(c_name || '''''--~', '[''`]{2}', '\"', 'g'), '[-~]{2}', '-', 'g') AS fixed, regexp_replace('102' || c_name, '([A-Za-z])0([A-Za-z])', '\\1O\\2', 'g') AS flipped FROM customer"),
    "text_dictionary": Query(lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(T.split_string(F.lower("text")))).alias("word")).join(table(s, d, "benchmark").select(F.explode(T.split_string(F.lower("text"))).alias("word")).distinct(), "word", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("known")), "WITH b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\t\\n]')) AS word FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n]')) AS word FROM documents) SELECT doc_id, count(*) AS known FROM d WHERE word <> '' AND word IN (SELECT word FROM b) GROUP BY 1"),
    "fst_best_arcs": Query(lambda s, d: W.best_arcs_only(arcs(s, d)).select("fst", "src", "dst", "cost"), ARCS.replace("WITH RECURSIVE", "WITH") + "SELECT * FROM best"),
    "fst_best_paths": Query(lambda s, d: (lambda a: W.best_paths(W.best_arcs_only(a), nodes(a)).select("fst", "cost"))(arcs(s, d)), ARCS + ", p(fst, id, cost) AS (SELECT DISTINCT fst, 0, CAST(0 AS DOUBLE) FROM best UNION SELECT p.fst, b.dst, p.cost + b.cost FROM p JOIN best b ON b.fst = p.fst AND b.src = p.id) SELECT fst, min(cost) AS cost FROM p WHERE id = 7 GROUP BY fst"),
    "fst_cost_to_accept": Query(lambda s, d: (lambda a: Z.cost_to_accept(W.best_arcs_only(a), nodes(a)).select("fst", "id", "h"))(arcs(s, d)), ARCS + ", p(fst, id, cost) AS (SELECT DISTINCT fst, 7, CAST(0 AS DOUBLE) FROM best UNION SELECT p.fst, b.src, p.cost + b.cost FROM p JOIN best b ON b.fst = p.fst AND b.dst = p.id) SELECT fst, CAST(id AS BIGINT) AS id, min(cost) AS h FROM p GROUP BY ALL"),
    "source_automaton_files": Query(lambda s, d: (lambda a: Q.read_automata(Q.write_automata(a, nodes(a)))[0].select(F.col("fst").cast("long").alias("fst"), "src", "dst", "cost"))(W.best_arcs_only(arcs(s, d))), ARCS.replace("WITH RECURSIVE", "WITH") + "SELECT fst, src, dst, cost FROM best"),
    "fst_composed_text": Query(composed_text, COMPOSED),
    "fst_beam_paths": Query(lambda s, d: (lambda a: W.best_paths(W.best_arcs_only(a), nodes(a), beam=3).select("fst", "cost"))(arcs(s, d))),
    "fst_reverse": Query(lambda s, d: (lambda a: W.reverse(W.best_arcs_only(a), nodes(a))[0].select("fst", "src", "dst", "cost"))(arcs(s, d)), ARCS.replace("WITH RECURSIVE", "WITH") + "SELECT fst, dst AS src, src AS dst, cost FROM best UNION ALL SELECT DISTINCT fst, -1, 7, CAST(0 AS DOUBLE) FROM arcs WHERE dst = 7"),
    "fst_closure": Query(lambda s, d: (lambda a: W.closure(W.best_arcs_only(a), nodes(a)).groupBy("fst").agg(F.count(F.lit(1)).alias("n")))(arcs(s, d)), ARCS.replace("WITH RECURSIVE", "WITH") + "SELECT fst, count(*) + max(CASE WHEN dst = 7 THEN 1 ELSE 0 END) AS n FROM best GROUP BY fst"),
    "fst_compose": Query(composed, ARCS.replace("WITH RECURSIVE", "WITH") + ", b AS (SELECT fst, src, dst, cost, lab FROM (SELECT *, row_number() OVER (PARTITION BY fst, src, dst ORDER BY cost, lab) AS k FROM arcs) WHERE k = 1), n AS (SELECT fst, src AS id FROM b UNION SELECT fst, dst FROM b), c AS (SELECT x.fst, x.src AS l, y.src AS r, x.cost + y.cost AS cost FROM b x JOIN b y ON x.fst = y.fst AND x.lab = y.lab WHERE x.lab <> 0 UNION ALL SELECT b.fst, src, id, cost FROM b JOIN n ON b.fst = n.fst WHERE lab = 0 UNION ALL SELECT b.fst, id, src, cost FROM b JOIN n ON b.fst = n.fst WHERE lab = 0) SELECT fst, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, count(*) AS n, min(cost) AS least FROM c GROUP BY 1, 2, 3"),
    "fst_text_lines": Query(text_lines, LINES + "SELECT item_id AS fst, CAST(0 AS DOUBLE) AS cost, md5(truth) AS text_md5 FROM l"),
    "knn_neighbours": Query(lambda s, d: N.nearest(points(s, d), points(s, d), 3).select("id", "rank", "other", "distance"), KNN + "SELECT id, CAST(rank AS INTEGER) AS rank, other, distance FROM k WHERE rank <= 3"),
    "knn_posterior": Query(posteriors, KNN + "SELECT id, cls, count(*) / 5 AS share FROM k WHERE rank <= 5 GROUP BY 1, 2"),
    "knn_classify": Query(lambda s, d: N.knn_classify(posteriors(s, d)), KNN + ", s AS (SELECT id, cls, count(*) AS n FROM k WHERE rank <= 5 GROUP BY 1, 2) SELECT id, CAST(arg_max(cls, n * 1000 - cls) AS INTEGER) AS cls FROM s GROUP BY 1"),
    "knn_leave_one_out": Query(lambda s, d: N.leave_one_out_error(points(s, d)), KNN + "SELECT CAST(sum(CASE WHEN own <> cls THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(*) AS total FROM k WHERE rank = 1"),
    "gaussian_classify": Query(gaussian, "WITH v AS (SELECT vec_id AS id, label AS cls, unnest(generate_series(1, len(embedding))) AS k, embedding FROM embeddings), l AS (SELECT id, cls, k, round(CAST(embedding[k] AS DOUBLE) * 100) AS x FROM v), m AS (SELECT cls, k, avg(x) AS mean, var_pop(x) AS var FROM l GROUP BY 1, 2), n AS (SELECT *, avg(var) OVER (PARTITION BY cls) AS every FROM m), p AS (SELECT cls, k, mean, CASE WHEN var >= 1e-6 THEN var WHEN every >= 1e-6 THEN every ELSE 1 END AS var FROM n), c AS (SELECT id, p.cls, round(sum((x - mean) * (x - mean) / var), 4) AS cost FROM l JOIN p ON l.k = p.k GROUP BY 1, 2) SELECT id, cls FROM (SELECT id, cls, row_number() OVER (PARTITION BY id ORDER BY cost, cls) AS r FROM c) WHERE r = 1"),
    "perceptron_classify": Query(lambda s, d: N.predict(points(s, d), N.Perceptron().fit(*N.sample(points(s, d), 2000)))),
    "boosting_classify": Query(lambda s, d: N.predict(points(s, d), N.Boosting(2, epochs=10).fit(*N.sample(points(s, d), 1000)))),
    "cluster_gaps": Query(lambda s, d: N.agglomerate(table(s, d, "part").select("p_brand", F.col("p_retailprice").alias("value")), 5.0, "p_brand").groupBy("p_brand").agg(F.max("cluster").alias("clusters")), "WITH g AS (SELECT p_brand, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) <= 5 THEN 0 ELSE 1 END AS s FROM part) SELECT p_brand, CAST(sum(s) AS BIGINT) AS clusters FROM g GROUP BY 1"),
    "source_png_round_trip": Query(png_round_trip, "SELECT p_partkey // 2000 AS img, CAST(p_partkey % 40 AS INTEGER) AS x, CAST((p_partkey % 2000) // 40 AS INTEGER) AS y, CAST(p_size * 5 AS INTEGER) AS v FROM part WHERE p_size <> 0"),
    "source_array_text": Query(lambda s, d: table(s, d, "embeddings").select("vec_id", A.total(formats.text_to_array(formats.array_to_text(A.quantize(F.col("embedding"))))).alias("total")), "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INTEGER))) AS DOUBLE) AS total FROM embeddings"),
    "source_sniff": Query(lambda s, d: table(s, d, "region").select("r_regionkey", formats.sniff(F.element_at(F.array(*map(F.lit, ("P5", "P6", "\u0000", "II*\u0000", "P9"))), F.col("r_regionkey") + 1).cast("binary")).alias("kind")), "SELECT r_regionkey, ['pnm', 'pnm', NULL, 'tiff', NULL][r_regionkey + 1] AS kind FROM region"),
    "sink_hocr_pages": Query(hocr),
    "components_listing": Query(lambda s, d: components.listing(s)),
    "profile_widest_gap": Query(lambda s, d: P.widest_gap(table(s, d, "part").where("p_size > 40").select((F.col("p_partkey") % 5).alias("img"), F.expr("cast(p_partkey div 5 as int)").alias("at"), F.col("p_size").alias("n")), 60), "WITH p AS (SELECT p_partkey % 5 AS img, CAST(p_partkey // 5 AS INTEGER) AS k FROM part WHERE p_size > 40), g AS (SELECT img, coalesce(lag(k) OVER (PARTITION BY img ORDER BY k), -1) + 1 AS start, k AS \"end\" FROM p UNION ALL SELECT img, max(k) + 1, 60 FROM p GROUP BY img) SELECT img, start, \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY \"end\" - start DESC, start) AS k FROM g WHERE start < \"end\") WHERE k = 1"),
}
