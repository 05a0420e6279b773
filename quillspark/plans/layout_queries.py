"""Queries of kernels, geometry, layout, automata edits and small relational operators, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.operators import automata as W
from quillspark.operators import kernels as K
from quillspark.operators import layout as L
from quillspark.plans.image_queries import PX, black, pixels
from quillspark.plans.query import Query, table
from quillspark.plans.table_queries import ARCS, BOX, LINES, arcs, boxes, lines, nodes

_BEST = ARCS.replace("WITH RECURSIVE", "WITH")
_ROWS = BOX + ", t AS (SELECT img, CAST(y0 // 100 AS INTEGER) AS line, id, x0, x1, y0, y1 FROM a)"
_NEAR = "EXISTS (SELECT 1 FROM bw o WHERE o.img = p.img AND o.v <> 0 AND o.x = p.x + {dx} AND o.y = p.y + {dy})"
_POINTS = PX + ", n AS (SELECT a.img, a.x, a.y, a.v, sum(CASE WHEN b.v <> 0 THEN 1 ELSE 0 END) AS n FROM bw a LEFT JOIN bw b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY 1, 2, 3, 4) SELECT n.img, n.x, n.y, CASE WHEN n.v <> 0 AND n.x > x0 AND n.x < x1 - 2 AND n.y > y0 AND n.y < y1 - 2 AND {test} THEN 255 ELSE 0 END AS v FROM n JOIN e ON n.img = e.img AND n.x = e.x AND n.y = e.y"
_ANGLE = math.pi / 4
_INK, _PAPER = [(0, 0), (1, 0)], [(-1, 0), (0, 1)]


def line_boxes(s, d): return boxes(s, d)[0].withColumn("line", F.expr("cast(y0 div 100 as int)"))
def _words(s, d): return table(s, d, "benchmark").select("item_id", F.posexplode(T.split_string(F.col("text"))).alias("place", "word"))


def _vectors(s, d):
    n, lo, hi = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax") * 100
    a, b = G.vec(lo, n), G.vec(n, hi)
    named = table(s, d, "lineitem").select("l_orderkey", n, a.alias("a"), b.alias("b"))
    a, b = (_Struct(c, ("x", "y")) for c in "ab")
    p, q = G.complex_product(a, b), G.complex_quotient(a, b)
    out = {"dot": G.dot(a, b), "size": G.magnitude(a), "px": p.getField("x"), "py": p.getField("y"), "qx": q.getField("x"), "qy": q.getField("y"), "dx": G.vec_sub(a, b).getField("x")}
    return named.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(k) for k, c in out.items()))


class _Struct:
    """A struct column whose fields read as attributes."""

    def __init__(self, name: str, fields: tuple[str, ...]):
        for f in fields:
            setattr(self, f, F.col(f"{name}.{f}"))


def _intervals(s, d):
    k, q = F.col("l_linenumber"), F.col("l_quantity")
    named = table(s, d, "lineitem").select("l_orderkey", k, G.interval(k - 4, q).alias("a"), G.interval(-k, k).alias("b"))
    a, b = (_Struct(c, ("lo", "hi")) for c in "ab")
    made = {"sum": G.interval_add(a, b), "less": G.interval_sub(a, b), "times": G.interval_mul(a, b), "square": G.interval_square(a)}
    ends = [c.getField(e).alias(f"{n}_{e}") for n, c in made.items() for e in ("lo", "hi")]
    return named.select("l_orderkey", "l_linenumber", *ends, G.certainly_less(b, a).alias("certain"), G.possibly_less(b, a).alias("possible"))


def _rescored(s, d):
    best = W.best_arcs_only(arcs(s, d))
    return W.rescore(best, best.where("src = 2").withColumn("new", F.lit(0.5))).select("fst", "src", "dst", "cost")


def _segments(s, d):
    ids = table(s, d, "part").select((F.col("p_partkey") % 10).alias("fst"), F.col("p_partkey").alias("place"), ((F.col("p_partkey") % 100) * 65536 + F.col("p_partkey") % 100 + F.col("p_size") % 4).cast("long").alias("id"))
    return W.segments_of_arcs(ids)


def _enumerated(s, d):
    firsts = table(s, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return firsts.select("event_type", (F.row_number().over(Window.orderBy("first")) - 1).alias("number"))


def _subset(s, d):
    wanted = table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(s, d, "embeddings").join(wanted, "vec_id", "left_semi").select("vec_id", "label")


def _mapped(s, d):
    codes = table(s, d, "embeddings").select("label").where("label >= 0").distinct().withColumn("dense", F.dense_rank().over(Window.orderBy("label")) - 1)
    return table(s, d, "embeddings").join(F.broadcast(codes), "label", "left").select("vec_id", F.coalesce("dense", F.lit(-1)).alias("dense"))


def _put(s, d):
    p = pixels(s, d)
    return K.put_row(p, 3, K.row_slice(p, 5))


QUERIES = {
    "vector_algebra": Query(_vectors, "WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS ax, CAST(l_linenumber AS DOUBLE) AS ay, CAST(l_linenumber AS DOUBLE) AS bx, l_tax * 100 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(ax * bx + ay * b, 6) AS dot, round(sqrt(ax * ax + ay * ay), 6) AS size, round(ax * bx - ay * b, 6) AS px, round(ax * b + ay * bx, 6) AS py, round((ax * bx + ay * b) / (bx * bx + b * b), 6) AS qx, round((ay * bx - ax * b) / (bx * bx + b * b), 6) AS qy, round(ax - bx, 6) AS dx FROM a"),
    "interval_algebra": Query(_intervals, "WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber - 4 AS DOUBLE) AS a, l_quantity AS b, CAST(-l_linenumber AS DOUBLE) AS c, CAST(l_linenumber AS DOUBLE) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, a + c AS sum_lo, b + d AS sum_hi, a - d AS less_lo, b - c AS less_hi, least(a * c, a * d, b * c, b * d) AS times_lo, greatest(a * c, a * d, b * c, b * d) AS times_hi, CASE WHEN a <= 0 AND b >= 0 THEN 0 ELSE least(a * a, b * b) END AS square_lo, greatest(a * a, b * b) AS square_hi, d < a AS certain, c < b AS possible FROM i"),
    "image_resample": Query(lambda s, d: K.resample(black(s, d), 3), PX + "SELECT img, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS v FROM bw GROUP BY 1, 2, 3"),
    "image_reduce_and": Query(lambda s, d: K.reduce_and(black(s, d)), PX + "SELECT img, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CASE WHEN sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) = 4 THEN 255 ELSE 0 END AS v FROM bw GROUP BY 1, 2, 3"),
    "image_hit_or_miss": Query(lambda s, d: K.hit_or_miss(black(s, d), _INK, _PAPER), PX + "SELECT img, x, y, CASE WHEN " + " AND ".join([_NEAR.format(dx=a, dy=b) for a, b in _INK] + ["NOT " + _NEAR.format(dx=a, dy=b) for a, b in _PAPER]) + " THEN 255 ELSE 0 END AS v FROM bw p"),
    "image_erode_line": Query(lambda s, d: K.erode_line(pixels(s, d), 5, _ANGLE), PX + "SELECT a.img, a.x, a.y, min(b.v) AS v FROM px a JOIN px b ON a.img = b.img AND a.x - b.x = a.y - b.y AND abs(a.x - b.x) <= 1 GROUP BY a.img, a.x, a.y"),
    "image_blit_xor": Query(lambda s, d: K.blit(pixels(s, d), pixels(s, d), 2, 1, "xor"), PX + "SELECT a.img, a.x, a.y, CASE WHEN b.v IS NULL THEN a.v ELSE xor(a.v, b.v) END AS v FROM px a LEFT JOIN px b ON a.img = b.img AND a.x = b.x + 2 AND a.y = b.y + 1"),
    "image_count_rect": Query(lambda s, d: K.count_rect(black(s, d), 4, 2, 30, 20).withColumn("ratio", F.round("ratio", 9)), PX + "SELECT img, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS bits, bool_or(v <> 0) AS \"any\", round(avg(CASE WHEN v <> 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS ratio FROM bw WHERE x >= 4 AND x < 30 AND y >= 2 AND y < 20 GROUP BY img"),
    "image_row_slice": Query(lambda s, d: K.row_slice(pixels(s, d), 5), PX + "SELECT img, y AS at, v FROM px WHERE x = 5"),
    "image_column_slice": Query(lambda s, d: K.column_slice(pixels(s, d), 2), PX + "SELECT img, x AS at, v FROM px WHERE y = 2"),
    "image_put_row": Query(_put, PX + "SELECT a.img, a.x, a.y, coalesce(b.v, a.v) AS v FROM px a LEFT JOIN px b ON a.x = 3 AND b.x = 5 AND a.img = b.img AND a.y = b.y"),
    "image_endpoints": Query(lambda s, d: K.skeleton_points(black(s, d), lambda n: n == 1), _POINTS.format(test="n.n = 1")),
    "image_junctions": Query(lambda s, d: K.skeleton_points(black(s, d), lambda n: n > 2), _POINTS.format(test="n.n > 2")),
    "image_zero_crossings": Query(lambda s, d: K.zero_crossings(pixels(s, d).withColumn("v", F.col("v") - 125)), PX + ", s AS (SELECT img, x, y, sign(v - 125) AS s FROM px), z AS (SELECT a.img, a.x, a.y, bool_or(b.s <> a.s) AS z FROM s a LEFT JOIN s b ON a.img = b.img AND ((b.x = a.x + 1 AND b.y = a.y + 1) OR (b.x = a.x AND b.y = a.y + 1) OR (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x - 1 AND b.y = a.y + 1)) GROUP BY 1, 2, 3) SELECT z.img, z.x, z.y, CASE WHEN z AND z.x > x0 AND z.x < x1 - 1 AND z.y > y0 AND z.y < y1 - 1 THEN 1 ELSE 0 END AS v FROM z JOIN e ON z.img = e.img AND z.x = e.x AND z.y = e.y"),
    "line_precedence": Query(lambda s, d: L.precedence(boxes(s, d)[0]), BOX + ", l AS (SELECT * FROM a), p AS (SELECT a.img, a.id AS i, b.id AS j, a.x0 AS ax0, a.x1 AS ax1, a.y0 AS ay0, a.y1 AS ay1, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1 FROM l a JOIN l b ON a.img = b.img AND a.id < b.id), q AS (SELECT *, ax1 >= bx0 AND bx1 >= ax0 AS o FROM p), r AS (SELECT img, i, j, CASE WHEN o THEN ay1 > by1 ELSE ax1 <= bx0 END AS f FROM q WHERE o OR NOT EXISTS (SELECT 1 FROM l s WHERE s.img = q.img AND s.x1 >= ax0 AND ax1 >= s.x0 AND s.x1 >= bx0 AND bx1 >= s.x0 AND s.y0 > least(ay0, by0) AND s.y0 < greatest(ay0, by0))) SELECT img, CASE WHEN f THEN i ELSE j END AS \"first\", CASE WHEN f THEN j ELSE i END AS \"then\" FROM r"),
    "box_good_dimensions": Query(lambda s, d: L.good_dimensions(boxes(s, d)[0], (0.1, 20.0), 0.5, 8, 5).select("img", "id"), BOX + "SELECT img, id FROM a WHERE y1 > y0 AND (x1 - x0)::DOUBLE / (y1 - y0) BETWEEN 0.1 AND 20 AND abs(log2((x1 - x0)::DOUBLE / (y1 - y0))) >= 0.5 AND x1 - x0 >= 8 AND y1 - y0 >= 5"),
    "box_inside_page": Query(lambda s, d: L.inside_page(boxes(s, d)[0], 500, 700, 20).select("img", "id"), BOX + "SELECT img, id FROM a WHERE x1 - x0 < 500 AND y1 - y0 < 700 AND x0 >= 20 AND y0 >= 20 AND x1 <= 480 AND y1 <= 680"),
    "row_words": Query(lambda s, d: L.words_of_rows(line_boxes(s, d), 4), _ROWS + ", s AS (SELECT *, CASE WHEN b IS NULL OR x0 - b > 4 THEN 1 ELSE 0 END AS new FROM (SELECT *, max(x1) OVER (PARTITION BY img, line ORDER BY x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t)), w AS (SELECT *, CAST(sum(new) OVER (PARTITION BY img, line ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word FROM s) SELECT img, line, word, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM w GROUP BY 1, 2, 3"),
    "row_gaps": Query(lambda s, d: L.row_spacing(line_boxes(s, d)).withColumn("mean_gap", F.round("mean_gap", 6)), _ROWS + ", g AS (SELECT img, line, x0 - lag(x1) OVER (PARTITION BY img, line ORDER BY x0, id) AS gap FROM t) SELECT img, line, count(*) AS n, round(avg(gap), 6) AS mean_gap, min(gap) AS narrowest, max(gap) AS widest FROM g WHERE gap IS NOT NULL GROUP BY 1, 2"),
    "row_height_mode": Query(lambda s, d: L.row_height_mode(line_boxes(s, d)), _ROWS + ", h AS (SELECT img, line, y1 - y0 AS height, count(*) AS n, row_number() OVER (PARTITION BY img, line ORDER BY count(*) DESC, y1 - y0) AS k FROM t GROUP BY img, line, y1 - y0) SELECT img, line, height, n FROM h WHERE k = 1"),
    "line_paragraphs": Query(lambda s, d: L.paragraphs(boxes(s, d)[0], 60, 1.5), BOX + ", l AS (SELECT *, lag(id) OVER w AS b, lag(y0) OVER w AS y_before, lag(x0) OVER w AS x_before FROM a WINDOW w AS (PARTITION BY img ORDER BY y1 DESC, id)) SELECT img, id, CAST(sum(CASE WHEN b IS NULL OR y_before - y1 > 1.5 * (y1 - y0) OR x0 - x_before >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY img ORDER BY y1 DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM l"),
    "sink_box_lines": Query(lambda s, d: boxes(s, d)[0].select("id", L.box_line(F.lit("x"), "x0", "y0", "x1", "y1").alias("box")), BOX + "SELECT id, 'x ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y1 AS box FROM a"),
    "sink_page_text": Query(lambda s, d: L.page_text(_words(s, d), "item_id", ["place"], "word"), "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n]'), lambda x: x <> ''), ' ') AS text FROM benchmark"),
    "word_certainties": Query(lambda s, d: L.uniform_certainties(table(s, d, "lineitem").withColumn("c", -F.col("l_quantity")), "l_orderkey", "c", 1.5, -2.0), "WITH c AS (SELECT l_orderkey, count(*) AS n, min(-l_quantity) AS worst, sum(-l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1), m AS (SELECT *, n - 1 AS k, s - worst AS t, q - worst * worst AS r FROM c) SELECT l_orderkey, CASE WHEN n < 3 THEN true ELSE worst >= least(t / k - 1.5 * sqrt(greatest(0, (k * r - t * t) / nullif(k * (k - 1), 0))), -2) END AS uniform FROM m"),
    "fst_rescore": Query(_rescored, _BEST + "SELECT fst, src, dst, CASE WHEN src = 2 THEN 0.5 ELSE cost END AS cost FROM best"),
    "fst_optional_spaces": Query(lambda s, d: (lambda a: W.optional_spaces(a, nodes(a)).groupBy("fst").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops")))(W.best_arcs_only(arcs(s, d))), _BEST + ", l AS (SELECT fst, count(*) AS k FROM (SELECT fst, src FROM best UNION SELECT fst, dst FROM best) GROUP BY 1) SELECT b.fst, count(*) + any_value(l.k) AS n, sum(b.cost) AS cost, any_value(l.k) AS loops FROM best b JOIN l ON b.fst = l.fst GROUP BY b.fst"),
    "fst_word_tree": Query(lambda s, d: W.word_tree(_words(s, d), "word"), "WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n]'), lambda x: x <> '')) AS w FROM benchmark), s AS (SELECT w, unnest(generate_series(1, length(w))) AS k FROM w) SELECT substr(w, 1, k - 1) AS prefix, substr(w, k, 1) AS letter, bool_or(k = length(w)) AS ends FROM s GROUP BY 1, 2"),
    "fst_segments": Query(_segments, "SELECT p_partkey % 10 AS fst, unnest(generate_series(p_partkey % 100, p_partkey % 100 + p_size % 4)) AS segment, p_partkey AS place FROM part"),
    "rows_sorted": Query(lambda s, d: table(s, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_retailprice", "p_partkey")).alias("place")), "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS INTEGER) AS place FROM part"),
    "rows_compared": Query(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("case when struct(l_discount, l_tax) < struct(l_tax, l_discount) then -1 when struct(l_discount, l_tax) > struct(l_tax, l_discount) then 1 else 0 end").alias("order")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < l_tax OR (l_discount = l_tax AND l_tax < l_discount) THEN -1 WHEN l_discount > l_tax OR (l_discount = l_tax AND l_tax > l_discount) THEN 1 ELSE 0 END AS \"order\" FROM lineitem"),
    "rows_get_and_push": Query(lambda s, d: table(s, d, "embeddings").where("vec_id = 7").select("vec_id", "label").union(table(s, d, "embeddings").select("vec_id", "label")), "SELECT vec_id, label FROM embeddings WHERE vec_id = 7 UNION ALL SELECT vec_id, label FROM embeddings"),
    "rows_prefix_select": Query(lambda s, d: table(s, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 2").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 2"),
    "relabel_first_seen": Query(_enumerated, "SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS number FROM events GROUP BY event_type"),
    "dataset_subset": Query(_subset, "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "dataset_mapped": Query(_mapped, "WITH c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS dense FROM (SELECT DISTINCT label FROM embeddings WHERE label >= 0)) SELECT vec_id, CAST(coalesce(dense, -1) AS INTEGER) AS dense FROM embeddings LEFT JOIN c USING (label)"),
    "dataset_quantized": Query(lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x")).select("vec_id", "place", F.expr("cast(greatest(least(cast(x as double) * 100, 127d), -128d) as tinyint)").cast("int").alias("q")), "SELECT vec_id, CAST(k - 1 AS INTEGER) AS place, CAST(trunc(greatest(least(CAST(embedding[k] AS DOUBLE) * 100, 127), -128)) AS INTEGER) AS q FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings)"),
    "symbols_of_texts": Query(lambda s, d: lines(s, d).select(F.explode(F.split("truth", "")).alias("symbol")).where("symbol <> ''").distinct().select("symbol", F.col("symbol").rlike("^[A-Za-z]$").alias("letter"), F.col("symbol").rlike("^[0-9]$").alias("digit")), LINES + "SELECT DISTINCT symbol, regexp_matches(symbol, '^[A-Za-z]$') AS letter, regexp_matches(symbol, '^[0-9]$') AS digit FROM (SELECT unnest(string_split(truth, '')) AS symbol FROM t) WHERE symbol <> ''"),
}
