"""Given values and edge cases of the edge operators and the sample split."""

import pytest

from quillspark.operators import edges as G
from quillspark.operators import evaluation as E
from quillspark.operators import images as I
from quillspark.operators import nearest
from quillspark.operators import resample as M
from quillspark.plans import image_queries, table_queries


def image(spark, rows, img=0):
    return [(img, x, y, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)]


def pixel_table(spark, rows):
    return spark.createDataFrame(rows, "img int, x int, y int, v double")


def test_flood_goes_up_but_not_down_the_diagonal(spark):
    up = image(spark, [[9, 0], [0, 5]])
    down = image(spark, [[5, 0], [0, 9]], 1)
    got = {(r["img"], r["x"], r["y"]): r["v"] for r in G.hysteresis(pixel_table(spark, up + down), "v", 4, 8).collect()}
    assert got[0, 0, 0] == got[0, 1, 1] == 1.0 and got[1, 1, 1] == 1.0 and got[1, 0, 0] == 0.5 and got[0, 1, 0] == 0.0


def test_nonzero_fractile_edges(spark):
    rows = [(0, 0, 0, 7.0), (0, 1, 0, 0.0), (1, 0, 0, 3.0), (1, 1, 0, 3.0)] + [(2, k, 0, float(k)) for k in range(11)] + [(3, 0, 0, 0.0)]
    got = {r["img"]: r["fractile"] for r in G.nonzero_fractile(pixel_table(spark, rows), "v", 0.5, 9).collect()}
    # Ten values 1..10 in nine buckets of width 1: five lie in the first five buckets.
    assert got == {0: 7.0, 1: 3.0, 2: pytest.approx(6.0)}
    assert {r["fractile"] for r in G.nonzero_fractile(pixel_table(spark, rows[4:15]), "v", 0.0, 9).collect()} == {1.0}


def test_suppress_keeps_a_ridge(spark):
    rows = image(spark, [[0, 0, 2, 9, 11, 11, 11]] * 5)
    kept = {(r["x"], r["y"]) for r in G.suppress(M.forward_gradients(pixel_table(spark, rows))).collect()}
    assert kept == {(2, y) for y in (1, 2, 3)}


def test_level_curvature_of_flat_and_sloped_images(spark):
    flat = image(spark, [[4] * 4] * 4) + image(spark, [[x + 2 * y for x in range(4)] for y in range(4)], 1)
    got = G.level_curvature(pixel_table(spark, flat)).collect()
    assert len(got) == 8 and not any(r["v"] for r in got)


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 1.0])
def test_split_takes_exactly_the_share(spark, fraction):
    keys = [None, None, 5, 5, *range(3000)]
    df = spark.createDataFrame([(k, "z") for k in keys], "id long, testing_of string")
    got = E.split_samples(df, "id", fraction).collect()
    assert len(got) == len(keys) and sum(r["testing"] for r in got) == int(fraction * len(keys))
    assert E.split_samples(df.limit(0), "id", fraction).count() == 0


def test_distance_reaches_any_pixel(spark):
    seeds = {(1, 2), (9, 0)}
    rows = [(0, x, y, float((x, y) in seeds)) for x in range(20) for y in range(15) if (x, y) != (9, 14)] + [(1, 0, 0, 0.0)]
    sizes = {"l1": lambda a, b: a + b, "max": max, "squared": lambda a, b: a * a + b * b}
    for metric, size in sizes.items():
        got = {(r["img"], r["x"], r["y"]): r["distance"] for r in nearest.distance_transform(pixel_table(spark, rows), metric).collect()}
        assert got == {(i, x, y): None if i else min(size(abs(x - a), abs(y - b)) for a, b in seeds) for i, x, y, _ in rows}


def test_hocr_lines_hold_all_runs(spark, sf):
    lines = {}
    for r in image_queries.run_table(spark, sf).collect():
        lines.setdefault((r["img"], r["line"]), []).append((r["start"], r["end"]))
    assert any(len(x) > 1 for x in lines.values())
    pages = {r["page"]: r["html"] for r in table_queries.hocr(spark, sf).collect()}
    for (img, line), found in lines.items():
        box = f"id='line_{line}' title='bbox {min(found)[0]} {99 - line} {max(b for _, b in found)} {100 - line}'>{' '.join('x' * len(found))}</span>"
        assert box in pages[img]


def test_text_queries_read_whole_texts(spark, tmp_path):
    text = "x" * 130 + "the water is"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: table_queries.QUERIES[name].run(spark, str(tmp_path)).collect()
    assert {(r["t"], r["p"]): r["n"] for r in run("text_confusions") if r["t"] != r["p"]} == {("h", "n"): 1, ("r", ""): 1}
    assert [r["cost"] for r in run("text_block_moves")] == [2.0]
    assert [r["distance"] for r in run("text_edit_distance")] == [2]
    assert [(r["errors"], r["total"]) for r in run("text_evaluate")] == [(2, 142)]
    assert [r["item_id"] for r in run("text_find_confusion")] == [1]
