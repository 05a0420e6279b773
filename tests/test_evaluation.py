"""Given values and edge cases of the evaluation and resampling operators."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import resample as M
from quillspark.operators import stats as S


def test_settled_median_of_an_empty_pile(spark):
    hist = S.histogram(spark.createDataFrame([(v, g) for g, vs in (("a", (6, 6, 13, 14)), ("b", (3,)), ("c", (1, 2, 2, 2))) for v in vs], "v int, g string"), F.col("v"), ["g"])
    assert {r["g"]: r["median"] for r in E.settled_median(hist, ["g"]).collect()} == {"a": 9.5, "b": 3.5, "c": pytest.approx(2 + 1 / 3)}


@pytest.mark.parametrize("degrees,alpha,want", [(2, 0.05, 5.991465), (4, 0.01, 13.276704), (10, 0.05, 18.307038)])
def test_chi_squared_limits(degrees, alpha, want):
    assert E.chi_squared_limit(degrees, alpha) == pytest.approx(want, abs=1e-5)
    assert E.chi_squared_limit(degrees - 1, alpha) == E.chi_squared_limit(degrees, alpha)


def test_segment_report_with_noise(spark):
    # Model 1 is split over images 1 and 2, model 2 meets only noise, image 3 meets only the model's noise.
    cells = spark.createDataFrame([(1, 1, 60), (1, 2, 40), (2, 9, 5), (8, 3, 7)], "a int, b int, n long")
    got = {r["side"]: r.asDict() for r in E.segment_report(cells, 0.3, 1000, (8, 9)).collect()}
    assert got["model"] == {"side": "model", "segments": 2, "parts": 3, "split": 1, "unmatched": 1}
    assert got["image"] == {"side": "image", "segments": 3, "parts": 3, "split": 0, "unmatched": 1}
    assert {(r["side"], r["bucket"]): r["n"] for r in E.share_histogram(cells, 10, (8, 9)).collect()} == {("model", 6): 1, ("model", 4): 1, ("image", 9): 2}
    assert E.one_to_one(cells, 0.2, 10, (8, 9)).count() == 0 and E.segment_report(cells.limit(0), 0.3, 5, (8, 9)).count() == 0


def test_weighted_draws_edges(spark):
    rows = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 6), (1025, 2)], "id long, weight int")
    draws = spark.createDataFrame([(k, k / 10) for k in range(10)], "draw long, u double")
    got = {r["draw"]: r["id"] for r in E.weighted_draws(rows, draws).collect()}
    assert got == {0: 1, 1: 1, 2: 1025, 3: 1025, **dict.fromkeys(range(4, 10), 4)}
    assert E.weighted_draws(rows.limit(0), draws).count() == 0


def test_least_squares_of_dependent_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0 * k, float(k)) for k in range(1, 9)], "one double, two double, y double, x double")
    w = [r["weight"] for r in E.least_squares(df, ["one", "two", "x"], "y").orderBy("k").collect()]
    assert w[2] == pytest.approx(3) and w[0] + 2 * w[1] == pytest.approx(0, abs=1e-9)


def test_gauss_axis_keeps_constants_and_clamps(spark):
    values = [5.0, 1.0, 7.0, 2.0]
    df = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate(values)] + [(1, 0, x, 3.0) for x in range(20)] + [(2, 0, 0, 4.0)], "img int, y int, x int, v double")
    got = {(r["img"], r["x"]): r["v"] for r in M.gauss_axis(df, ["img", "y"], "x", 1.5).collect()}
    w = M.gauss_weights(1.5)
    for x in range(4):
        want = sum(w[abs(d)] * values[min(max(x + d, 0), 3)] for d in range(1 - len(w), len(w)))
        assert math.isclose(got[0, x], want)
    assert all(math.isclose(got[1, x], 3.0) for x in range(20)) and math.isclose(got[2, 0], 4.0)


def test_page_skew_without_large_rows(spark):
    rows = spark.createDataFrame([(1, 0.3, 5.0, 1), (1, 0.1, 9.0, 2), (1, 0.2, 7.0, 3), (2, 0.9, 1.0, 9), (2, 0.0, 0.0, 1)], "page int, m double, e double, n int")
    got = {r["page"]: (r["gradient"], r["error"]) for r in E.page_skew(rows, "page", "m", "e", "n").collect()}
    assert got == {1: (0.2, 7.0), 2: (0.9, 1.0)}
