"""Least median of squares: small groups by their definition, and a line among a third of wild points."""

import hashlib
import random

from quillspark.operators import lms


def test_small_groups(spark):
    rows = [("one", 1, 3.0, 7.0), ("two", 1, 0.0, 1.0), ("two", 2, 2.0, 5.0), ("same", 1, 4.0, 2.0), ("same", 2, 4.0, 8.0)]
    got = {r["g"]: (r["m"], r["c"]) for r in lms.fit_lines(spark.createDataFrame(rows, "g string, id long, x double, y double"), ["g"]).collect()}
    assert got == {"one": (0.0, 7.0), "two": (2.0, 1.0), "same": (0.0, 5.0)}


def test_best_of_the_same_candidates(spark):
    rng = random.Random(3)
    rows = [(g, k, float(x := rng.randrange(1000)), 3.0 * x + 5 if k % 3 else float(rng.randrange(9000))) for g in ("a", "b") for k in range(90)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    lines = lms.candidates(df, ["g"]).collect()
    for r in lms.fit_lines(df, ["g"]).collect():
        mine = [(p[2], p[3]) for p in rows if p[0] == r["g"]]
        errors = {c["trial"]: sorted((y - c["m"] * x - c["c"]) ** 2 for x, y in mine)[len(mine) // 2] for c in lines if c["g"] == r["g"]}
        assert r["error"] == min(errors.values())
        assert abs(r["m"] - 3) < 1e-9 and abs(r["c"] - 5) < 1e-6


def test_least_hash_of_each_group(spark):
    """Found through sums of fixed size, which need no sort of a group's rows."""
    rows = [(g, t, k, float(k), 0.0) for g in ("a", "b") for t in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, trial int, id long, x double, y double")
    tops = {(r["g"], r["trial"]): r["_p"]["id"] for r in lms._least(df, ["g", "trial"], "first").collect()}
    assert tops == {(g, t): min(range(200), key=lambda k: hashlib.md5(f"first:{t}:{k}".encode()).hexdigest()) for g in ("a", "b") for t in range(3)}
