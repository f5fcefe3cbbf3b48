import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollweave.llm import sketch

PS = (0.01, 0.25, 0.5, 0.75, 0.99)


def rank_error(values, s):
    v = np.sort(values)
    worst = 0.0
    for p, q in zip(PS, s.quantiles(PS)):
        lo, hi = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
        worst = max(worst, lo - p, p - hi)
    return worst


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 12), st.sampled_from(["normal", "ties", "heavy"]))
def test_merged_parts_stay_within_the_stated_bound(seed, parts, kind):
    rng = np.random.default_rng(seed)
    x = {"normal": rng.normal, "ties": lambda size: rng.integers(0, 5, size).astype(float), "heavy": lambda size: rng.pareto(0.7, size)}[kind](size=20_000)
    merged = sketch.QuantileSketch(k=200)
    for part in np.array_split(x, parts):
        merged.merge(sketch.QuantileSketch.from_bytes(sketch.QuantileSketch(200, seed).update(part).to_bytes()))
    assert merged.n == len(x)
    assert rank_error(x, merged) <= merged.rank_error(1e-6)
    assert merged.quantiles((0, 1)) == [x.min(), x.max()]


def test_small_sketch_is_exact():
    s = sketch.QuantileSketch().update(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles((0.5,)) == [2.0] and s.rank_error() == 0


def test_nulls_nan_groups_and_days_that_merge(spark):
    rows = [("a", float(i), None) for i in range(2000)] + [("a", None, 1.0), ("a", float("nan"), 2.0), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    out = sketch.percentiles(df, {"g": F.col("g")}, {"v": F.col("v"), "w": F.col("w")}, (0.5,))
    got = {(r["grp"], r["metric"]): r for r in out.collect()}
    a = got["a", "v"]
    assert (a["n"], a["n_missing"]) == (2000, 2) and abs(a["estimate"] - 1000) <= 2000 * a["rank_error"] + 1
    assert got[None, "v"]["estimate"] == 5.0 and got[None, "w"]["estimate"] is None
    assert got["a", "w"]["n"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert sketch.percentiles(df, {"g": F.col("g")}, {"v": F.col("v")}, (0.5,)).count() == 0


def test_rank_check_is_exact(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(700)], "g string, v double")
    groups, metrics = {"g": F.col("g")}, {"v": F.col("v")}
    est = sketch.percentiles(df, groups, metrics, PS)
    for r in sketch.rank_check(df, groups, metrics, est).collect():
        assert r["low"] - r["rank_error"] <= r["p"] <= r["high"] + r["rank_error"]
