import math

import pytest
from pyspark.sql import functions as F

from rollweave.functions import bounds as B
from rollweave.functions import losses as L
from rollweave.operators import advantages as A


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("y")).first()["y"]


def test_masked_mean_hides_nan_outside_the_mask(spark):
    def mean(vals, mask):
        return spark.createDataFrame(list(zip(vals, mask)), "x double, m int").agg(L.masked_mean(F.col("x"), F.col("m"))).first()[0]

    nan = float("nan")
    assert mean([1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1]) == pytest.approx(2.5, abs=1e-6)
    assert mean([1.0, 2.0, nan, 4.0], [1, 0, 0, 1]) == pytest.approx(2.5, abs=1e-6)
    assert math.isnan(mean([1.0, 2.0, nan, 4.0], [1, 0, 1, 0]))


def test_whitened_has_mean_zero_and_variance_one_and_small_masks_raise(spark):
    df = spark.createDataFrame([(float(i * i % 17), int(i % 3 > 0)) for i in range(60)], "x double, m int")
    w = L.whiten(df, "x", "m", "w").where("m = 1").agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(0, abs=1e-6) and w[1] == pytest.approx(1, abs=1e-5)
    with pytest.raises(Exception, match="fewer than two"):
        L.masked_moments(df.limit(1).withColumn("m", F.lit(1)), "x", "m").collect()


def test_gae_ignores_values_on_masked_tokens(spark):
    rewards, mask = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0], [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]

    def run(noise):
        fixed = iter([4.0, 5.0, 6.0, 7.0, 9.0])
        rows = [(1, i, float(r), next(fixed) if m else noise * (i + 1), m) for i, (r, m) in enumerate(zip(rewards, mask))]
        df = spark.createDataFrame(rows, "seq int, pos int, r double, v double, m int")
        return [x["adv"] for x in A.gae(df, "seq", ["pos"], "r", "v", "m", 0.9, 0.8).orderBy("pos").collect() if x["m"]]

    assert run(3.0) == pytest.approx(run(-50.0))


@pytest.mark.parametrize("method", ["bandkl", "bandtv", "bandchi2"])
def test_bands_hold_one_and_the_constraint(spark, method):
    lps = [-1e-9, -0.01, -0.5, -2.0, -9.0, -20.0, -800.0]
    lo, hi = B.band(F.col("lp"), method, delta=0.05, relax=False)
    df = spark.createDataFrame([(x,) for x in [*lps, None]], "lp double").select("lp", lo.alias("lo"), hi.alias("hi"))
    f = {"bandkl": B.f_kl, "bandtv": B.f_tv, "bandchi2": B.f_chi2}[method]
    import numpy as np

    for r in df.collect():
        if r["lp"] is None:
            assert r["lo"] is None and r["hi"] is None
            continue
        assert 0 <= r["lo"] <= 1 <= r["hi"] <= 100
        p = math.exp(r["lp"])
        if 1e-5 < p < 1 - 1e-5:
            for x in (r["lo"], r["hi"]):
                if 1e-6 < x < min(99.0, 1 / p - 1e-6):
                    assert B.divergence(f, np.float64(p), np.float64(x)) == pytest.approx(0.05, abs=2e-3)
    with pytest.raises(ValueError):
        B.band(F.col("lp"), "nothing")


def test_soft_clips_meet_one_and_stay_near_their_bounds(spark):
    for name, f in B.SOFT_CLIPS.items():
        df = spark.createDataFrame([(x / 10,) for x in range(1, 40)], "r double")
        ys = {r["r"]: r["y"] for r in df.select("r", f(F.col("r"), F.lit(0.8), F.lit(1.2)).alias("y")).collect()}
        assert ys[1.0] == pytest.approx(1.0, abs=1e-9), name
        if name not in ("none",):
            assert all(0.5 < y < 1.7 for y in ys.values()), name


def test_schedules_start_and_end(spark):
    for name in B.DECAYS:
        df = spark.createDataFrame([(0.0,), (1.0,)], "t double")
        a, b = [r["y"] for r in df.select("t", B.decay(F.col("t"), name, 0.3, 0.1).alias("y")).orderBy("t").collect()]
        assert a == pytest.approx(0.3) and b == pytest.approx(0.1)
    assert [round(x, 6) for x, _ in B.cycles(0.15, 2.0)] == [0, 0.15, 0.45]
    with pytest.raises(ValueError):
        B.decay(F.col("t"), "nothing", 1, 0)


def test_kl_estimators(spark):
    assert one(spark, L.kl(F.col("a"), F.col("b"), "k3"), a=-1.0, b=-3.0) == pytest.approx(math.exp(-2) + 2 - 1)
    assert one(spark, L.kl(F.col("a"), F.col("b"), "k3"), a=-90.0, b=0.0) == 10.0
    assert L.kl_coefficient(0.1, 9.0, 10, 1.0, 100) == pytest.approx(0.1 * 1.02)


def test_singletons_and_registry(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), (None, 5.0)], "g string, s double")
    got = {(r["g"], r["s"]): r["adv"] for r in A.grpo(df, "g", "s").collect()}
    assert got["a", 3.0] == pytest.approx(3.0, abs=1e-4) and got[None, 5.0] == pytest.approx(5.0, abs=1e-4)
    assert {(r["g"], r["s"]): r["adv"] for r in A.rloo(df, "g", "s").collect()}["a", 3.0] == 3.0
    with pytest.raises(Exception, match="fewer than two"):
        A.grpo_passk(df, "g", "s", "s").collect()
    with pytest.raises(ValueError):
        A.register("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        A.compute_advantage(df, "nothing")
    assert A.grpo(df.limit(0), "g", "s").count() == 0


def test_discounted(spark):
    y = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>").select(A.discounted(F.col("x"), 0.5)).first()[0]
    assert y == [3.0, 4.0, 4.0]


def test_opo_gives_nan_where_all_lengths_are_zero(spark):
    rows = [(1, 1, 2.0, 0), (2, 1, 4.0, 0), (3, 2, 5.0, 0), (4, 3, 1.0, 3), (5, 3, 2.0, 1), (6, None, 7.0, 0), (7, None, None, 0)]
    df = spark.createDataFrame(rows, "k int, g int, s double, n int")
    got = {r["k"]: r["adv"] for r in A.compute_advantage(df, "opo", group="g", score="s", length="n").collect()}
    assert all(math.isnan(got[k]) for k in (1, 2, 6)) and got[7] is None
    assert (got[3], got[4], got[5]) == (5.0, -0.25, 0.75)
