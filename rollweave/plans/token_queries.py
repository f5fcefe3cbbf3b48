"""Queries on token rows: losses, bounds, folds and aggregates. ``lineitem`` stands for tokens, its order for the sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import bounds as B
from rollweave.functions import losses as L
from rollweave.operators import advantages as A
from rollweave.operators import batch as D
from rollweave.operators import aggregates as G
from rollweave.operators.batch import first_share
from rollweave.plans.registry import query, r6
from rollweave.session import table

ORDER = ["pos", "t1", "t2", "t3", "t4", "t5"]

TOK = """tok AS (SELECT l_orderkey AS seq, l_linenumber AS pos, l_partkey AS t1, l_suppkey AS t2, l_extendedprice AS t3, l_discount AS t4, l_tax AS t5,
  -(l_discount * 8e0 + 0.05e0 + l_quantity / 100e0) AS lp, -(l_tax * 10e0 + 0.05e0 + l_quantity / 100e0) AS old_lp,
  -(l_discount * 4e0 + l_tax * 4e0 + 0.1e0) AS ref_lp, l_quantity / 25e0 - 1e0 AS adv, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask,
  l_extendedprice / 77777e0 AS reward, l_quantity / 50e0 AS value FROM lineitem)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("t1"), F.col("l_suppkey").alias("t2"),
        F.col("l_extendedprice").alias("t3"), F.col("l_discount").alias("t4"), F.col("l_tax").alias("t5"),
        (-(F.col("l_discount") * 8.0 + 0.05 + q / 100)).alias("lp"), (-(F.col("l_tax") * 10.0 + 0.05 + q / 100)).alias("old_lp"),
        (-(F.col("l_discount") * 4.0 + F.col("l_tax") * 4.0 + 0.1)).alias("ref_lp"), (q / 25.0 - 1.0).alias("adv"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"), (F.col("l_extendedprice") / 77777.0).alias("reward"), (q / 50.0).alias("value"),
    )


KEYS = ["seq", *ORDER]
KEYS_SQL = "seq, pos, t1, t2, t3, t4, t5"


def _scalar(name: str, spark_expr, sql_expr: str, cte: str = TOK) -> None:
    """A query of KEYS and one computed column."""

    @query(f"WITH {cte} SELECT {KEYS_SQL}, round({sql_expr}, 6) + 0.0 AS y FROM tok", name)
    def _(spark: SparkSession, d: str) -> DataFrame:
        return tokens(spark, d).select(*KEYS, r6(spark_expr()).alias("y"))


def _pair(name: str, spark_bounds, low_sql: str, high_sql: str) -> None:
    @query(f"WITH {TOK} SELECT {KEYS_SQL}, round({low_sql}, 6) + 0.0 AS lower, round({high_sql}, 6) + 0.0 AS upper FROM tok", name)
    def _(spark: SparkSession, d: str) -> DataFrame:
        lo, hi = spark_bounds(F.col("old_lp"))
        return tokens(spark, d).select(*KEYS, r6(lo).alias("lower"), r6(hi).alias("upper"))


_scalar("kl_penalty_k1", lambda: L.kl(F.col("lp"), F.col("ref_lp"), "k1"), "lp - ref_lp")
_scalar("kl_penalty_abs", lambda: L.kl(F.col("lp"), F.col("ref_lp"), "abs"), "abs(lp - ref_lp)")
_scalar("kl_penalty_k2", lambda: L.kl(F.col("lp"), F.col("ref_lp"), "k2"), "0.5e0 * (lp - ref_lp) * (lp - ref_lp)")
_scalar("kl_penalty_k3", lambda: L.kl(F.col("lp"), F.col("ref_lp"), "k3"), "least(greatest(exp(ref_lp - lp) - (ref_lp - lp) - 1, -10e0), 10e0)")
_scalar("token_kl_reward", lambda: L.kl_reward(F.col("reward"), F.col("old_lp"), F.col("ref_lp"), 0.05), "reward - (old_lp - ref_lp) * 0.05e0")
_scalar("kl_penalised_reward", lambda: F.col("reward") - 0.1 * L.kl(F.col("old_lp"), F.col("ref_lp"), "k1") * F.col("mask"), "reward - 0.1e0 * (old_lp - ref_lp) * mask")
_scalar("value_loss_tokens", lambda: L.value_loss(F.col("value"), F.col("reward"), F.col("adv"), 0.2), "0.5e0 * greatest((value - reward) ^ 2, (least(greatest(value, adv - 0.2e0), adv + 0.2e0) - reward) ^ 2)")
_scalar("gpg_loss_tokens", lambda: L.POLICY_LOSSES["gpg"](F.col("lp"), F.col("old_lp"), F.col("adv")), "-lp * adv")

_R = "exp(least(greatest(lp - old_lp, -20e0), 20e0))"
_PPO = f"""CASE WHEN adv < 0 THEN least(-adv * 3e0, greatest(-adv * {_R}, -adv * least(greatest({_R}, 0.8e0), 1.2e0))) ELSE greatest(-adv * {_R}, -adv * least(greatest({_R}, 0.8e0), 1.2e0)) END"""
_scalar("ppo_clip_loss_tokens", lambda: L.POLICY_LOSSES["vanilla"](F.col("lp"), F.col("old_lp"), F.col("adv")), _PPO)

_P = "exp(least(greatest(old_lp, -700e0), 0e0))"


def _band_sql(lower: str, upper: str, at_one: str) -> tuple[str, str]:
    lo = f"CASE WHEN {_P} < 1e-6 THEN 0e0 WHEN {_P} > 1 - 1e-6 THEN {at_one} ELSE {lower} END"
    hi = f"CASE WHEN {_P} < 1e-6 THEN 1 / greatest({_P}, 1e-12) WHEN {_P} > 1 - 1e-6 THEN 1e0 ELSE {upper} END"
    return f"least(greatest(least({lo}, 1 - 0.2e0), 0e0), 1e0)", f"least(greatest(greatest({hi}, 1 + 0.28e0), 1e0), 100e0)"


_pair("band_tv", lambda lp: B.band(lp, "bandtv"), *_band_sql(f"greatest(1 - 0.05e0 / {_P}, 0e0)", f"least(1 + 0.05e0 / {_P}, 1 / {_P})", "0.95e0"))
_pair("band_chi2", lambda lp: B.band(lp, "bandchi2"), *_band_sql(f"greatest(1 - sqrt(0.05e0 * (1 - {_P}) / {_P}), 0e0)", f"least(1 + sqrt(0.05e0 * (1 - {_P}) / {_P}), 1 / {_P})", "1e0"))
_pair("dcpo_bounds", lambda lp: B.dcpo(lp), f"0.5e0 + 0.5e0 * sqrt(greatest(1 - 0.64e0 / greatest({_P}, 1e-12), 0e0))", f"least(0.5e0 + 0.5e0 * sqrt(1 + 0.8e0 / greatest({_P}, 1e-12)), 10e0)")
_A, _Bc, _C, _D = (f"({x!r}::DOUBLE)" for x in B.cubic_coefficients(0.05))
_Q = "(1 - exp(old_lp))"
_UP = f"((({_A} * exp(old_lp) + {_Bc}) * exp(old_lp) + {_C}) * exp(old_lp) + {_D})"
_DOWN = f"(-((({_A} * {_Q} + {_Bc}) * {_Q} + {_C}) * {_Q} + {_D}))"
_HI = f"least(greatest(least(exp(old_lp) + {_UP}, 1e0) / greatest(exp(old_lp), 1e-12), 0e0), 10e0)"
_LO = f"least(greatest(greatest(exp(old_lp) + {_DOWN}, 0e0) / greatest(exp(old_lp), 1e-12), 0e0), 10e0)"
_pair("cubic_bounds_sub", lambda lp: B.cubic(lp, B.cubic_coefficients(0.05)), f"least({_LO}, {_HI})", _HI)
_HI2 = f"least(greatest(1 + ({_A} * exp(old_lp) + {_Bc}) * exp(old_lp) + {_C} + {_D} / greatest(exp(old_lp), 1e-12), 0e0), 10e0)"
_LO2 = f"least(greatest(1 + {_DOWN} / greatest(exp(old_lp), 1e-12), 0e0), 10e0)"
_pair("cubic_bounds_div", lambda lp: B.cubic(lp, B.cubic_coefficients(0.05), "div"), f"least({_LO2}, {_HI2})", _HI2)


@query()
def band_kl(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = B.band(F.col("old_lp"), "bandkl")
    return tokens(spark, d).select(*KEYS, r6(lo).alias("lower"), r6(hi).alias("upper"))


_RR = "exp(lp - old_lp)"


def _soft(name: str, method: str, sql: str, **options: float) -> None:
    _scalar(f"soft_clip_{name}", lambda: B.soft_clip(F.exp(F.col("lp") - F.col("old_lp")), F.lit(0.8), F.lit(1.28), method, **options), sql)




def _tanh(x: str) -> str:
    return f"(1 - 2 / (exp(least(2e0 * ({x}), 600e0)) + 1))"


_soft("hard", "hard", f"least(greatest({_RR}, 0.8e0), 1.28e0)")
_soft("1seg", "1seg", f"1.04e0 + 0.24e0 * {_tanh(f'({_RR} - 1.04e0) / 0.24e0')}")
_soft("2seg", "2seg", f"CASE WHEN {_RR} >= 1 THEN 1 + 0.28e0 * {_tanh(f'({_RR} - 1) / 0.28e0')} ELSE 1 + 0.2e0 * {_tanh(f'({_RR} - 1) / 0.2e0')} END")
_EH, _EL = "(0.1e0 + 0.9e0 * 1.28e0)", "(0.1e0 + 0.9e0 * 0.8e0)"


def _tail3(w: str, e: str, sign: str) -> str:
    kappa = f"({w} / ({w} * {w} - {e} * {e}))"
    shift = f"(0.5e0 * ln((1 + {e} / {w}) / (1 - {e} / {w})) - {kappa} * {e})"
    return f"1 + {w} * {_tanh(f'{kappa} * ({_RR} - 1) {sign} {shift}')}"


_soft("3seg", "3seg", f"CASE WHEN {_RR} <= {_EL} THEN {_tail3('0.2e0', f'(1 - {_EL})', '-')} WHEN {_RR} >= {_EH} THEN {_tail3('0.28e0', f'({_EH} - 1)', '+')} ELSE {_RR} END")
_AH = "(0.1e0 * (1.28e0 / 0.8e0) ^ 2)"
_soft(
    "3seg_rollback",
    "3seg_rollback",
    f"CASE WHEN {_RR} <= 0.8e0 THEN 0.8e0 - 0.1e0 * {_tanh(f'{_RR} - 1')} - 0.1e0 * {_tanh('0.2e0')} WHEN {_RR} >= 1.28e0 THEN 1.28e0 - {_AH} * {_tanh(f'{_RR} - 1')} + {_AH} * {_tanh('0.28e0')} ELSE {_RR} END",
)
_soft(
    "3seg_rollback_plus",
    "3seg_rollback_plus",
    f"CASE WHEN {_RR} <= 0.8e0 THEN 0.8e0 - 0.1e0 * {_tanh(f'0.2e0 * ({_RR} - 0.8e0)')} WHEN {_RR} >= 1.28e0 THEN 1.28e0 - 0.1e0 * 0.28e0 / 0.2e0 * {_tanh(f'0.2e0 * ({_RR} - 1.28e0)')} ELSE {_RR} END",
)
_G = "exp(2e0)"
_soft(
    "3seg_converge",
    "3seg_converge",
    f"""CASE WHEN {_RR} <= {_EL} THEN greatest(0e0, ({_EL} - 0.8e0) * (1 + {_G}) / (2 * {_G}) * {_tanh(f"(1 + {_G}) / (2 * ({_EL} - 0.8e0)) * ({_RR} - ({_EL} - 2 * ({_EL} - 0.8e0) / (1 + {_G})))")} + 0.8e0 + ({_EL} - 0.8e0) * (1 + {_G}) / (2 * {_G}))
    WHEN {_RR} >= {_EH} THEN (1.28e0 - {_EH}) * (1 + {_G}) / 2 * {_tanh(f"(1 + exp(-2e0)) / (2 * (1.28e0 - {_EH})) * ({_RR} - ({_EH} - 2 * (1.28e0 - {_EH}) * {_G} / (1 + {_G})))")} + 1.28e0 - (1.28e0 - {_EH}) * (1 + {_G}) / 2 ELSE {_RR} END""",
)

_T = "least(greatest(value, 0e0), 1e0)"
for _n, _k, _s in (
    ("linear", {}, f"0.3e0 - 0.2e0 * {_T}"),
    ("hold_linear", {}, f"CASE WHEN {_T} <= 0.3e0 THEN 0.3e0 ELSE 0.3e0 - 0.2e0 / 0.7e0 * ({_T} - 0.3e0) END"),
    ("cosine", {}, f"0.1e0 + 0.1e0 * (1 + cos(pi() * {_T}))"),
    ("poly", {}, f"0.1e0 + 0.2e0 * (1 - {_T}) ^ 2"),
    ("restarts", {}, f"CASE WHEN {_T} < 0.15e0 THEN 0.1e0 + 0.1e0 * (1 + cos(pi() * {_T} / 0.15e0)) WHEN {_T} < 0.45e0 - 1e-15 THEN 0.1e0 + 0.1e0 * (1 + cos(pi() * ({_T} - 0.15e0) / 0.3e0)) ELSE 0.1e0 + 0.1e0 * (1 + cos(pi() * ({_T} - 0.45e0) / 0.55e0)) END"),
):
    _scalar(f"decay_{_n}", lambda n=_n: B.decay(F.col("value"), n, 0.3, 0.1), _s)

_MM = "sum(CASE WHEN mask = 1 THEN {x} ELSE 0 END) / (sum(mask) + 1e-8)"


def _mm(x: str) -> str:
    return _MM.format(x=x)


@query(f"WITH {TOK}, m AS (SELECT sum(mask) AS n, {_mm('adv')} AS mean FROM tok) SELECT round(mean, 6) AS mean, round((SELECT sum(mask * (adv - mean) ^ 2) FROM tok) / (n + 1e-8) * n / (n - 1), 6) AS var FROM m")
def masked_moments(spark: SparkSession, d: str) -> DataFrame:
    return L.masked_moments(tokens(spark, d), "adv", "mask").select(r6("mean").alias("mean"), r6("var").alias("var"))


@query(f"""WITH {TOK}, m AS (SELECT sum(mask) AS n, {_mm('adv')} AS mean FROM tok), v AS (SELECT mean, (SELECT sum(mask * (adv - mean) ^ 2) FROM tok) / (n + 1e-8) * n / (n - 1) AS var FROM m)
SELECT {KEYS_SQL}, round((adv - mean) / sqrt(var + 1e-8), 6) + 0.0 AS w FROM tok, v""")
def masked_whiten(spark: SparkSession, d: str) -> DataFrame:
    return L.whiten(tokens(spark, d), "adv", "mask", "w").select(*KEYS, r6("w").alias("w"))


@query(f"WITH {TOK} SELECT seq, round({_mm('adv')}, 6) + 0.0 AS mean, round(sum(CASE WHEN mask = 1 THEN adv ELSE 0 END), 6) + 0.0 AS total FROM tok GROUP BY seq")
def masked_mean_by_sequence(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("seq").agg(r6(L.masked_mean(F.col("adv"), F.col("mask"))).alias("mean"), r6(L.masked_sum(F.col("adv"), F.col("mask"))).alias("total"))


_PER = f"per AS (SELECT seq, sum(CASE WHEN mask = 1 THEN {_PPO} ELSE 0 END) AS s, sum(mask) AS n, count(*) AS len FROM tok GROUP BY seq)"
for _mode, _sql in (
    ("token-mean", f"WITH {TOK} SELECT round({_mm(_PPO)}, 6) + 0.0 AS loss FROM tok"),
    ("seq-mean-token-sum", f"WITH {TOK}, {_PER} SELECT round(avg(s), 6) + 0.0 AS loss FROM per"),
    ("seq-mean-token-mean", f"WITH {TOK}, {_PER} SELECT round(avg(s / (n + 1e-8)), 6) + 0.0 AS loss FROM per"),
    ("seq-mean-token-sum-norm", f"WITH {TOK}, {_PER} SELECT round(sum(s) / max(len), 6) + 0.0 AS loss FROM per"),
):

    @query(_sql, "agg_loss_" + _mode.replace("-", "_"))
    def _agg(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        t = tokens(spark, d).withColumn("loss", L.POLICY_LOSSES["vanilla"](F.col("lp"), F.col("old_lp"), F.col("adv")))
        return L.aggregate_loss(t, "seq", "loss", "mask", mode).select(r6("loss").alias("loss"))


@query(f"""WITH {TOK} SELECT round({_mm(_PPO)}, 6) + 0.0 AS loss, round({_mm(f"CASE WHEN -adv * least(greatest({_R}, 0.8e0), 1.2e0) > -adv * {_R} THEN 1e0 ELSE 0e0 END")}, 6) AS clipped,
round({_mm(f"CASE WHEN adv < 0 AND greatest(-adv * {_R}, -adv * least(greatest({_R}, 0.8e0), 1.2e0)) > -adv * 3e0 THEN 1e0 ELSE 0e0 END")}, 6) AS dual_clipped, round({_mm('old_lp - lp')}, 6) + 0.0 AS kl FROM tok""")
def ppo_clip_metrics(spark: SparkSession, d: str) -> DataFrame:
    parts = L.clipped_surrogate(F.col("lp"), F.col("old_lp"), F.col("adv"))
    return tokens(spark, d).agg(*[r6(L.masked_mean(c, F.col("mask"))).alias(n) for n, c in parts.items()])


@query(f"""WITH {TOK}, s AS (SELECT *, exp(least(sum(CASE WHEN mask = 1 THEN lp - old_lp ELSE 0 END) OVER w / greatest(sum(mask) OVER w, 1), 10e0)) AS r FROM tok WINDOW w AS (PARTITION BY seq))
SELECT round({_mm('greatest(-adv * r, -adv * least(greatest(r, 0.9997e0), 1.0004e0))')}, 6) + 0.0 AS loss FROM s""")
def gspo_loss(spark: SparkSession, d: str) -> DataFrame:
    t = L.sequence_ratio(tokens(spark, d), "seq", "lp", "old_lp", "mask", "r")
    loss = F.greatest(-F.col("adv") * F.col("r"), -F.col("adv") * B.clamp(F.col("r"), 0.9997, 1.0004))
    return t.agg(r6(L.masked_mean(loss, F.col("mask"))).alias("loss"))


@query(f"""WITH {TOK}, per AS (SELECT seq, exp(sum(CASE WHEN mask = 1 THEN sign(adv) * least(sign(adv) * (lp - old_lp), sign(adv) * least(greatest(lp - old_lp, -0.4e0), 0.4e0)) ELSE 0 END) / (sum(mask) + 1e-8)) AS r, {_mm('adv')} AS a FROM tok GROUP BY seq)
SELECT round(avg(-a * r), 6) + 0.0 AS loss FROM per""")
def gmpo_loss(spark: SparkSession, d: str) -> DataFrame:
    return L.geometric_mean_loss(tokens(spark, d), "seq", "lp", "old_lp", "adv", "mask").select(r6("loss").alias("loss"))


_COV = f"m AS (SELECT {_mm('adv')} AS ma, {_mm('lp')} AS ml FROM tok), cov AS (SELECT tok.*, (adv - ma) * (lp - ml) AS c FROM tok, m)"


@query(f"WITH {TOK}, {_COV}, k AS (SELECT greatest(1, floor(count(*) * 0.01e0)) AS k FROM cov WHERE mask = 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, {KEYS_SQL}) AS rn FROM cov WHERE mask = 1) SELECT {KEYS_SQL}, round(c, 6) + 0.0 AS c FROM r, k WHERE rn <= k")
def kl_cov_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = L.covariance(tokens(spark, d), "lp", "adv", "mask", "c").where("mask = 1")
    top = first_share(t.withColumn("down", -F.col("c")), ["down", *KEYS], 0.01, 1)
    return top.select(*KEYS, r6("c").alias("c"))


@query(f"""WITH {TOK}, {_COV}, n AS (SELECT greatest(CAST(floor(0.002e0 * sum(mask)) AS BIGINT), 1) AS n FROM tok),
band AS (SELECT *, row_number() OVER (ORDER BY (seq * 2654435761 + pos) % 4294967296, {KEYS_SQL}) AS i FROM cov WHERE mask = 1 AND c > 0.02e0 AND c < 0.06e0 AND NOT -adv * least(greatest({_R}, 0.8e0), 1.2e0) > -adv * {_R})
SELECT {KEYS_SQL}, round(c, 6) + 0.0 AS c FROM band, n WHERE i <= n""")
def clip_cov_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of the tokens in the band that the clip does not reach anyway, as many as a share of all masked tokens, picked by hash."""
    t = L.covariance(tokens(spark, d), "lp", "adv", "mask", "c")
    n = t.agg(F.greatest(F.floor(F.sum("mask") * 0.002).cast("bigint"), F.lit(1)).alias("n"))
    clipped = L.clipped_surrogate(F.col("lp"), F.col("old_lp"), F.col("adv"))["clipped"]
    band = t.where((F.col("mask") == 1) & (F.col("c") > 0.02) & (F.col("c") < 0.06) & (clipped == 0)).withColumn("h", (F.col("seq") * F.lit(2654435761) + F.col("pos")) % F.lit(4294967296))
    return D.first_of(band, ["h", *KEYS], n).select(*KEYS, r6("c").alias("c"))


@query(f"WITH {TOK} SELECT {KEYS_SQL}, round(sum(reward * mask) OVER (PARTITION BY seq ORDER BY pos, t1, t2, t3, t4, t5 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS ret, round(sum(reward * mask) OVER (PARTITION BY seq ORDER BY pos, t1, t2, t3, t4, t5 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - value * mask, 6) + 0.0 AS adv FROM tok")
def remax_return_to_go(spark: SparkSession, d: str) -> DataFrame:
    t = A.remax(tokens(spark, d).drop("adv"), "seq", ORDER, "reward", "mask", "value")
    return t.select(*KEYS, r6("ret").alias("ret"), r6("adv").alias("adv"))


_NUM = f"num AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC, t5 DESC) AS rn, count(*) OVER (PARTITION BY seq) AS n FROM tok)"


@query(f"""WITH RECURSIVE {TOK}, {_NUM},
f AS (SELECT seq, rn, n, reward, value, mask, (reward - value) * mask AS run, value * mask AS nv FROM num WHERE rn = 1
 UNION ALL SELECT b.seq, b.rn, b.n, b.reward, b.value, b.mask, (b.reward + f.nv - b.value + 0.95e0 * f.run) * b.mask + (1 - b.mask) * f.run, b.value * b.mask + (1 - b.mask) * f.nv FROM f JOIN num b ON b.seq = f.seq AND b.rn = f.rn + 1),
m AS (SELECT sum(mask) AS k, sum(run * mask) / (sum(mask) + 1e-8) AS mean FROM f), v AS (SELECT mean, (SELECT sum(mask * (run - mean) ^ 2) FROM f) / (k + 1e-8) * k / (k - 1) AS var FROM m)
SELECT seq, CAST(n - rn AS INTEGER) AS pos, round(run + value, 6) + 0.0 AS ret, round((run - mean) / sqrt(var + 1e-8), 6) + 0.0 AS adv FROM f, v""")
def gae(spark: SparkSession, d: str) -> DataFrame:
    t = A.gae(tokens(spark, d).drop("adv"), "seq", ORDER, "reward", "value", "mask", 1.0, 0.95)
    return t.select("seq", "pos", r6("ret").alias("ret"), r6("adv").alias("adv"))


@query(f"""WITH RECURSIVE {TOK}, {_NUM},
f AS (SELECT seq, rn, n, mask, reward AS ret, reward * mask AS run FROM num WHERE rn = 1
 UNION ALL SELECT b.seq, b.rn, b.n, b.mask, b.reward + 0.9e0 * f.run, (b.reward + 0.9e0 * f.run) * b.mask FROM f JOIN num b ON b.seq = f.seq AND b.rn = f.rn + 1),
m AS (SELECT sum(mask) AS k, sum(ret * mask) / (sum(mask) + 1e-8) AS mean FROM f), v AS (SELECT mean, (SELECT sum(mask * (ret - mean) ^ 2) FROM f) / (k + 1e-8) * k / (k - 1) AS var FROM m)
SELECT seq, CAST(n - rn AS INTEGER) AS pos, round(ret, 6) + 0.0 AS ret, round((ret - mean) / sqrt(var + 1e-8) * mask, 6) + 0.0 AS adv FROM f, v""")
def reinforce_plus_plus(spark: SparkSession, d: str) -> DataFrame:
    t = A.rfpp(tokens(spark, d).drop("adv"), "seq", ORDER, "reward", "mask", 0.9)
    return t.select("seq", "pos", r6("ret").alias("ret"), r6("adv").alias("adv"))


@query(f"""WITH RECURSIVE {TOK}, {_NUM}, f AS (SELECT seq, rn, n, reward AS y FROM num WHERE rn = 1 UNION ALL SELECT b.seq, b.rn, b.n, b.reward + 0.9e0 * f.y FROM f JOIN num b ON b.seq = f.seq AND b.rn = f.rn + 1)
SELECT seq, CAST(n - rn AS INTEGER) AS pos, round(y, 6) + 0.0 AS y FROM f""")
def discounted_reverse_sum(spark: SparkSession, d: str) -> DataFrame:
    p = A.pack(tokens(spark, d), "seq", ORDER, ["reward"]).withColumn("y", A.discounted(F.transform("tokens", lambda t: t["reward"]), 0.9))
    return p.select("seq", F.posexplode("y").alias("pos", "y")).withColumn("y", r6("y"))


_BUCKET = "CASE WHEN exp(lp) <= 0.2e0 THEN 0 WHEN exp(lp) <= 0.4e0 THEN 1 WHEN exp(lp) <= 0.6e0 THEN 2 WHEN exp(lp) <= 0.8e0 THEN 3 ELSE 4 END"


@query(f"WITH {TOK} SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(exp(lp - old_lp)), 6) AS ratio_mean, round(max(exp(lp - old_lp)), 6) AS ratio_max, round(min(exp(lp - old_lp)), 6) AS ratio_min FROM tok WHERE mask = 1 AND (exp(lp - old_lp) > 1.2e0 OR exp(lp - old_lp) < 0.8e0) GROUP BY 1")
def clip_bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    r = F.exp(F.col("lp") - F.col("old_lp"))
    t = tokens(spark, d).withColumn("r", r).where((F.col("mask") == 1) & ((F.col("r") > 1.2) | (F.col("r") < 0.8)))
    return t.groupBy(G.probability_bucket(F.exp("lp")).alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("r")).alias("ratio_mean"), r6(F.max("r")).alias("ratio_max"), r6(F.min("r")).alias("ratio_min"))


_UPM, _DNM = "(mask = 1 AND adv > 0)", "(mask = 1 AND adv < 0)"


@query("WITH " + TOK + " SELECT " + ", ".join(f"round(coalesce({f}(CASE WHEN {m} THEN lp END), 0e0), 6) + 0.0 AS lp_{n}_{s}" for n, m in (("up", _UPM), ("down", _DNM), ("total", f"({_UPM} OR {_DNM})")) for s, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + " FROM tok")
def directional_triplets(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    on = F.col("mask") == 1
    names = [f"lp_{n}_{s}" for n in ("up", "down", "total") for s in ("mean", "max", "min")]
    return t.agg(*G.directional(F.col("lp"), on & (F.col("adv") > 0), on & (F.col("adv") < 0), "lp")).select(*[r6(n).alias(n) for n in names])


@query(f"WITH {TOK} SELECT round(corr(exp(lp), exp(old_lp)), 6) AS corr, count(*) FILTER (WHERE lp <> old_lp) AS differing, round(-sum(lp * value) / sum(value), 6) AS mean_nll FROM tok WHERE mask = 1")
def probability_agreement(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).where("mask = 1")
    return t.agg(r6(F.corr(F.exp("lp"), F.exp("old_lp"))).alias("corr"), F.count_if(F.col("lp") != F.col("old_lp")).alias("differing"), r6(-F.sum(F.col("lp") * F.col("value")) / F.sum("value")).alias("mean_nll"))


@query(f"WITH {TOK} SELECT round(avg(old_lp - lp), 6) AS kl_v1, round(0.5e0 * avg((old_lp - lp) ^ 2), 6) AS kl_v2, round(-avg(lp), 6) AS entropy FROM tok WHERE mask = 1")
def kl_sample_train(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("old_lp") - F.col("lp")
    return tokens(spark, d).where("mask = 1").agg(r6(F.avg(x)).alias("kl_v1"), r6(0.5 * F.avg(x * x)).alias("kl_v2"), r6(-F.avg("lp")).alias("entropy"))


@query(f"WITH {TOK}, m AS (SELECT avg(lp - ref_lp) AS a FROM tok WHERE mask = 1) SELECT {KEYS_SQL}, round(adv + 0.1e0 * mask * (a - (lp - ref_lp)), 6) + 0.0 AS adv FROM tok, m")
def kl_advantage_adjust(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    m = t.where("mask = 1").agg(F.avg(F.col("lp") - F.col("ref_lp")).alias("a"))
    return t.crossJoin(F.broadcast(m)).select(*KEYS, r6(F.col("adv") + 0.1 * F.col("mask") * (F.col("a") - (F.col("lp") - F.col("ref_lp")))).alias("adv"))


@query(f"""WITH {TOK}, per AS (SELECT seq, sum(CASE WHEN mask = 1 THEN lp ELSE 0 END) AS s, sum(CASE WHEN mask = 1 THEN old_lp ELSE 0 END) AS o, avg(reward) AS r FROM tok GROUP BY seq)
SELECT round(avg((s - o - 0.5e0 * r) ^ 2), 6) AS loss FROM per""")
def sppo_loss(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mask")
    per = tokens(spark, d).groupBy("seq").agg(L.masked_sum(F.col("lp"), m).alias("s"), L.masked_sum(F.col("old_lp"), m).alias("o"), F.avg("reward").alias("r"))
    x = F.col("s") - F.col("o") - 0.5 * F.col("r")
    return per.agg(r6(F.avg(x * x)).alias("loss"))


_X = "(0.5e0 * ((lp - ref_lp) - (old_lp - ref_lp)))"


@query(f"WITH {TOK} SELECT {KEYS_SQL}, round(ln(1 + exp(-abs({_X}))) + greatest(-{_X}, 0e0), 6) + 0.0 AS loss, CASE WHEN lp - ref_lp > old_lp - ref_lp THEN 1e0 ELSE 0e0 END AS accuracy, round(0.5e0 * {_X}, 6) + 0.0 AS margin, round(((lp - old_lp) - 1e0) ^ 2, 6) + 0.0 AS ipo FROM tok")
def dpo_losses(spark: SparkSession, d: str) -> DataFrame:
    parts = L.dpo_loss(F.col("lp"), F.col("old_lp"), F.col("ref_lp"), F.col("ref_lp"), 0.5)
    ipo = L.preference_loss(F.col("lp"), F.col("old_lp"), F.col("ref_lp"), F.col("ref_lp"), 0.5, kind="ipo")
    return tokens(spark, d).select(*KEYS, r6(parts["loss"]).alias("loss"), parts["accuracy"].alias("accuracy"), r6(parts["margin"]).alias("margin"), r6(ipo).alias("ipo"))


@query("SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS lse, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE) * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS entropy, round(embedding[1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS logprob FROM embeddings")
def logits_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    lse, ent = L.log_softmax_stats(F.col("x"))
    return e.select("vec_id", r6(lse).alias("lse"), r6(ent).alias("entropy"), r6(F.element_at("x", 1) - lse).alias("logprob"))


@query(f"WITH {TOK}, s AS (SELECT seq, count(*) AS n FROM tok GROUP BY seq) SELECT round(6.0e0 * 7e9 * sum(n) + 12.0e0 * 28 * 3584 * sum(n * n), 0) / 1e12 AS tflops FROM s")
def flops_estimate(spark: SparkSession, d: str) -> DataFrame:
    s = tokens(spark, d).groupBy("seq").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q")).select((F.round(L.flops(F.col("t"), F.col("q"), 7_000_000_000, 28, 3584), 0) / 1e12).alias("tflops"))


_TISW = "least(exp(least(greatest(old_lp - ref_lp, -20e0), 20e0)), 2e0)"
_BLO, _BHI = _band_sql(f"greatest(1 - 0.05e0 / {_P}, 0e0)", f"least(1 + 0.05e0 / {_P}, 1 / {_P})", "0.95e0")
_BPPO = f"CASE WHEN adv < 0 THEN least(-adv * 3e0, greatest(-adv * {_R}, -adv * least(greatest({_R}, {_BLO}), {_BHI}))) ELSE greatest(-adv * {_R}, -adv * least(greatest({_R}, {_BLO}), {_BHI})) END"


@query(f"WITH {TOK} SELECT {KEYS_SQL}, round({_BPPO} * {_TISW}, 5) + 0.0 AS loss FROM tok")
def bounded_policy_loss(spark: SparkSession, d: str) -> DataFrame:
    """Policy loss under the TV band with truncated importance weights."""
    lo, hi = B.band(F.col("old_lp"), "bandtv")
    loss = L.bounded_policy_loss(F.col("lp"), F.col("old_lp"), F.col("adv"), lo, hi, F.col("ref_lp"))
    return tokens(spark, d).select(*KEYS, (F.round(loss, 5) + 0.0).alias("loss"))


@query(f"""WITH {TOK}, t AS (SELECT tok.*, o_custkey AS g, CASE WHEN o_totalprice > 150000 THEN 1e0 ELSE 0e0 END AS acc, row_number() OVER (PARTITION BY seq, mask ORDER BY pos DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC, t5 DESC) = 1 AND mask = 1 AS is_last FROM tok JOIN orders ON o_orderkey = seq),
per AS (SELECT g, seq, coalesce(avg(CASE WHEN mask = 1 THEN reward END), 0e0) AS m, any_value(acc) AS c FROM t GROUP BY 1, 2), gr AS (SELECT g, count(*) AS n, sum(m) AS sm, sum(c) AS sc FROM per GROUP BY 1),
v AS (SELECT t.*, mask * (CASE WHEN n > 1 THEN reward * n / (n - 1) - sm / (n - 1) ELSE reward END + CASE WHEN is_last THEN CASE WHEN n > 1 THEN acc * n / (n - 1) - sc / (n - 1) ELSE acc END ELSE 0e0 END) AS v FROM t JOIN gr USING (g)),
r AS (SELECT *, sum(v) OVER (PARTITION BY seq ORDER BY pos, t1, t2, t3, t4, t5 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM v),
m AS (SELECT sum(mask) AS k, sum(ret * mask) / (sum(mask) + 1e-8) AS mean FROM r), w AS (SELECT mean, (SELECT sum(mask * (ret - mean) ^ 2) FROM r) / (k + 1e-8) * k / (k - 1) AS var FROM m)
SELECT {KEYS_SQL}, round(ret, 5) + 0.0 AS ret, round((ret - mean) / sqrt(var + 1e-8), 5) + 0.0 AS adv FROM r, w""")
def prime_rloo(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("g"), F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("acc"))
    t = A.prime_rloo(tokens(spark, d).drop("adv").join(o, "seq"), "g", "seq", ORDER, "reward", "mask", "acc")
    return t.select(*KEYS, (F.round("ret", 5) + 0.0).alias("ret"), (F.round("adv", 5) + 0.0).alias("adv"))
