"""Token losses, penalties and masked statistics as Column builders and aggregates.

A token row has a log-probability ``lp``, its old one ``old_lp``, an advantage and a mask in {0, 1}. Masked sums
replace what lies outside the mask by 0 before adding, so NaN there cannot leak; means divide by the mask's sum
plus 1e-8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.functions.bounds import clamp

GUARD = 1e-8


def inside(x: Column, mask: Column) -> Column:
    return F.when(mask == 1, x).otherwise(0.0)


def masked_sum(x: Column, mask: Column) -> Column:
    return F.sum(inside(x, mask))


def masked_mean(x: Column, mask: Column) -> Column:
    return masked_sum(x, mask) / (F.sum(mask) + GUARD)


def masked_moments(df: DataFrame, x: str, mask: str) -> DataFrame:
    """One row: mean and Bessel-corrected variance over the mask, by one pass of sums that merge across partitions.

    Raises where the mask covers fewer than two rows, as the variance is undefined there.
    """
    m, v = F.col(mask), F.col(x)
    n = F.sum(m)
    s = df.agg(n.alias("n"), masked_sum(v, m).alias("s1"), masked_sum(v * v, m).alias("s2"))
    mean = F.col("s1") / (F.col("n") + GUARD)
    var = (F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("n")) / (F.col("n") + GUARD) * F.col("n") / (F.col("n") - 1)
    checked = F.when(F.col("n") > 1, var).otherwise(F.raise_error(F.lit("the mask covers fewer than two rows")).cast("double"))
    return s.select("n", mean.alias("mean"), checked.alias("var"))


def whiten(df: DataFrame, x: str, mask: str, out: str, shift: bool = True) -> DataFrame:
    """Adds (x - mean) / sqrt(var + 1e-8); with ``shift`` off the mean is added back. The one-row moments are broadcast."""
    m = masked_moments(df, x, mask).select(F.col("mean").alias("_whiten_mean"), F.col("var").alias("_whiten_var"))
    j = df.crossJoin(F.broadcast(m))
    w = (F.col(x) - F.col("_whiten_mean")) / F.sqrt(F.col("_whiten_var") + GUARD)
    return j.withColumn(out, w if shift else w + F.col("_whiten_mean")).drop("_whiten_mean", "_whiten_var")


def kl(lp: Column, ref: Column, kind: str) -> Column:
    """KL estimators: k1 (difference), abs, k2 (half square), k3 (low variance; exponent clamped to 20, value to 10)."""
    d = lp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = clamp(-d, -20.0, 20.0)
        return clamp(F.exp(x) - x - 1, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind!r}")


def kl_reward(score: Column, old_lp: Column, ref_lp: Column, ratio: float) -> Column:
    return score - (old_lp - ref_lp) * ratio


def kl_coefficient(now: float, kl_mean: float, n_steps: int, target: float, horizon: float) -> float:
    """Adaptive controller: the error is clipped to 20 % either way."""
    return now * (1 + min(max(kl_mean / target - 1, -0.2), 0.2) * n_steps / horizon)


def ratio(lp: Column, old_lp: Column) -> Column:
    return F.exp(clamp(lp - old_lp, -20.0, 20.0))


def clipped_surrogate(lp: Column, old_lp: Column, adv: Column, low: float | Column = 0.2, high: float | Column = 0.2, dual: float = 3.0) -> dict[str, Column]:
    """Dual-clip surrogate: loss, whether the upper clip and the dual clip were active, and the log ratio.

    ``low`` and ``high`` are widths around 1, or Columns with the bounds themselves.
    """
    r = ratio(lp, old_lp)
    lo = low if isinstance(low, Column) else F.lit(1.0 - low)
    hi = high if isinstance(high, Column) else F.lit(1.0 + high)
    plain, cut = -adv * r, -adv * F.least(F.greatest(r, lo), hi)
    worst = F.greatest(plain, cut)
    dualled = F.least(-adv * dual, worst)
    return {
        "loss": F.when(adv < 0, dualled).otherwise(worst),
        "clipped": (cut > plain).cast("double"),
        "dual_clipped": ((worst > -adv * dual) & (adv < 0)).cast("double"),
        "kl": old_lp - lp,
    }


def value_loss(pred: Column, ret: Column, old: Column, width: float) -> Column:
    """Half the larger of the squared errors of the value and of the value clipped around the old one."""
    cut = F.least(F.greatest(pred, old - width), old + width)
    return 0.5 * F.greatest((pred - ret) * (pred - ret), (cut - ret) * (cut - ret))


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(df: DataFrame, seq: str, loss: str, mask: str, mode: str, horizon: int | None = None) -> DataFrame:
    """One row with the loss over tokens: over all tokens, or per sequence first. ``horizon`` is the padded length that
    seq-mean-token-sum-norm divides by (the longest sequence where it is not given)."""
    x, m = F.col(loss), F.col(mask)
    if mode == "token-mean":
        return df.agg(masked_mean(x, m).alias("loss"))
    per = df.groupBy(seq).agg(masked_sum(x, m).alias("s"), F.sum(m).alias("n"), F.count("*").alias("len"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.col("s") / (F.col("n") + GUARD)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("s") / (F.lit(horizon) if horizon else F.max("len"))).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}; known: {LOSS_MODES}")


def sequence_ratio(df: DataFrame, seq: str, lp: str, old_lp: str, mask: str, out: str) -> DataFrame:
    """Adds exp of the sequence's mean log ratio, at most exp(10): one ratio for all tokens of a sequence."""
    w = Window.partitionBy(seq)
    m = F.col(mask)
    mean = F.sum(inside(F.col(lp) - F.col(old_lp), m)).over(w) / F.greatest(F.sum(m).over(w), F.lit(1))
    return df.withColumn(out, F.exp(clamp(mean, hi=10.0)))


def geometric_mean_loss(df: DataFrame, seq: str, lp: str, old_lp: str, adv: str, mask: str, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """One row: mean over sequences of -A times the geometric mean of token ratios, each clipped on the side where it could grow the objective."""
    m, s = F.col(mask), F.signum(adv)
    d = F.col(lp) - F.col(old_lp)
    clipped = s * F.least(s * d, s * clamp(d, -low, high))
    per = df.groupBy(seq).agg((F.exp(F.sum(inside(clipped, m)) / (F.sum(m) + GUARD))).alias("r"), (F.sum(inside(F.col(adv), m)) / (F.sum(m) + GUARD)).alias("a"))
    return per.agg(F.avg(-F.col("a") * F.col("r")).alias("loss"))


def covariance(df: DataFrame, lp: str, adv: str, mask: str, out: str) -> DataFrame:
    """Adds (A - mean A)(lp - mean lp), means over the masked tokens; the one-row means are broadcast."""
    m = F.col(mask)
    means = df.agg(masked_mean(F.col(adv), m).alias("_a"), masked_mean(F.col(lp), m).alias("_l"))
    return df.crossJoin(F.broadcast(means)).withColumn(out, (F.col(adv) - F.col("_a")) * (F.col(lp) - F.col("_l"))).drop("_a", "_l")


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> dict[str, Column]:
    """-log sigmoid of the scaled log-ratio difference; accuracy; margin (scaled twice, as the reference result is)."""
    c, r = chosen - ref_chosen, rejected - ref_rejected
    x = beta * (c - r)
    return {"loss": F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)), "accuracy": (c > r).cast("double"), "margin": beta * x}


def ce_dpo_loss(score: Column, acc: Column, beta: float) -> Column:
    """Binary cross-entropy of sigmoid(beta * score) against the accuracy."""
    x = beta * score
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)) - x * acc


def bounded_policy_loss(lp: Column, old_lp: Column, adv: Column, low: Column, high: Column, rollout_lp: Column | None = None, most_weight: float = 2.0, dual: float = 3.0) -> Column:
    """Dual-clip surrogate under token-wise bounds, weighted by the truncated ratio of trainer and rollout probabilities."""
    loss = clipped_surrogate(lp, old_lp, adv, low, high, dual)["loss"]
    return loss if rollout_lp is None else loss * clamp(F.exp(clamp(old_lp - rollout_lp, -20.0, 20.0)), hi=most_weight)


def preference_loss(pi_c: Column, pi_r: Column, ref_c: Column, ref_r: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    x = (pi_c - pi_r) - (ref_c - ref_r)
    if kind == "ipo":
        return (x - 1 / (2 * beta)) * (x - 1 / (2 * beta))

    def nls(z: Column) -> Column:
        return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))

    return (1 - smoothing) * nls(beta * x) + smoothing * nls(-beta * x)


def log_softmax_stats(logits: Column) -> tuple[Column, Column]:
    """Log-sum-exp and entropy of an array of logits, shifted by the maximum."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    lse = top + F.log(z)
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - lse) * x)
    return lse, lse - mean


#: Policy losses by name: function of (lp, old_lp, adv) that gives the token loss.
POLICY_LOSSES: dict[str, Callable[..., Column]] = {}


def register_policy_loss(name: str) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in POLICY_LOSSES:
            raise ValueError(f"policy loss {name!r} is registered already")
        POLICY_LOSSES[name] = f
        return f

    return add


@register_policy_loss("vanilla")
def _vanilla(lp: Column, old_lp: Column, adv: Column, **options: float) -> Column:
    return clipped_surrogate(lp, old_lp, adv, **options)["loss"]


@register_policy_loss("gpg")
def _gpg(lp: Column, old_lp: Column, adv: Column, **_: float) -> Column:
    return -lp * adv


def flops(tokens: Column, tokens_sq: Column, params: int, layers: int, attention_dim: int) -> Column:
    """Estimated training FLOPs: 6 per dense parameter and token, 12 per layer and attention dimension for the squared lengths."""
    return 6.0 * params * tokens + 12.0 * layers * attention_dim * tokens_sq
