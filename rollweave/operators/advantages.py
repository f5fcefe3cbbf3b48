"""Advantage estimators: grouped analytics over sequences (one row per sequence) and folds over tokens.

Group statistics are partial aggregates that are joined back, so a group may hold any share of the rows. Groups of one are
treated as the estimator defines them, not by the null that a sample deviation of one row gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.functions.arrays import scan
from rollweave.functions.losses import whiten

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Registers an estimator (DataFrame -> DataFrame with column ``adv``); a name can be taken once."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ESTIMATORS:
            raise ValueError(f"estimator {name!r} is registered already")
        ESTIMATORS[name] = f
        return f

    return add


def compute_advantage(df: DataFrame, estimator: str, **options: object) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **options)


def with_group(df: DataFrame, group: str, **stats: Column) -> DataFrame:
    """Adds aggregates of each group to its rows; rows of a null group form one group.

    Partial aggregates are joined back, so a group that holds a large part of the rows is never gathered in one task: its
    rows are spread by the aggregation's map side and by the skew join, or not shuffled at all where the groups are few.
    """
    per = df.groupBy(group).agg(*[c.alias(n) for n, c in stats.items()]).withColumnRenamed(group, "_group")
    return df.join(per, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def _moments(df: DataFrame, group: str, score: str) -> DataFrame:
    return with_group(df, group, _mean=F.avg(score), _std=F.stddev_samp(score), _n=F.count("*"))


def _done(df: DataFrame, adv: Column) -> DataFrame:
    return df.withColumn("adv", adv).drop("_mean", "_std", "_n")


@register("grpo")
def grpo(df: DataFrame, group: str, score: str, eps: float = EPS, by_std: bool = True) -> DataFrame:
    """(s - mean) / (std + eps); a group of one has mean 0 and std 1."""
    one = F.col("_n") == 1
    x = F.col(score) - F.when(one, 0.0).otherwise(F.col("_mean"))
    return _done(_moments(df, group, score), x / (F.when(one, 1.0).otherwise(F.col("_std")) + eps) if by_std else x)


@register("grpo_passk")
def grpo_passk(df: DataFrame, group: str, score: str, order: str, eps: float = EPS, by_std: bool = True) -> DataFrame:
    """The best row of a group gets its lead over the second (over std), all others 0; groups of one raise. Of equal scores
    the row first in ``order``, which tells the rows of a group apart, is the best.

    The two best rows are found before the shuffle (a limit per group), the deviation by partial aggregates.
    """
    ranked = df.select(group, score, order).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))).where("_r <= 2")
    best = ranked.groupBy(group).agg(F.max(F.when(F.col("_r") == 1, F.col(score))).alias("_first"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_second"), F.max(F.when(F.col("_r") == 1, F.col(order))).alias("_best"))
    best = best.withColumnRenamed(group, "_group")
    d = _moments(df, group, score).join(best, F.col(group).eqNullSafe(F.col("_group")), "left")
    lead = F.col("_first") - F.col("_second")
    lead = lead / (F.col("_std") + eps) if by_std else lead
    small = F.raise_error(F.lit("a group has fewer than two rows")).cast("double")
    return _done(d, F.when(F.col("_n") < 2, small).when(F.col(order) == F.col("_best"), lead).otherwise(0.0)).drop("_group", "_first", "_second", "_best")


@register("rloo")
def rloo(df: DataFrame, group: str, score: str) -> DataFrame:
    """n / (n - 1) (s - mean); a group of one keeps its score."""
    n = F.col("_n")
    return _done(_moments(df, group, score), F.when(n > 1, (F.col(score) - F.col("_mean")) * n / (n - 1)).otherwise(F.col(score)))


@register("opo")
def opo(df: DataFrame, group: str, score: str, length: str) -> DataFrame:
    """s less the length-weighted mean of the group, NaN where its lengths sum up to 0; a group of one keeps its score."""
    total = F.sum(length)
    mean = F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(F.col(length) * F.col(score)) / total)
    d = with_group(df, group, _mean=mean, _n=F.count("*"))
    return _done(d, F.col(score) - F.when(F.col("_n") > 1, F.col("_mean")).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, group: str, score: str, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm, alpha = rows over rows with a nonzero score; a group of one has mean 0."""
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    j = _moments(df, group, score).crossJoin(F.broadcast(alpha))
    return _done(j, F.col("_alpha") * (F.col(score) - F.when(F.col("_n") > 1, F.col("_mean")).otherwise(0.0)) / f_norm).drop("_alpha")


@register("reinforce_plus_plus_baseline")
def rfpp_baseline(df: DataFrame, group: str, score: str, mask: str) -> DataFrame:
    """s - mean of the group (0 for a group of one), whitened over the masked rows."""
    d = _moments(df, group, score).withColumn("_d", F.col(score) - F.when(F.col("_n") > 1, F.col("_mean")).otherwise(0.0))
    return whiten(d, "_d", mask, "adv").drop("_d", "_mean", "_std", "_n")


@register("group_centred")
def group_centred(df: DataFrame, group: str, score: str) -> DataFrame:
    return _done(_moments(df, group, score), F.col(score) - F.col("_mean"))


@register("remax")
def remax(df: DataFrame, seq: str, order: list[str], reward: str, mask: str, baseline: str) -> DataFrame:
    """Token rows: masked reward from here to the end of the sequence, less the baseline, inside the mask."""
    w = Window.partitionBy(seq).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    togo = F.sum(F.col(reward) * F.col(mask)).over(w)
    return df.withColumn("ret", togo).withColumn("adv", togo - F.col(baseline) * F.col(mask))


def pack(df: DataFrame, seq: str, order: list[str], cols: list[str]) -> DataFrame:
    """One row per sequence with its tokens as an ordered array of structs."""
    s = F.sort_array(F.collect_list(F.struct(*order, *[F.col(c) for c in cols if c not in order])))
    return df.groupBy(seq).agg(s.alias("tokens"))


def unpack(df: DataFrame, seq: str, arrays: dict[str, str]) -> DataFrame:
    """Token rows (seq, pos, one column per array) from parallel arrays."""
    z = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    return df.select(seq, F.posexplode(z).alias("pos", "z")).select(seq, "pos", *[F.col(f"z.{n}").alias(n) for n in arrays])


def discounted(values: Column, gamma: float) -> Column:
    """y_t = x_t + gamma y_(t+1) over an array, in order."""
    return F.reverse(scan(F.reverse(values), F.lit(0.0), lambda y, x: x + gamma * y))


@register("gae")
def gae(df: DataFrame, seq: str, order: list[str], reward: str, value: str, mask: str, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Token rows with ret and whitened adv; masked tokens pass the next value and the running sum through unchanged."""
    packed = pack(df, seq, order, [reward, value, mask])

    def step(s: Column, x: Column) -> Column:
        m = x[mask].cast("double")
        run = x[reward] + gamma * s["nv"] - x[value] + gamma * lam * s["run"]
        return F.struct((x[value] * m + (1 - m) * s["nv"]).cast("double").alias("nv"), (run * m + (1 - m) * s["run"]).cast("double").alias("run"))

    folded = packed.select(seq, "tokens", F.reverse(scan(F.reverse("tokens"), F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("run")), step, lambda s: s["run"])).alias("_a"))
    z = folded.select(seq, F.posexplode(F.arrays_zip("tokens", "_a")).alias("pos", "z"))
    tok = z.select(seq, "pos", *[F.col(f"z.tokens.{c}").alias(c) for c in (reward, value, mask)], F.col("z._a").alias("_a"))
    tok = tok.withColumn("ret", F.col("_a") + F.col(value))
    return whiten(tok, "_a", mask, "adv").drop("_a")


@register("reinforce_plus_plus")
def rfpp(df: DataFrame, seq: str, order: list[str], reward: str, mask: str, gamma: float = 1.0) -> DataFrame:
    """Token rows with the discounted return, reset after each masked token, and whitened adv (0 outside the mask)."""
    packed = pack(df, seq, order, [reward, mask])
    start = F.struct(F.lit(0.0).alias("ret"), F.lit(0.0).alias("go"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((x[reward] + gamma * s["ret"] * s["go"]).cast("double").alias("ret"), x[mask].cast("double").alias("go"))

    folded = packed.select(seq, "tokens", F.reverse(scan(F.reverse("tokens"), start, step, lambda s: s["ret"])).alias("_r"))
    z = folded.select(seq, F.posexplode(F.arrays_zip("tokens", "_r")).alias("pos", "z"))
    tok = z.select(seq, "pos", F.col(f"z.tokens.{reward}").alias(reward), F.col(f"z.tokens.{mask}").alias(mask), F.col("z._r").alias("ret"))
    w = whiten(tok, "ret", mask, "adv")
    return w.withColumn("adv", F.col("adv") * F.col(mask))


@register("prime_rloo")
def prime_rloo(df: DataFrame, group: str, seq: str, order: list[str], reward: str, mask: str, acc: str, model_weight: float = 1.0, truth_weight: float = 1.0) -> DataFrame:
    """Token rows with ret and whitened adv: leave-one-out over two reward sources, each centred on its own.

    Token rewards are centred by the group's sequence means, the accuracy, on the last masked token, by the group's
    accuracies; then the sum is accumulated from the end. A group of one keeps its rewards.
    """
    last = Window.partitionBy(seq).orderBy(*[F.desc(c) for c in order])
    t = df.withColumn("_last", (F.sum(mask).over(last.rowsBetween(Window.unboundedPreceding, 0)) == 1) & (F.col(mask) == 1))
    per = df.groupBy(group, seq).agg(F.coalesce(F.avg(F.when(F.col(mask) == 1, F.col(reward))), F.lit(0.0)).alias("_m"), F.first(acc).alias("_c"))
    g = per.groupBy(group).agg(F.count("*").alias("_n"), F.sum("_m").alias("_sm"), F.sum("_c").alias("_sc"))
    j = t.join(g, group)

    def centred(x: Column, total: Column) -> Column:
        n = F.col("_n")
        return F.when(n > 1, x * n / (n - 1) - total / (n - 1)).otherwise(x)

    value = model_weight * F.when(F.col(mask) == 1, centred(F.col(reward), F.col("_sm"))).otherwise(0.0) + truth_weight * F.when(F.col("_last"), centred(F.col(acc), F.col("_sc"))).otherwise(0.0)
    togo = Window.partitionBy(seq).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    out = j.withColumn("_v", value * F.col(mask)).withColumn("ret", F.sum("_v").over(togo))
    return whiten(out, "ret", mask, "adv").drop("_last", "_n", "_sm", "_sc", "_v")


def softmean(df: DataFrame, x: str, beta: float) -> DataFrame:
    """One row: (logsumexp(beta x) - log n) / beta, shifted by the maximum; the mean for beta 0."""
    if beta == 0:
        return df.agg(F.avg(x).alias("softmean"))
    top = df.agg(F.max(F.col(x) * beta).alias("_t"))
    z = df.crossJoin(F.broadcast(top)).agg(F.first("_t").alias("t"), F.sum(F.exp(F.col(x) * beta - F.col("_t"))).alias("z"), F.count(x).alias("n"))
    return z.select(((F.col("t") + F.log("z") - F.log("n")) / beta).alias("softmean"))


@register("sppo")
def sppo(df: DataFrame, score: str, beta: float = 1.0) -> DataFrame:
    return df.crossJoin(F.broadcast(softmean(df, score, beta))).withColumn("adv", F.col(score) - F.col("softmean")).drop("softmean")
