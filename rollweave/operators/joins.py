"""Key-set operations and pair operators. Catalyst picks the join strategy from sizes; nothing is broadcast by hint
unless its size is bounded by construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.operators.batch import with_index


def a_minus_b(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is not in b; rows with a null key stay. Only b's distinct keys are moved."""
    return a.join(b.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def int_key(c: str) -> Column:
    """The key as an integer; text that is no integer gives null."""
    return F.expr(f"try_cast(trim(cast(`{c}` as string)) as bigint)")


def a_and_b(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose integer key is in b; bad and null keys match nothing, repeated rows stay."""
    keys = b.select(int_key(key).alias("_k")).where("_k is not null").distinct()
    return a.withColumn("_k", int_key(key)).join(keys, "_k", "left_semi").drop("_k")


def b_minus_a(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of b with a valid integer key that is not in a."""
    keys = a.select(int_key(key).alias("_k")).where("_k is not null").distinct()
    return b.withColumn("_k", int_key(key)).where("_k is not null").join(keys, "_k", "left_anti").drop("_k")


def decontaminate(train: DataFrame, test: DataFrame, train_text: str, test_text: str) -> DataFrame:
    """Training rows whose exact text does not occur in the test set; null texts stay."""
    t = test.select(F.col(test_text).alias(train_text)).where(F.col(train_text).isNotNull()).distinct()
    return train.join(t, train_text, "left_anti")


def attach_metrics(samples: DataFrame, metrics: DataFrame, key: str, order: str, ints: Sequence[str]) -> DataFrame:
    """Left join of the last metrics row per key; integer metrics default to 0."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", order)
    return samples.join(last, key, "left").fillna(0, list(ints))


def pairs_within(df: DataFrame, group: str, order: str, cols: Sequence[str], salts: int = 8) -> DataFrame:
    """All pairs i < j of a group, as columns a_* and b_*: for groups of a bounded size, such as the samples of a prompt.

    The left side is salted and the right side copied to each salt, so the pairs of a large group spread over tasks.
    """
    a = df.select(group, *[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([order, *cols])]).withColumn("_s", F.pmod(F.hash(f"a_{order}"), F.lit(salts)))
    b = df.select(F.col(group).alias("_g"), *[F.col(c).alias(f"b_{c}") for c in dict.fromkeys([order, *cols])]).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, (F.col(group) == F.col("_g")) & (F.col("_s") == F.col("_t")) & (F.col(f"a_{order}") < F.col(f"b_{order}"))).drop("_g", "_s", "_t")


def concordance(df: DataFrame, group: str, order: str, score: str, truth: str) -> DataFrame:
    """One row: mean over groups of the share of pairs that score and truth order alike, weighted by the truths' distance.

    A pair i < j counts as right where (score_i > score_j) = (truth_i > truth_j); groups without a difference of the truth
    count 0.5. Groups are the samples of one prompt.
    """
    p = pairs_within(df, group, order, [score, truth])
    ds, dt = F.col(f"a_{score}") - F.col(f"b_{score}"), F.col(f"a_{truth}") - F.col(f"b_{truth}")
    w = F.abs(dt)
    g = p.groupBy(group).agg(F.sum(w).alias("_w"), F.sum(F.when((ds > 0) == (dt > 0), w).otherwise(0.0)).alias("_r"))
    return g.agg(F.avg(F.when(F.col("_w") > 0, F.col("_r") / F.col("_w")).otherwise(0.5)).alias("concordance"))


def contrast_mean(df: DataFrame, group: str, acc: str, q: str, lower: bool = True) -> DataFrame:
    """Adds ``contrast``: the mean q of the group's rows with a lower (higher) acc, null where there is none.

    A running sum over the distinct acc values of the group, not a self-join.
    """
    per = df.groupBy(group, acc).agg(F.sum(q).alias("_s"), F.count(q).alias("_n"))
    w = Window.partitionBy(group).orderBy(F.col(acc) if lower else F.desc(acc)).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(group).alias("_g"), F.col(acc).alias("_a"), (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("contrast"))
    return df.join(per, (F.col(group) == F.col("_g")) & (F.col(acc) == F.col("_a")), "left").drop("_g", "_a")


def pair_winner(df: DataFrame, pair: Column, score: str, pos: str) -> DataFrame:
    """Adds ``winner``: the higher score of each pair; on a tie the first."""
    w = Window.partitionBy(pair).orderBy(F.desc(score), pos)
    return df.withColumn("winner", F.row_number().over(w) == 1)


def preference_rows(df: DataFrame, keep: Sequence[str], label: str, a: str, b: str) -> DataFrame:
    """Chosen and rejected row of each comparison: A chosen where the label is A, else B."""
    first = F.col(label) == "A"
    both = F.array(
        F.struct(F.lit("chosen").alias("role"), F.when(first, F.col(a)).otherwise(F.col(b)).alias("completion")),
        F.struct(F.lit("rejected").alias("role"), F.when(first, F.col(b)).otherwise(F.col(a)).alias("completion")),
    )
    return df.select(*keep, F.explode(both).alias("_x")).select(*keep, "_x.*")


def prob_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], lp_a: str, lp_b: str, mask: str) -> DataFrame:
    """One row comparing token probabilities of two sources joined by (seq, tok): mean, maximum and deviation of the difference, correlation."""
    j = a.join(b, list(keys)).where(F.col(mask) == 1)
    p, q = F.exp(lp_a), F.exp(lp_b)
    d = F.abs(p - q)
    return j.agg(F.avg(d).alias("diff_mean"), F.max(d).alias("diff_max"), F.stddev_samp(d).alias("diff_std"), F.corr(p, q).alias("corr"))


def positional(a: DataFrame, a_order: Sequence[str], b: DataFrame, b_order: Sequence[str], at: str = "_position") -> DataFrame:
    """The n-th row of ``a`` in its order beside the n-th of ``b`` in its own; rows beyond the end of the shorter table are
    left out. Positions are computed distributedly. Columns of equal names are to be renamed before."""
    return with_index(a, a_order, at).join(with_index(b, b_order, at), at).drop(at)
