"""Grouped statistics of rollouts and validation runs; all of them merge from partial aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.operators.sampling import group_name


def reduce_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: maximum where the name says max, minimum where it says min, else the mean."""
    return df.agg(*[(F.max if "max" in m else F.min if "min" in m else F.avg)(m).alias(m) for m in metrics])


def triplet(x: Column, mask: Column, prefix: str, default: float = 0.0) -> list[Column]:
    """Mean, maximum and minimum under a mask; ``default`` where it is empty."""
    v = F.when(mask, x)
    return [F.coalesce(f(v), F.lit(default)).alias(f"{prefix}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]


def directional(x: Column, up: Column, down: Column, prefix: str, default: float = 0.0) -> list[Column]:
    return [c for name, m in (("up", up), ("down", down), ("total", up | down)) for c in triplet(x, m, f"{prefix}_{name}", default)]


def summary(cols: Mapping[str, Column]) -> list[Column]:
    return [f(c).alias(f"{n}_{k}") for n, c in cols.items() for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]


def explained_variance(ret: Column, value: Column) -> Column:
    return 1 - F.var_samp(ret - value) / (F.var_samp(ret) + 1e-5)


def probability_bucket(p: Column, bounds: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> Column:
    """Bucket 0, 1, ...; a probability equal to a bound stays in the lower bucket."""
    out = F.lit(len(bounds))
    for k, b in reversed(list(enumerate(bounds))):
        out = F.when(p <= b, k).otherwise(out)
    return out


def per_step(df: DataFrame, step: str, value: str) -> DataFrame:
    """Median, sum and mean of the finite values of each step."""
    v = F.col(value).cast("double")
    ok = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return ok.groupBy(step).agg(F.median(v).alias("median"), F.sum(v).alias("sum"), F.avg(v).alias("mean"))


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group_name(group).alias("grp")).agg(F.count("*").alias("n"))


def majority(df: DataFrame, group: str, vote: str, value: str, pos: str) -> DataFrame:
    """(group, value): the value of the first row that holds the most frequent vote; among equals the vote seen first."""
    votes = df.groupBy(group, vote).agg(F.count("*").alias("n"), F.min(F.struct(pos, value)).alias("first"))
    best = votes.groupBy(group).agg(F.max_by("first", F.struct("n", -F.col(f"first.{pos}"))).alias("b"))
    return best.select(group, F.col(f"b.{value}").alias(value))


def pass_at_k(df: DataFrame, group: str, correct: str) -> DataFrame:
    """One row: share of groups with a correct row, share of correct rows, groups and rows (additive, so runs can be joined)."""
    g = df.groupBy(group).agg(F.max(correct).alias("any"), F.sum(correct).alias("right"), F.count("*").alias("n"))
    return g.agg(F.avg("any").alias("pass_at_k"), (F.sum("right") / F.sum("n")).alias("mean_at_k"), F.count("*").alias("groups"), F.sum("n").alias("rows"))


def group_mix(df: DataFrame, group: str, score: str, good: float = 0.5) -> DataFrame:
    """Shares of groups that are mixed, all good and all bad."""
    g = df.groupBy(group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return g.agg(F.avg(((F.col("lo") < good) & (F.col("hi") >= good)).cast("double")).alias("mixed"), F.avg((F.col("lo") >= good).cast("double")).alias("all_good"), F.avg((F.col("hi") < good).cast("double")).alias("all_bad"))


def by_tag(df: DataFrame, tags: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per tag (a row may hold several) and for all rows under the tag 'all'."""
    t = df.withColumn("tag", F.explode(F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.array(F.lit("all"))))))
    return t.groupBy("tag").agg(*aggs)


def map_mean(df: DataFrame, maps: str) -> DataFrame:
    """(key, mean) over the maps that hold the key."""
    return df.select(F.explode(maps).alias("key", "v")).groupBy("key").agg(F.avg("v").alias("mean"))


def language_stats(df: DataFrame, sample: str, lang: str, size: str, order: str) -> DataFrame:
    """Per sample: entropy (natural logarithm) of the languages' shares by size, languages above a tenth, and changes between neighbours."""
    w = Window.partitionBy(sample).orderBy(order)
    d = df.withColumn("_sw", (F.lag(lang).over(w) != F.col(lang)).cast("int"))
    per = d.groupBy(sample, lang).agg(F.sum(size).alias("_c"), F.sum("_sw").alias("_sw"))
    tot = F.sum("_c").over(Window.partitionBy(sample))
    p = F.col("_c") / tot
    return per.withColumn("_p", p).groupBy(sample).agg((-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p")).otherwise(0.0))).alias("entropy"), F.count_if(F.col("_p") > 0.1).alias("major"), F.coalesce(F.sum("_sw"), F.lit(0)).alias("switches"))


def ladder(n: int) -> list[int]:
    """2, 4, 8, ... and n itself."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def prompt_moments(df: DataFrame, source: str, uid: str, score: str) -> DataFrame:
    """(source, metric, value): mean@N and, of N above 1, std@N (population) of each prompt, averaged over the prompts of the
    source with N scores. Null and NaN scores are left out. On the JVM."""
    per = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(source, uid).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("n"))
    made = F.array(*[F.struct(F.concat(F.lit(f"{m}@"), F.col("n").cast("string")).alias("metric"), F.when(F.lit(m == "mean") | (F.col("n") > 1), F.col(m)).alias("value")) for m in ("mean", "std")])
    rows = per.select(source, F.explode(made).alias("x")).select(source, "x.metric", "x.value").where("value is not null")
    return rows.groupBy(source, "metric").agg(F.avg("value").alias("value"))


def _votes(codes: np.ndarray) -> np.ndarray:
    """In rows of vote codes, the place of the first vote for what got most votes."""
    k = codes.shape[-1]
    if k <= 16:
        return (codes[..., :, None] == codes[..., None, :]).sum(-1).argmax(-1)
    flat = codes.reshape(-1, k)
    out = np.empty(len(flat), int)
    for i, row in enumerate(flat):
        out[i] = np.bincount(row)[row].argmax()
    return out.reshape(codes.shape[:-1])


def _resampled(v: np.ndarray, codes: np.ndarray, draws: int, seed: int) -> list[tuple[str, np.ndarray]]:
    """Best, worst and majority of prompts with equally many scores (rows of ``v``): mean and deviation over the draws, which
    are the same for every prompt as the generator is seeded anew for each."""
    out, n = [], v.shape[1]
    for k in ladder(n):
        picks = np.random.RandomState(seed).randint(0, n, size=(draws, k))
        x = v[:, picks]
        maj = np.take_along_axis(x, _votes(codes[:, picks])[..., None], -1)[..., 0]
        for name, y in (("best", x.max(-1)), ("worst", x.min(-1)), ("maj", maj)):
            out += [(f"{name}@{k}/mean", y.mean(1)), (f"{name}@{k}/std", y.std(1))]
    return out


def validation_metrics(df: DataFrame, source: str, uid: str, score: str, vote: str, order: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(source, metric, value): mean@N and std@N per prompt, then best, worst and majority at 2, 4, ..., N by bootstrap,
    each averaged over the prompts of the source. Rows with a null or NaN score are left out.

    A prompt group holds the repeats of one prompt, so it fits a task. Groups stream through sorted partitions and are
    resampled together where they have as many scores, in blocks of bounded memory.
    """
    types = dict(df.dtypes)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple]] = {}

        def resample(n: int) -> pd.DataFrame:
            groups = waiting.pop(n)
            made = _resampled(np.array([g[1] for g in groups]), np.array([g[2] for g in groups]), draws, seed)
            return pd.DataFrame([(g[0], m, x) for m, xs in made for g, x in zip(groups, xs.tolist())], columns=[source, "metric", "value"])

        def groups() -> Iterator[pd.DataFrame]:
            rest = None
            for pdf in batches:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                key = pd.factorize(pd.Series(list(zip(pdf[source], pdf[uid]))))[0]
                cuts = np.flatnonzero(np.diff(key)) + 1
                for a, b in zip([0, *cuts[:-1]], cuts):
                    yield pdf.iloc[a:b]
                rest = pdf.iloc[cuts[-1] if len(cuts) else 0 :]
            if rest is not None and len(rest):
                yield rest

        for g in groups():
            n = len(g)
            if n > 1:
                waiting.setdefault(n, []).append((g[source].iloc[0], g[score].to_numpy(dtype=float), pd.factorize(g[vote], use_na_sentinel=False)[0]))
                if len(waiting[n]) * n * draws * min(n, 16) >= 4_000_000:
                    yield resample(n)
        for n in list(waiting):
            yield resample(n)

    ok = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(source, uid, score, vote, order)
    drawn = ok.repartition(source, uid).sortWithinPartitions(source, uid, order).mapInPandas(run, f"`{source}` {types[source]}, metric string, value double")
    return drawn.groupBy(source, "metric").agg(F.avg("value").alias("value")).unionByName(prompt_moments(df, source, uid, score))


def bootstrap(values: np.ndarray, size: int, reducers: Mapping[str, object], draws: int = 1000, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each reducer over ``draws`` resamples of ``size``; an empty sample raises."""
    if not len(values):
        raise ValueError("nothing to resample")
    x = np.asarray(values)[np.random.RandomState(seed).randint(0, len(values), size=(draws, size))]
    return {n: (float(np.mean(r)), float(np.std(r))) for n, f in reducers.items() for r in [np.apply_along_axis(f, 1, x)]}
