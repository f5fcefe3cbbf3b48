"""Redundancy of a sample's sentences from their embeddings (normalised, so that the dot product is the cosine)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("r_dup", "cluster_count", "cluster_size_max", "rho_max", "loopiness", "plateau_len_max")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def components(adjacent: np.ndarray) -> np.ndarray:
    """Component label of each node by propagating minima until nothing changes."""
    label = np.arange(len(adjacent))
    linked = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        if (new == label).all():
            return label
        label = new


def metrics(emb: np.ndarray, dup: float = 0.9, cluster: float = 0.85, eps: float = 1e-4) -> tuple[float, ...]:
    """The six measures of an ordered set of vectors: NaN without any, (0, 1, 1, 1, 1, 1) for one."""
    m = len(emb)
    if m == 0:
        return (float("nan"),) * 6
    if m == 1:
        return (0.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    g = emb @ emb.T
    off = ~np.eye(m, dtype=bool)
    label = components((g >= cluster) & off)
    sizes = np.bincount(label)
    angle = np.arccos(np.clip((emb[:-1] * emb[1:]).sum(1), -1, 1)).sum()
    ends = np.arccos(np.clip(emb[0] @ emb[-1], -1, 1))
    edges = np.flatnonzero(np.diff(label) != 0)
    runs = np.diff(np.concatenate(([-1], edges, [m - 1])))
    return (
        float((np.where(off, g, -1).max(1) >= dup).mean()), float((sizes > 0).sum()), float(sizes.max()), float(sizes.max() / m),
        float(angle / (ends + eps)), float(runs.max()),
    )


def spread(n: int, most: int) -> np.ndarray:
    """Positions of at most ``most`` evenly spread rows."""
    return np.arange(n) if n <= most else np.unique(np.linspace(0, n - 1, most).astype(int))


def sample_metrics(df: DataFrame, sample: str, order: list[str], emb: str, masks: dict[str, str | None], most: int = 128, dup: float = 0.9, cluster: float = 0.85) -> DataFrame:
    """Six measures per sample and mask (name -> boolean column, or None for all sentences).

    At most ``most`` evenly spread sentences of a sample enter the Gram matrix: that is the operator's definition and
    bounds a task. One shuffle on the sample. Null embeddings are left out.
    """
    types = dict(df.dtypes)
    flags = [c for c in masks.values() if c]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").iloc[spread(len(pdf), most)]
        x = np.stack(pdf[emb].to_numpy()).astype(float)
        row = {sample: pdf[sample].iloc[0]}
        for name, c in masks.items():
            keep = np.ones(len(x), dtype=bool) if c is None else pdf[c].fillna(False).to_numpy(dtype=bool)
            row |= {f"{name}_{k}": v for k, v in zip(METRICS, metrics(x[keep], dup, cluster))}
        return pd.DataFrame([row])

    ddl = f"`{sample}` {types[sample]}, " + ", ".join(f"`{n}_{k}` double" for n in masks for k in METRICS)
    cols = list(dict.fromkeys([sample, *order, emb, *flags]))
    return df.where(F.col(emb).isNotNull()).select(*cols).groupBy(sample).applyInPandas(run, ddl)


def loopiness(df: DataFrame, sample: str, order: str, emb: str, eps: float = 1e-4) -> DataFrame:
    """Sum of the angles between neighbours over the angle between the ends: windows and one aggregate, no Python."""
    w = Window.partitionBy(sample).orderBy(order)
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    d = df.withColumn("_p", F.lag(emb).over(w)).withColumn("_a", F.when(F.col("_p").isNotNull(), F.acos(clip(dot(F.col("_p"), F.col(emb))))))
    g = d.groupBy(sample).agg(F.sum("_a").alias("len"), F.min_by(emb, order).alias("first"), F.max_by(emb, order).alias("last"), F.count("*").alias("n"))
    ends = F.acos(clip(dot(F.col("first"), F.col("last"))))
    return g.select(sample, F.when(F.col("n") > 1, F.col("len") / (ends + eps)).otherwise(1.0).alias("loopiness"))


def plateau(df: DataFrame, sample: str, order: str, cluster: str) -> DataFrame:
    """Longest run of one cluster in order: gaps and islands."""
    w = Window.partitionBy(sample).orderBy(order)
    d = df.withColumn("_n", F.coalesce((F.lag(cluster).over(w) != F.col(cluster)).cast("int"), F.lit(1))).withColumn("_i", F.sum("_n").over(w))
    return d.groupBy(sample, "_i").agg(F.count("*").alias("c")).groupBy(sample).agg(F.max("c").alias("plateau"))


def rambling_score(r_self: Column, r_dup: Column, loop: Column, plateau_len: Column, entropy: Column, weights: tuple[float, float, float, float, float] = (0.3, 0.3, 0.2, 0.1, 0.1), loop_cap: float = 50.0, plateau_k: float = 10.0) -> Column:
    """Weighted sum of the measures, loops capped and scaled, plateaus as a flag; NaN where self-reflection or duplication is NaN, other NaN as 0."""
    zero = lambda c: F.nanvl(c, F.lit(0.0))
    parts = (r_self, r_dup, F.least(zero(loop), F.lit(loop_cap)) / loop_cap, (zero(plateau_len) >= plateau_k).cast("double"), zero(entropy))
    total = parts[0] * weights[0]
    for p, w in zip(parts[1:], weights[1:]):
        total = total + p * w
    return F.when(F.isnan(r_self) | F.isnan(r_dup), float("nan")).otherwise(total)
