"""Sorting, sampling and partitioning. Random choices order by a seeded hash of a key, so they can be repeated and need no state."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.operators.batch import with_index

MISSING = "__MISSING__"
#: Rows whose weights one task sums up when resampling.
ROWS_PER_PART = 1_000_000


def group_name(c: str | Column) -> Column:
    """The group as a string, null as ``__MISSING__``."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(MISSING))


def arithmetic_key(c: str, seed: int = 0) -> Column:
    """A multiplicative hash that any SQL engine can compute: (id * 2654435761 + seed) mod 2^32."""
    return (F.col(c) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)


def seeded(c: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


def parse_order(spec: str) -> list[Column]:
    """'a:asc,b:desc' to sort columns; nulls last either way."""
    out = []
    for part in spec.split(","):
        name, _, way = part.strip().partition(":")
        out.append(F.col(name).desc_nulls_last() if way.strip().lower() == "desc" else F.col(name).asc_nulls_last())
    return out


def sort_limit(df: DataFrame, spec: str, tiebreak: Sequence[str], n: int | None = None) -> DataFrame:
    d = df.orderBy(*parse_order(spec), *tiebreak)
    return d.limit(n) if n is not None else d


def first_per(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First row of each key; rows with a null key form one group."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def limit_per(df: DataFrame, key: str, order: Sequence[str | Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def target_sizes(counts: DataFrame, n: str, share: float, rounding: str = "floor", least: int = 0, most: int | None = None) -> DataFrame:
    """Adds ``k``: floor, half-even round or ceil of n * share, within [least, most] and never above n."""
    x = F.col(n) * F.lit(share)
    k = {"floor": F.floor(x), "round": F.bround(x, 0), "ceil": F.ceil(x)}[rounding].cast("bigint")
    k = F.greatest(k, F.lit(least).cast("bigint"))
    if most is not None:
        k = F.least(k, F.lit(most).cast("bigint"))
    return counts.withColumn("k", F.least(k, F.col(n)))


def stratified(df: DataFrame, group: str, order: Column, tiebreak: str, share: float, rounding: str = "floor", least: int = 0, most: int | None = None) -> DataFrame:
    """A share of every group, the rows first in ``order``.

    Ranks come from distributed positions in the order (group, order, tiebreak) less the group's first position, so a group
    of any size is spread over range partitions.
    """
    d = with_index(df.withColumns({"_g": group_name(group), "_o": order}), ["_g", "_o", tiebreak], "_at")
    per = target_sizes(d.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "_n", share, rounding, least, most).withColumnRenamed("k", "_take")
    return d.join(per, "_g").where(F.col("_at") - F.col("_first") < F.col("_take")).drop("_g", "_o", "_at", "_n", "_first", "_take")


#: Up to so many rows a limit is a heap per task whose rest one task merges; above, positions are computed distributedly.
HEAP_ROWS = 10_000


def reservoir(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, each set of n equally likely over seeds: the first n by hash, as a distributed heap or by positions."""
    if n <= HEAP_ROWS:
        return df.orderBy(seeded(key, seed), key).limit(n)
    return with_index(df.withColumn("_h", seeded(key, seed)), ["_h", key], "_at").where(F.col("_at") < n).drop("_h", "_at")


def resample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement in proportion to ``weight`` (null, NaN and negative: 0): cumulative weights and a range join.

    Each draw is a number in [0, total) from its hash. Draws and cumulative intervals are cut into the same buckets, so the
    range condition is an equi-join; adds ``draw``. Weights are summed in parts of about ``ROWS_PER_PART`` rows.
    """
    w = F.when(F.coalesce(weight, F.lit(0.0)) > 0, F.nanvl(weight, F.lit(0.0))).otherwise(0.0)
    d = df.withColumn("_w", w.cast("double")).where("_w > 0")
    parts = max(64, df.count() // ROWS_PER_PART)
    salt = F.pmod(F.xxhash64(key), F.lit(parts))
    d = d.withColumn("_s", salt)
    per = d.groupBy("_s").agg(F.sum("_w").alias("_t"))
    before = per.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    cum = F.sum("_w").over(Window.partitionBy("_s").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    total = per.agg(F.sum("_t").alias("_total"))
    d = d.withColumn("_c", cum).join(F.broadcast(before.select("_s", "_b")), "_s").crossJoin(F.broadcast(total))
    hi = (F.col("_c") + F.col("_b")) / F.col("_total")
    d = d.withColumn("_hi", hi).withColumn("_lo", hi - F.col("_w") / F.col("_total"))
    buckets = max(1, min(n, 100_000))
    d = d.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") * buckets), F.least(F.floor(F.col("_hi") * buckets), F.lit(buckets - 1)))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_u", u).withColumn("_k", F.floor(F.col("_u") * buckets))
    j = draws.join(d, "_k").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return j.select("draw", *df.columns)


def pf_weights(score: Column, method: str = "pow", power: float = 2.0, top: Column | None = None, bottom: Column | None = None) -> Column:
    """Resampling weights of scores: |s|^power, the extremes only (with bounds), or 0.4 at the maximum and 0.1 elsewhere."""
    if method == "pow":
        return F.pow(F.abs(score), F.lit(power))
    if method == "max_min":
        return F.when((score == top) | (score == bottom), 1.0).otherwise(0.0)
    if method == "max_random":
        return F.when(score == top, 0.4).otherwise(0.1)
    raise ValueError(f"unknown method {method!r}")


def karmarkar_karp(weights: Sequence[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing: partial solutions are merged, largest spread first, so that heavy sets meet light ones.

    With ``equal`` all parts get as many items, up to one where their number does not divide. Runs on (id, weight) of one batch.
    """
    if equal and (short := -len(weights) % parts):
        # Empty items fill the last round; they are dropped again.
        full = karmarkar_karp([*weights, *[0] * short], parts, True)
        return [[i for i in ids if i < len(weights)] for ids in full]
    order = sorted((w, i) for i, w in enumerate(weights))
    if equal:
        start = [[[(w, [i])] for w, i in order[a : a + parts]] for a in range(0, len(order), parts)]
        states = [[s[0] for s in group] for group in start]
    else:
        states = [[(w, [i])] + [(0, [])] * (parts - 1) for w, i in order]
    heap: list = []
    for n, sets in enumerate(states):
        sets = sorted(sets, key=lambda s: (s[0], s[1]), reverse=True)
        heapq.heappush(heap, (-(sets[0][0] - sets[-1][0]), n, sets))
    n = len(states)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda s: (s[0], s[1]), reverse=True)
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), n, merged))
        n += 1
    return [sorted(s[1]) for s in heap[0][2]] if heap else [[] for _ in range(parts)]


def greedy(weights: Sequence[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Each item, lightest first, goes to the lightest part; with ``equal`` to the lightest of the parts with fewest items."""
    held: list[list[int]] = [[] for _ in range(parts)]
    heap = [(0, 0, k) for k in range(parts)]
    for i in sorted(range(len(weights)), key=lambda i: (weights[i], i)):
        rank, total, k = heap[0]
        held[k].append(i)
        heapq.heapreplace(heap, (rank + 1 if equal else 0, total + weights[i], k))
    return [sorted(x) for x in held]


def balanced(df: DataFrame, batch: str, key: str, weight: str, parts: int, equal: bool = False) -> DataFrame:
    """(batch, key, part): token-balanced partitions of each batch by largest differencing. A batch is what one training
    step takes, so its (key, weight) pairs fit one task; batches are spread over tasks."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        part = [0] * len(pdf)
        for p, ids in enumerate(karmarkar_karp(pdf[weight].astype(int).tolist(), parts, equal)):
            for i in ids:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], weight: pdf[weight], "part": part})

    return df.select(batch, key, weight).groupBy(batch).applyInPandas(run, f"`{batch}` {types[batch]}, `{key}` {types[key]}, `{weight}` {types[weight]}, part int")


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most_tokens: int) -> DataFrame:
    """Dynamic micro-batches: ceil(total / most) parts per batch, numbered by falling sum of squared lengths."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        n = pdf[length].astype(int).tolist()
        parts = karmarkar_karp(n, min(len(n), -(-sum(n) // most_tokens)) or 1)
        parts.sort(key=lambda ids: (-sum(n[i] ** 2 for i in ids), min(ids, default=0)))
        part = [0] * len(n)
        for p, ids in enumerate(parts):
            for i in ids:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], length: pdf[length], "part": part})

    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, f"`{batch}` {types[batch]}, `{key}` {types[key]}, `{length}` {types[length]}, part int")


def imbalance(df: DataFrame, part: str, weight: str) -> DataFrame:
    """Minimum, maximum and mean of the parts' sums."""
    return df.groupBy(part).agg(F.sum(weight).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"))


def even_positions(n: Column, most: int) -> Column:
    """Positions of at most ``most`` evenly spread rows out of n, as floor(k (n - 1) / (most - 1))."""
    k = F.sequence(F.lit(0), F.lit(most - 1))
    return F.when(n <= most, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array_distinct(F.transform(k, lambda i: F.floor(i * (n - 1) / (most - 1)).cast("int"))))


def interleave(parts: Sequence[DataFrame], position: str, size: int) -> DataFrame:
    """Batch 0 of each source, batch 1 of each, and so on: adds ``batch`` and ``source``; order by (batch, source, position)."""
    out = None
    for k, p in enumerate(parts):
        q = p.withColumns({"source": F.lit(k), "batch": F.floor(F.col(position) / size)})
        out = q if out is None else out.unionByName(q)
    return out


def composite(parts: Sequence[DataFrame], position: str, per_batch: Sequence[int]) -> DataFrame:
    """Fixed numbers of rows from each source in every batch; batches end with the first source that runs out."""
    out = None
    for k, (p, n) in enumerate(zip(parts, per_batch)):
        q = p.withColumns({"source": F.lit(k), "batch": F.floor(F.col(position) / n)})
        out = q if out is None else out.unionByName(q)
    full = [p.agg(F.floor(F.count("*") / n).alias("b")) for p, n in zip(parts, per_batch)]
    least = full[0]
    for f in full[1:]:
        least = least.unionByName(f)
    return out.crossJoin(F.broadcast(least.agg(F.min("b").alias("_b")))).where("batch < _b").drop("_b")
