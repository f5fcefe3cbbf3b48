"""Mergeable quantile sketches: randomized compactor hierarchies over DataFrame columns (problem 5).

A sketch holds levels of buffers; an item of level h stands for 2**h rows. A full buffer
is sorted and every second value, from a random offset, moves up one level. One compaction
of level h moves the rank of any value by at most 2**h, up or down with equal chance, so the
rank error is a sum of independent bounded terms; with S the sum of 4**h over all compactions
Hoeffding's inequality bounds it by sqrt(2 * S * ln(2 / delta)) with probability 1 - delta.
S adds up when sketches merge, so every result carries its own bound.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_K = 512
SHRINK = 2 / 3


class QuantileSketch:
    """Randomized compactor hierarchy with top capacity ``k``. Takes finite and infinite values; NaN must be left out."""

    __slots__ = ("hi", "k", "levels", "lo", "n", "rng", "sq")

    def __init__(self, k: int = DEFAULT_K, seed: int = 0):
        self.k, self.n, self.sq = k, 0, 0.0
        self.lo, self.hi = math.inf, -math.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.rng = np.random.default_rng(seed)

    def _cap(self, h: int) -> int:
        return max(8, math.ceil(self.k * SHRINK ** (len(self.levels) - 1 - h)))

    def update(self, values: np.ndarray) -> QuantileSketch:
        if len(values):
            self.n += len(values)
            self.lo, self.hi = min(self.lo, float(values.min())), max(self.hi, float(values.max()))
            self.levels[0] = np.concatenate((self.levels[0], values.astype(float)))
            self._compress()
        return self

    def merge(self, other: QuantileSketch) -> QuantileSketch:
        """Levelwise union of the buffers, then compaction from the bottom."""
        self.n += other.n
        self.sq += other.sq
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for h, buf in enumerate(other.levels):
            self.levels[h] = np.concatenate((self.levels[h], buf))
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            buf = self.levels[h]
            if len(buf) > self._cap(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                buf = np.sort(buf)
                odd = len(buf) % 2
                keep, buf = buf[:odd], buf[odd:]
                up = buf[int(self.rng.integers(2)) :: 2]
                self.levels[h] = keep
                self.levels[h + 1] = np.concatenate((self.levels[h + 1], up))
                self.sq += 4.0**h
            h += 1

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(b), 2**h, dtype=np.int64) for h, b in enumerate(self.levels)])
        o = np.argsort(v, kind="stable")
        return v[o], w[o]

    def quantiles(self, ps: Sequence[float]) -> list[float]:
        """Values at ranks ceil(p * n), exact at 0 and 1."""
        if not self.n:
            return [math.nan] * len(ps)
        v, w = self._weighted()
        c = np.cumsum(w)
        out = []
        for p in ps:
            if p <= 0 or p >= 1:
                out.append(self.lo if p <= 0 else self.hi)
            else:
                out.append(float(v[min(int(np.searchsorted(c, max(1, math.ceil(p * self.n)))), len(v) - 1)]))
        return out

    def rank_error(self, delta: float = 0.01) -> float:
        """Bound of the rank error as a share of n, holding with probability 1 - delta."""
        return min(1.0, math.sqrt(2 * self.sq * math.log(2 / delta)) / self.n) if self.n else 0.0

    def to_bytes(self) -> bytes:
        head = struct.pack("<iiqddd", self.k, len(self.levels), self.n, self.sq, self.lo, self.hi)
        return head + struct.pack(f"<{len(self.levels)}i", *map(len, self.levels)) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, b: bytes, seed: int = 0) -> QuantileSketch:
        k, m, n, sq, lo, hi = struct.unpack_from("<iiqddd", b)
        s = cls(k, seed)
        s.n, s.sq, s.lo, s.hi = n, sq, lo, hi
        at = struct.calcsize("<iiqddd")
        sizes = struct.unpack_from(f"<{m}i", b, at)
        at += 4 * m
        s.levels = []
        for x in sizes:
            s.levels.append(np.frombuffer(b, dtype=float, count=x, offset=at).copy())
            at += 8 * x
        return s


def _seed(*parts: object) -> int:
    return zlib.crc32(repr(parts).encode())


#: Rows of partial results: grouping, group, metric, salt, missing values and sketch.
PARTIAL = "dim string, grp string, metric string, salt int, n_missing bigint, sketch binary"
_COLS = ["dim", "grp", "metric", "salt", "n_missing", "sketch"]


def partial_sketches(df: DataFrame, groups: Mapping[str, Column], metrics: Mapping[str, Column], k: int = DEFAULT_K, salts: int = 32, most_groups: int = 4096) -> DataFrame:
    """One pass: a sketch per partition, group and metric, for several groupings at once; no row is shuffled.

    Null and NaN values are counted in n_missing and stay out of the sketch. A null group is its own group. When a
    partition holds more than ``most_groups`` groups, what is there is emitted and begun anew, so memory stays bounded
    whatever the number of groups.
    """
    dims, cols = list(groups), list(metrics)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        state: dict[tuple, list] = {}
        emitted = 0

        def emit() -> pd.DataFrame:
            nonlocal emitted
            rows = [(*key, part % salts, miss, s.to_bytes()) for key, (miss, s) in state.items()]
            state.clear()
            emitted += 1  # a key that begins anew takes other coin flips
            return pd.DataFrame(rows, columns=_COLS)

        for pdf in batches:
            values = [pdf[f"m{j}"].to_numpy(dtype=float, na_value=np.nan) for j in range(len(cols))]
            for i, dim in enumerate(dims):
                codes, names = pd.factorize(pdf[f"g{i}"], use_na_sentinel=False)
                order = np.argsort(codes, kind="stable")
                cuts = np.searchsorted(codes[order], np.arange(1, len(names)))
                for name, at in zip(names, np.split(order, cuts)):
                    name = name if isinstance(name, str) else None
                    for m, v in zip(cols, values):
                        x = v[at]
                        ok = x[~np.isnan(x)]
                        key = (dim, name, m)
                        if key not in state:
                            state[key] = [0, QuantileSketch(k, _seed(part, emitted, *key))]
                        state[key][0] += len(x) - len(ok)
                        state[key][1].update(ok)
                if len(state) > most_groups * len(cols):
                    yield emit()
        yield emit()

    g = [c.cast("string").alias(f"g{i}") for i, c in enumerate(groups.values())]
    m = [c.cast("double").alias(f"m{j}") for j, c in enumerate(metrics.values())]
    return df.select(*g, *m).mapInPandas(run, PARTIAL)


def _merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the sketches of equal keys that meet in a partition; holds one sketch per key.

    The coin flips of a merge are seeded by the first sketch's content as well, so they differ from merge to merge and
    between the steps, and a repeated task flips the same.
    """
    state: dict[tuple, list] = {}
    for pdf in batches:
        for *key, miss, b in pdf[_COLS].itertuples(index=False, name=None):
            key = tuple(None if x is None or x != x else x for x in key)
            held = state.get(key)
            if held is None:
                state[key] = [miss, QuantileSketch.from_bytes(b, _seed(*key, zlib.crc32(b)))]
            else:
                held[0] += miss
                held[1].merge(QuantileSketch.from_bytes(b))
    yield pd.DataFrame([(*key, miss, s.to_bytes()) for key, (miss, s) in state.items()], columns=_COLS)


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Merge to one sketch per group and metric, in two steps, so that no task reads all parts of a hot group.

    Rows are hash-partitioned by key and merged as they stream in, without a call per group.
    """
    salted = parts.repartition("dim", "grp", "metric", "salt").mapInPandas(_merge, PARTIAL)
    return salted.withColumn("salt", F.lit(0)).repartition("dim", "grp", "metric").mapInPandas(_merge, PARTIAL)


QUANTILES = "dim string, grp string, metric string, n bigint, n_missing bigint, p double, estimate double, rank_error double"


def read_quantiles(sketches: DataFrame, ps: Sequence[float], delta: float = 0.01) -> DataFrame:
    """A row per group, metric and percentile, with the bound of the rank error (share of n, probability 1 - delta)."""
    ps = list(ps)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, g, m, miss, b in zip(pdf["dim"], pdf["grp"], pdf["metric"], pdf["n_missing"], pdf["sketch"]):
                s = QuantileSketch.from_bytes(b)
                e = s.rank_error(delta)
                rows += [(d, g, m, s.n, miss, p, q if s.n else None, e) for p, q in zip(ps, s.quantiles(ps))]
            yield pd.DataFrame(rows, columns=["dim", "grp", "metric", "n", "n_missing", "p", "estimate", "rank_error"])

    return sketches.mapInPandas(run, QUANTILES)


def percentiles(df: DataFrame, groups: Mapping[str, Column], metrics: Mapping[str, Column], ps: Sequence[float], k: int = DEFAULT_K, delta: float = 0.01) -> DataFrame:
    """Percentiles of ``metrics`` per group of each grouping, with a stated rank-error bound.

    An empty table gives no rows; a group whose values are all null or NaN gives rows with a null estimate.
    """
    return read_quantiles(merge_sketches(partial_sketches(df, groups, metrics, k)), ps, delta)


def rank_check(df: DataFrame, groups: Mapping[str, Column], metrics: Mapping[str, Column], estimates: DataFrame) -> DataFrame:
    """Adds to each estimate the exact shares of values below and not above it: low and high, by one counting pass.

    The groups' estimates are joined to the rows as one array per group and metric, and the counts are
    pre-aggregated, so no group is gathered in one task.
    """
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("grp")) for d, c in groups.items()])).alias("g"),
        F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("v")) for m, c in metrics.items()]).alias("vs"),
    ).select("g.dim", "g.grp", F.explode("vs").alias("x"))
    long = long.select("dim", "grp", "x.metric", "x.v").where("v is not null and not isnan(v)")
    est = estimates.groupBy("dim", "grp", "metric").agg(F.sort_array(F.collect_list(F.struct("p", "estimate"))).alias("qs"))
    est = est.select(F.col("dim").alias("d"), F.col("grp").alias("g"), F.col("metric").alias("m"), "qs")
    j = long.groupBy("dim", "grp", "metric", "v").agg(F.count("*").alias("c")).join(est, (F.col("dim") == F.col("d")) & F.col("grp").eqNullSafe(F.col("g")) & (F.col("metric") == F.col("m")))
    one = j.select("dim", "grp", "metric", "v", "c", F.explode("qs").alias("q"))
    counted = one.groupBy("dim", "grp", "metric", F.col("q.p").alias("p")).agg(
        F.sum(F.when(F.col("v") < F.col("q.estimate"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("q.estimate"), F.col("c")).otherwise(0)).alias("upto"),
        F.sum("c").alias("total"),
    )
    e = estimates.alias("e")
    c = counted.alias("c")
    on = (F.col("e.dim") == F.col("c.dim")) & F.col("e.grp").eqNullSafe(F.col("c.grp")) & (F.col("e.metric") == F.col("c.metric")) & (F.col("e.p") == F.col("c.p"))
    return e.join(c, on, "left").select("e.*", (F.col("below") / F.col("total")).alias("low"), (F.col("upto") / F.col("total")).alias("high"))
