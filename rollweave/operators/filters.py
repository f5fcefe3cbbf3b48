"""Predicates and row filters. NaN compares false in every threshold, as in the reference; Spark alone would order it above all numbers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.operators.sampling import group_name


def guarded(c: str, op: str, v: float) -> Column:
    """c op v, false for null and NaN. op is one of gt ge lt le eq."""
    x = F.col(c).cast("double")
    y = {"gt": x > v, "ge": x >= v, "lt": x < v, "le": x <= v, "eq": x == v}[op]
    return F.coalesce(y & ~F.isnan(x), F.lit(False))


def parse_comparisons(items: Sequence[str]) -> list[tuple[str, float]]:
    """'col:value' pairs."""
    out = []
    for item in items:
        name, sep, value = item.rpartition(":")
        if not sep or not name:
            raise ValueError(f"{item!r} is not of the form column:value")
        out.append((name, float(value)))
    return out


def thresholds(ge: Sequence[str] = (), le: Sequence[str] = (), eq: Sequence[str] = (), how: str = "and", where: str | None = None) -> Column:
    """Threshold lists joined by AND or OR, and a free SQL expression that must hold as well."""
    parts = [guarded(c, op, v) for op, items in (("ge", ge), ("le", le), ("eq", eq)) for c, v in parse_comparisons(items)]
    cond = reduce(and_ if how == "and" else or_, parts) if parts else F.lit(True)
    return cond & F.coalesce(F.expr(where), F.lit(False)) if where else cond


TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "correct"), ("false", "0", "no", "n", "wrong")


def boolish(c: Column) -> Column:
    """Text as a boolean: known words, else a number above 0; null where neither applies."""
    t = F.lower(F.trim(c.cast("string")))
    n = t.try_cast("double")
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).when(n.isNotNull() & ~F.isnan(n), n > 0)


def record_class(verdicts: Sequence[Column], reward: Column | None = None) -> Column:
    """1 correct, 0 wrong, 2 no judgement: the first verdict that is there, then reward > 0."""
    v = F.coalesce(*[boolish(c) for c in verdicts]) if verdicts else F.lit(None).cast("boolean")
    if reward is not None:
        v = F.coalesce(v, F.when(~F.isnan(reward), reward > 0))
    return F.when(v, 1).when(~v, 0).otherwise(2)


def in_groups(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    return df.where(group_name(group).isin(*names))


#: Quality patterns: name -> condition for a bad row. Add an entry to add a pattern.
PATTERNS: dict[str, Callable[[], Column]] = {
    "ce_ref_mean_too_large": lambda: guarded("ce_ref_seq_mean", "gt", 1.8),
    "repeat_word_run_max_too_large": lambda: guarded("repeat_word_run_max", "gt", 25),
    "num_self_reflect_sentences_too_many": lambda: guarded("num_self_reflect_sentences", "gt", 40),
    "marker_loopiness_too_large": lambda: guarded("marker_loopiness", "gt", 50),
    "control_private_unassigned_ratio_too_large": lambda: guarded("control_private_unassigned_ratio", "gt", 0.12),
    "compress_ratio_too_small": lambda: guarded("compress_ratio", "lt", 0.2),
    "tandem_repetition": lambda: F.coalesce(F.col("tandem_repeats") >= 16, F.lit(False)),
}


def mark_patterns(df: DataFrame, patterns: Mapping[str, Column], target: Column | None = None) -> DataFrame:
    """Adds hit_<name> per pattern, ``hits`` (list of names) and ``keep``; rows outside ``target`` are kept."""
    t = F.lit(True) if target is None else F.coalesce(target, F.lit(False))
    d = df.withColumns({f"hit_{n}": t & c for n, c in patterns.items()})
    hits = F.array_compact(F.array(*[F.when(F.col(f"hit_{n}"), F.lit(n)) for n in patterns]))
    return d.withColumn("hits", hits).withColumn("keep", F.size("hits") == 0)


def varied_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies, or that have one row (dynamic sampling)."""
    w = Window.partitionBy(group)
    return df.withColumn("_keep", (F.min(metric).over(w) != F.max(metric).over(w)) | (F.count("*").over(w) == 1)).where("_keep").drop("_keep")


def drop_bad_groups(df: DataFrame, group: str, bad: Sequence[DataFrame]) -> DataFrame:
    """Without the groups named in any of the ``bad`` lists."""
    ids = reduce(DataFrame.unionByName, [b.select(group) for b in bad]).where(F.col(group).isNotNull()).distinct()
    return df.join(ids, group, "left_anti")


def varied_or_first(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups whose metric varies; if there is none, the first group alone."""
    stats = df.groupBy(group).agg((F.min(metric) != F.max(metric)).alias("_v"))
    pick = stats.agg(F.count_if("_v").alias("_n"), F.min(group).alias("_first"))
    s = stats.crossJoin(F.broadcast(pick)).where(F.col("_v") | (F.col("_n") == 0) & (F.col(group) == F.col("_first")))
    return df.join(s.select(group), group, "left_semi")


def accuracy_filter(df: DataFrame, group: str, acc: str, length: str, low: float, high: float, most_len: int) -> DataFrame:
    """Adds ``passes``: the group's mean accuracy lies in [low, high] and none of its rows reaches the length limit."""
    w = Window.partitionBy(group)
    return df.withColumn("passes", F.avg(acc).over(w).between(low, high) & (F.max(length).over(w) < most_len - 1))


def downsample(df: DataFrame, group: str, acc: str, length: str, order: Sequence[str], low: float, high: float, most_len: int, oversample: float) -> DataFrame:
    """Passing groups first, then the others, cut to rows / oversample."""
    from rollweave.operators.batch import first_share

    d = accuracy_filter(df, group, acc, length, low, high, most_len).withColumn("_f", ~F.col("passes"))
    return first_share(d, ["_f", group, *order], 1 / oversample).drop("_f")


def has_chinese(c: Column) -> Column:
    """Chinese characters, full-width forms and Chinese punctuation."""
    return F.coalesce(c.rlike("[\\x{3000}-\\x{303F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"), F.lit(False))


def validation_errors(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
