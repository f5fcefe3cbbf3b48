"""Folds over arrays that keep every state, on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan(a: Column, start: Column, step: Callable[[Column, Column], Column], pick: Callable[[Column], Column] = lambda s: s, before: bool = False) -> Column:
    """Array of ``pick`` of the state after each element (before it, where ``before``); null and empty arrays give an empty one.

    ``concat`` in a fold copies what is there, so one fold over n elements costs n squared. Here the array is folded in blocks
    of the square root of n: a block's states are copied within the block only, n ** 1.5 in all.
    """
    n = F.coalesce(F.greatest(F.size(a), F.lit(0)), F.lit(0))
    size = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int")), lambda i: F.slice(a, i * size + 1, size))
    none = F.filter(F.array(pick(start)), lambda _: F.lit(False))

    def inner(s: Column, x: Column) -> Column:
        # The state before the element is at hand; the one after it would be computed twice.
        return F.struct(step(s["s"], x).alias("s"), F.concat(s["out"], F.array(pick(s["s"]))).alias("out"))

    def outer(s: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(s["s"].alias("s"), none.alias("out")), inner, lambda r: F.struct(r["s"].alias("s"), F.concat(s["outs"], F.array(r["out"])).alias("outs")))

    def end(s: Column) -> Column:
        all_ = F.flatten(s["outs"])
        return all_ if before else F.slice(F.concat(all_, F.array(pick(s["s"]))), 2, n)

    nested = F.filter(F.array(none), lambda _: F.lit(False))
    return F.when(n > 0, F.aggregate(blocks, F.struct(start.alias("s"), nested.alias("outs")), outer, end)).otherwise(none)
