"""Filling fixed-capacity containers with items of varying length (problem 6): bulk-synchronous best fit.

Items and gaps are run lengths (a size and how many have it), sorted into ranges by size that halve from the capacity
down. A task holds one range of one packing; what no run length says stays in the table of items. In a superstep every
range with items sweeps its gaps: an item takes the smallest gap that suffices, its successor; where several want one gap
the larger goes first, equal items by rank. Gaps that shrink move down to their range, items without a successor move up
to the next range, and from the top range they open new containers. Larger items set out two supersteps before those of the
next range, so they find the gaps they left; a fixed number of supersteps places all. Segments (ranks of a size ->
containers) come out; the items' ranks are counted where they lie, without a shuffle, and joined with the segments.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.llm import resources
from rollweave.session import cut

TOKENIZER = "byte_bpe_50k.tiktoken"
RANGES = 3


@cache
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = TOKENIZER) -> DataFrame:
    """key and n_tokens of each text under a public tokenizer; null and empty texts have none."""
    path = resources.path(vocabulary)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "n_tokens": [len(encode(t)) if t else 0 for t in pdf["t"]]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n_tokens int").withColumnRenamed("k", key)


def range_of(size: int, capacity: int, ranges: int = RANGES) -> int:
    """The range of a size: the top one holds those above half of the capacity, the next those above a quarter, and so on."""
    r = ranges - 1
    while r and size * 2 ** (ranges - r) <= capacity:
        r -= 1
    return r


def active(t: int, ranges: int = RANGES) -> set[int]:
    """The ranges whose items move in superstep t: items of range s set out at 2 * (ranges - 1 - s) and climb a range each time."""
    return {r for s in range(ranges) if s <= (r := s + t - 2 * (ranges - 1 - s)) < ranges}


def supersteps(ranges: int = RANGES) -> int:
    return 3 * (ranges - 1) + 1


Gap = tuple[int, int, int, int]
Segment = tuple[int, int, int, int, int, int]


def match(capacity: int, items: list[tuple[int, int, int]], gaps: list[Gap], top: bool, opened: int) -> tuple[list[Segment], list[tuple[int, int, int]], list[Gap], int]:
    """One range of a superstep. ``items``: (size, count, first rank); ``gaps``: (gap, first container, containers, items in each).

    Gives segments (size, first rank, first container, items per container, offset, position), the items left, the gaps and
    how many containers are open. Items left open new containers where ``top``.
    """
    out: list[Segment] = []
    rest: list[tuple[int, int, int]] = []
    gaps = sorted(gaps)
    for size, left, rank in sorted(items, reverse=True):
        while left:
            i = bisect_left(gaps, (size,))
            if i < len(gaps):
                gap, first, count, held = gaps.pop(i)
            elif top:
                count = -(-left // (capacity // size))
                gap, first, held = capacity, opened, 0
                opened += count
            else:
                rest.append((size, left, rank))
                break
            fit = gap // size
            whole = min(count, left // fit)
            if whole:
                out.append((size, rank, first, fit, capacity - gap, held))
                insort(gaps, (gap - fit * size, first, whole, held + fit))
                rank, left = rank + whole * fit, left - whole * fit
            if whole < count and left:  # one container of the run takes the rest
                out.append((size, rank, first + whole, left, capacity - gap, held))
                insort(gaps, (gap - left * size, first + whole, 1, held + left))
                whole, left = whole + 1, 0
            if whole < count:
                insort(gaps, (gap, first + whole, count - whole, held))
    return out, rest, [g for g in gaps if g[0]], opened


#: kind: item, gap, open (how many containers are open; in the top range) or segment.
STATE = "bin_key string, capacity int, at int, kind string, size int, n bigint, first bigint, container bigint, per_container bigint, offset int, position bigint"
_COLS = [c.split()[0] for c in STATE.split(", ")]


def _step(pdf: pd.DataFrame) -> pd.DataFrame:
    """``match`` on the rows of one range; what moves carries its new range in ``at``."""
    key, capacity, at = pdf["bin_key"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["at"].iloc[0])
    rows = {k: g[["size", "n", "first", "container", "position"]].to_numpy(np.int64).tolist() for k, g in pdf.groupby("kind")}
    top = at == RANGES - 1
    opened = sum(n for _, n, *_ in rows.get("open", ()))
    segs, rest, gaps, opened = match(capacity, [(s, n, f) for s, n, f, *_ in rows.get("item", ())], [(s, c, n, p) for s, n, _, c, p in rows.get("gap", ())], top, opened)
    out = [(key, capacity, at + 1, "item", s, n, f, 0, 0, 0, 0) for s, n, f in rest]
    out += [(key, capacity, range_of(g, capacity), "gap", g, n, 0, c, 0, 0, p) for g, c, n, p in gaps]
    out += [(key, capacity, at, "segment", s, 0, f, c, per, o, p) for s, f, c, per, o, p in segs]
    if top:
        out.append((key, capacity, at, "open", 0, opened, 0, 0, 0, 0, 0))
    return pd.DataFrame(out, columns=_COLS)


def sweep(capacity: int, classes: dict[int, int], ranges: int = RANGES) -> tuple[list[Segment], int]:
    """The supersteps of one packing without a cluster: segments and number of containers."""
    items = {r: [(s, n, 0) for s, n in classes.items() if range_of(s, capacity, ranges) == r] for r in range(ranges)}
    gaps: dict[int, list[Gap]] = {r: [] for r in range(ranges)}
    out, opened = [], 0
    for t in range(supersteps(ranges)):
        moved: list[tuple[int, list]] = []
        fresh: list[Gap] = []
        for r in active(t, ranges):
            segs, rest, left, opened = match(capacity, items[r], gaps[r], r == ranges - 1, opened)
            out += segs
            moved.append((r + 1, rest))
            items[r], gaps[r] = [], []
            fresh += left
        for r, rest in moved:
            if rest:
                items[r] += rest
        for g in fresh:
            gaps[range_of(g[0], capacity, ranges)].append(g)
    return out, opened


def plan(histogram: DataFrame) -> DataFrame:
    """Segments from (bin_key, capacity, size, n). A row per size and packing at most, so the state is small at any input
    size; each superstep is written, which also cuts the lineage."""
    at = F.greatest(F.lit(0), F.lit(RANGES - 1) - F.floor(F.log2(F.col("capacity") / F.col("size"))).cast("int"))
    empty = {"first": "bigint", "container": "bigint", "per_container": "bigint", "offset": "int", "position": "bigint"}
    new = {"at": at, "kind": F.lit("item")} | {c: F.lit(0).cast(t) for c, t in empty.items()}
    state = cut(histogram.withColumns(new).select(*_COLS), "plan")
    done: list[DataFrame] = []
    for t in range(supersteps()):
        moving = F.col("at").isin(*active(t))
        stepped = state.where(moving).groupBy("bin_key", "at").applyInPandas(_step, STATE)
        after = cut(stepped.unionByName(state.where(~moving)), "plan")
        done.append(after.where("kind = 'segment'"))
        state = after.where("kind <> 'segment'")
    segs = done[0]
    for d in done[1:]:
        segs = segs.unionByName(d)
    return segs.select("bin_key", "size", F.col("first").alias("first_rank"), F.col("container").alias("first_container"), "per_container", "offset", "position")


def _ranked(rows: DataFrame, kind: str) -> DataFrame:
    """Pieces of the items with their rank among those of one size in their partition. Linear, no shuffle."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[str, np.ndarray] = {}
        for pdf in batches:
            n, cap = pdf["n"].to_numpy(np.int64), pdf["capacity"].to_numpy(np.int64)
            times = -(-n // cap)
            of = np.repeat(np.arange(len(n)), times)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            start = piece * cap[of]
            size = np.minimum(cap[of], n[of] - start)
            codes, names = pd.factorize(pdf["bin_key"])
            rank = np.empty(len(of), np.int64)
            for c, name in enumerate(names):
                mine = np.flatnonzero(codes[of] == c)
                held = seen.setdefault(name, np.zeros(int(cap[codes == c][0]) + 1, np.int64))
                order = mine[np.argsort(size[mine], kind="stable")]
                s = size[order]
                first = np.searchsorted(s, s)
                rank[order] = held[s] + np.arange(len(s)) - first
                held += np.bincount(s, minlength=len(held))
            yield pd.DataFrame({"bin_key": pdf["bin_key"].to_numpy()[of], "capacity": cap[of], "k": pdf["k"].to_numpy()[of], "piece": piece, "start": start, "size": size, "part": part, "rank": rank})

    return rows.mapInPandas(run, f"bin_key string, capacity int, k {kind}, piece int, start bigint, size int, part int, rank bigint")


def pack(items: DataFrame, bins: DataFrame, key: str, size: str, bin_key: str, capacity: str) -> DataFrame:
    """Packs all items once for every row of ``bins``: bin_key, container, position, key, piece, size, offset, start.

    Only an item longer than the capacity is split, into full pieces and a rest; ``start`` is where the piece begins
    in its item, ``offset`` where in its container. Items without length and bins without a positive capacity are left
    out; repeated items are packed as often as they occur. Every item meets every row of ``bins``, that is the feature;
    how, Spark chooses by the sizes. Pieces are shuffled once, by partition, packing and size, so many pieces of one size
    (all full ones) do not meet in one task.
    """
    b = bins.select(F.col(bin_key).cast("string").alias("bin_key"), F.col(capacity).cast("int").alias("capacity")).where("capacity > 0 and bin_key is not null").distinct()
    it = items.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n")).where("n > 0")
    ranked = cut(_ranked(it.crossJoin(b), dict(items.dtypes)[key]), "ranked")
    counts = cut(ranked.groupBy("part", "bin_key", "capacity", "size").agg(F.count("*").alias("n")), "counts")
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bin_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    segs = plan(counts.groupBy("bin_key", "capacity", "size").agg(F.sum("n").alias("n")))
    seg = F.struct("first_rank", "first_container", "per_container", "offset", "position")
    segs = segs.groupBy("bin_key", "size").agg(F.sort_array(F.collect_list(seg)).alias("segs"))
    # Of the segments of a size a partition needs those up to its last rank, from the last one that begins by its first rank on.
    first, end = F.col("before"), F.col("before") + F.col("n")
    upto = F.filter("segs", lambda x: x["first_rank"] < end)
    begun = F.size(F.filter("segs", lambda x: x["first_rank"] <= first))
    table = before.join(segs, ["bin_key", "size"]).select("part", "bin_key", "size", "before", F.slice(upto, begun, F.size(upto)).alias("segs"))
    j = ranked.join(table, ["part", "bin_key", "size"]).withColumn("r", F.col("rank") + F.col("before"))
    j = j.withColumn("s", F.element_at(F.filter("segs", lambda x: x["first_rank"] <= F.col("r")), -1))
    at = F.col("r") - F.col("s.first_rank")
    inside = at % F.col("s.per_container")
    kind = dict(bins.dtypes)[bin_key]
    return j.select(
        F.col("bin_key").cast(kind).alias(bin_key),
        (F.col("s.first_container") + F.floor(at / F.col("s.per_container"))).alias("container"),
        (F.col("s.position") + inside).cast("int").alias("position"),
        F.col("k").alias(key),
        "piece",
        F.col("size").alias("n_tokens"),
        (F.col("s.offset") + inside * F.col("size")).cast("int").alias("offset"),
        F.col("start").cast("int").alias("start_token"),
    )
