"""Batch algebra over rows with an explicit position.

A batch is a DataFrame with a dense bigint position column ``idx`` from 0. Row operators are joins, filters and
explodes on it; none collects rows. ``with_index`` makes the position from a key order without sorting into one
partition: counts per range partition give the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollweave.session import cut

IDX = "idx"


def with_index(df: DataFrame, order: Sequence[str], out: str = IDX) -> DataFrame:
    """Adds the position 0, 1, ... in the order of ``order`` (further columns should make it total).

    Rows are range-partitioned and numbered per partition; the offsets come from the partitions' counts, so no window
    spans the whole table. The numbered rows are written once, as partition numbers must not change between passes.
    """
    part = cut(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "indexed")
    local = F.row_number().over(Window.partitionBy("_p").orderBy("_m")) - 1
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return part.withColumn("_l", local).join(F.broadcast(before), "_p").withColumn(out, (F.col("_l") + F.col("_before")).cast("bigint")).drop("_p", "_m", "_l", "_before")


def first_share(df: DataFrame, order: Sequence[str], share: float, least: int = 0) -> DataFrame:
    """The first max(least, floor(share * n)) rows in the order of ``order``: by distributed positions, as a limit that grows
    with the table would pass all of them through one task."""
    d = with_index(df, order, "_first")
    n = d.agg(F.greatest(F.floor(F.count("*") * F.lit(share)), F.lit(least)).alias("_most"))
    return d.crossJoin(F.broadcast(n)).where("_first < _most").drop("_first", "_most")


def first_of(df: DataFrame, order: Sequence[str], n: DataFrame) -> DataFrame:
    """The first rows in the order of ``order``, as many as the one number in ``n`` says; by distributed positions."""
    most = n.toDF("_most")
    return with_index(df, order, "_first").crossJoin(F.broadcast(most)).where("_first < _most").drop("_first", "_most")


def select_positions(df: DataFrame, positions: DataFrame, idx: str = IDX) -> DataFrame:
    """Gather by a list of positions, which may repeat: ``positions`` has (pos, idx); the result has pos as its position."""
    return positions.join(df, idx).drop(idx).withColumnRenamed("pos", idx)


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask holds, in order; a null mask drops the row."""
    return df.where(mask)


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1, idx: str = IDX) -> DataFrame:
    i = F.col(idx)
    keep = (i >= start) & ((i - start) % step == 0)
    return df.where(keep if end is None else keep & (i < end))


def pop(df: DataFrame, cols: Sequence[str], idx: str = IDX) -> tuple[DataFrame, DataFrame]:
    return df.drop(*cols), df.select(idx, *cols)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(a: DataFrame, b: DataFrame, idx: str = IDX) -> DataFrame:
    """Horizontal union by position. A column in both must be equal (null = null, NaN = NaN), else the query raises."""
    both = [c for c in a.columns if c in b.columns and c != idx]
    renamed = b.withColumnsRenamed({c: f"_b_{c}" for c in both})
    j = a.join(renamed, idx)
    for c in both:
        same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        j = j.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return j.drop(*[f"_b_{c}" for c in both])


def concat(parts: Sequence[DataFrame], sizes: Sequence[int], idx: str = IDX) -> DataFrame:
    """Vertical concatenation; ``sizes`` are the row counts, which shift the positions."""
    out, at = None, 0
    for p, n in zip(parts, sizes):
        q = p.withColumn(idx, F.col(idx) + at)
        out = q if out is None else out.unionByName(q)
        at += n
    return out


def chunk_id(n_rows: int, chunks: int, idx: str = IDX) -> Column:
    """Chunk of a row when n rows are cut into pieces of ceil(n / chunks)."""
    return F.floor(F.col(idx) / -(-n_rows // chunks))


def split_id(size: int, idx: str = IDX) -> Column:
    return F.floor(F.col(idx) / size)


def split_list_id(n_rows: int, parts: int, idx: str = IDX) -> Column:
    """Part of a row when the edges are floor(k n / parts)."""
    return F.floor(((F.col(idx) + 1) * parts - 1) / n_rows)


def repeat(df: DataFrame, times: int, n_rows: int, interleave: bool = True, idx: str = IDX) -> DataFrame:
    """n copies of each row: a a b b, or a b a b."""
    e = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    pos = F.col(idx) * times + F.col("_k") if interleave else F.col("_k") * n_rows + F.col(idx)
    return e.withColumn(idx, pos.cast("bigint")).drop("_k")


def repeat_each(df: DataFrame, counts: str, idx: str = IDX) -> DataFrame:
    """As many copies of each row as its count says (0 and null: none); rows keep their position, copies are numbered in ``copy``."""
    n = F.coalesce(F.col(counts), F.lit(0)).cast("int")
    return df.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def unfold_columns(df: DataFrame, n: int, cols: Sequence[str], idx: str = IDX) -> DataFrame:
    """Splits the arrays ``cols`` into n equal pieces, one row each; other columns repeat."""
    e = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in cols:
        size = (F.size(c) / n).cast("int")
        e = e.withColumn(c, F.slice(c, F.col("_k") * size + 1, size))
    return e.withColumn(idx, F.col(idx) * n + F.col("_k")).drop("_k")


def pad_to_divisor(df: DataFrame, n_rows: int, divisor: int, idx: str = IDX) -> tuple[DataFrame, int]:
    """Appends rows from the head, cyclically, until the size divides; returns the pad size as well. An empty batch stays empty."""
    pad = -n_rows % divisor if n_rows else 0
    if not pad:
        return df, 0
    copies = -(-pad // n_rows)
    e = df.where(F.col(idx) < pad).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    tail = e.withColumn(idx, n_rows + F.col("_k") * n_rows + F.col(idx)).drop("_k").where(F.col(idx) < n_rows + pad)
    return df.unionByName(tail), pad


def unpad(df: DataFrame, n_rows: int, pad: int, idx: str = IDX) -> DataFrame:
    return df.where(F.col(idx) < n_rows - pad)


def padding(df: DataFrame, n_rows: int, size: int, last: bool = False, idx: str = IDX) -> DataFrame:
    """Appends ``size`` copies of the first (last) row."""
    one = df.where(F.col(idx) == (n_rows - 1 if last else 0)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))) if size else df.limit(0).withColumn("_k", F.lit(0))
    return df.unionByName(one.withColumn(idx, n_rows + F.col("_k")).drop("_k"))


def fold(df: DataFrame, width: int, cols: Sequence[str], idx: str = IDX) -> DataFrame:
    """[B] -> [B / width] rows, each with the array ``rows`` of its members in order."""
    return df.groupBy(F.floor(F.col(idx) / width).alias(idx)).agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("_i"), *cols))).alias("_r")).select(idx, F.transform("_r", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("rows"))


def unfold(df: DataFrame, width: int, idx: str = IDX) -> DataFrame:
    e = df.select(F.col(idx).alias("_i"), F.posexplode("rows").alias("_p", "_r"))
    return e.select((F.col("_i") * width + F.col("_p")).alias(idx), "_r.*")


def reorder(df: DataFrame, order: DataFrame, idx: str = IDX) -> DataFrame:
    """``order`` has (pos, idx): row idx moves to pos."""
    return select_positions(df, order, idx)


def minibatches(df: DataFrame, size: int, epochs: int, seed: int, idx: str = IDX) -> DataFrame:
    """(epoch, batch) of each row: a seeded hash order per epoch, cut into batches; by distributed positions over all epochs."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_h", F.xxhash64(F.lit(seed), "epoch", idx))
    at = with_index(e, ["epoch", "_h", idx], "_at").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    return at.withColumn("batch", F.floor((F.col("_at") - F.col("epoch") * F.col("_n")) / size)).drop("_h", "_at", "_n")


def check_consistency(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Raises where the arrays of a row differ in length."""
    ok = F.lit(True)
    for a in arrays[1:]:
        ok &= F.size(arrays[0]) == F.size(a)
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("boolean")))


def data_info(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def nested(df: DataFrame, path: str, default: object = None) -> Column:
    """Column at a dotted path, ``default`` where the path does not exist or the value is null."""
    try:
        df.select(F.col(path)).schema
    except Exception:
        return F.lit(default)
    return F.col(path) if default is None else F.coalesce(F.col(path), F.lit(default))


def put_nested(df: DataFrame, path: str, value: Column) -> DataFrame:
    top, _, rest = path.partition(".")
    return df.withColumn(top, F.col(top).withField(rest, value) if rest else value)


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct columns to a/b/c columns, recursively."""
    from pyspark.sql.types import StructType

    def walk(prefix: tuple[str, ...], kind: StructType) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            p = (*prefix, f.name)
            out += walk(p, f.dataType) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p))]
        return out

    return df.select(*walk((), df.schema))


def merge_meta(a: Mapping[str, object], b: Mapping[str, object]) -> dict[str, object]:
    for k in a.keys() & b.keys():
        if a[k] != b[k]:
            raise ValueError(f"{k} differs")
    return {**a, **b}
