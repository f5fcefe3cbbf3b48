"""Layout of batches: rows to columns and back, typed views, functions over rows, dispatch over parts, and reuse of what was computed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from rollweave.operators.batch import chunk_id


def collate(df: DataFrame, batch: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per batch, each column as an array in the order of ``order``; nulls keep their places. A batch is what one step takes."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order])))
    return df.groupBy(batch).agg(rows.alias("_rows")).select(batch, *[F.col("_rows")[c].alias(c) for c in cols])


def columns_of(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A table of few rows as one row of arrays."""
    return collate(df.withColumn("_all", F.lit(0)), "_all", order, df.columns).drop("_all")


def rows_of(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The inverse of ``collate``: parallel arrays to rows (key, pos, columns)."""
    z = F.arrays_zip(*[F.col(c).alias(c) for c in cols])
    return df.select(key, F.posexplode(z).alias("pos", "_z")).select(key, "pos", *[F.col(f"_z.{c}").alias(c) for c in cols])


def from_columns(spark: SparkSession, data: Mapping[str, Sequence], schema: str | StructType | None = None) -> DataFrame:
    """Rows from parallel columns of equal length; others raise."""
    sizes = {len(v) for v in data.values()}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*data.values())), schema or list(data))


def column_kinds(df: DataFrame) -> dict[str, str]:
    """tensor for numeric columns and arrays of numbers, object for all others."""

    def kind(t) -> str:
        while hasattr(t, "elementType"):
            t = t.elementType
        return "tensor" if isinstance(t, NumericType) else "object"

    return {f.name: kind(f.dataType) for f in df.schema.fields}


def append_metrics(metrics: DataFrame, new: DataFrame, prefix: str = "") -> DataFrame:
    """Appends (key, step, value) rows under prefixed keys; lists per key come from ``collate`` on demand."""
    return metrics.unionByName(new.withColumn("key", F.concat(F.lit(prefix), "key")))


def map_rows(df: DataFrame, f: Callable[[dict], dict | Iterable[dict]], schema: str, flat: bool = False) -> DataFrame:
    """A Python function over rows, in Arrow batches: a row (or, where ``flat``, any number of rows) for each. For what no
    built-in says; a partition streams through."""
    names = [x.name for x in StructType.fromDDL(schema).fields]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [f(r) for r in pdf.to_dict("records")]
            if flat:
                rows = [x for r in rows for x in r]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


#: Ways to call a function over the parts of a batch: all parts get all rows, or each its own.
DISPATCH = ("one_to_all", "all_to_all", "dp_compute")


def dispatch(mode: str) -> Callable:
    """Decorates a function DataFrame -> DataFrame. With dp_compute each of ``parts`` chunks by position goes through it and the
    results are put together; with one_to_all every part gets the whole batch; with all_to_all the batches are given part by part.
    Plans only; Spark runs the parts as tasks of one job."""
    if mode not in DISPATCH:
        raise ValueError(f"unknown mode {mode!r}; known: {DISPATCH}")

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        @wraps(f)
        def call(batch: DataFrame | Sequence[DataFrame], parts: int) -> DataFrame | list[DataFrame]:
            if mode == "one_to_all":
                return [f(batch) for _ in range(parts)]
            if mode == "all_to_all":
                if len(batch) != parts:
                    raise ValueError("one batch for each part is needed")
                return [f(b) for b in batch]
            part = chunk_id(batch.count(), parts)
            out = None
            for k in range(parts):
                done = f(batch.where(part == k))
                out = done if out is None else out.unionByName(done)
            return out

        return call

    return add


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What was written under ``path`` by an earlier run, else the result of ``make``, written there first. A write that did
    not end leaves no success mark and is done again."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def copy_in(spark: SparkSession, uri: str) -> str:
    """Ships a file to every machine once, whatever file system it lies in; gives its name for ``SparkFiles.get``. Tables need
    none of this: Spark reads them where they are."""
    spark.sparkContext.addFile(uri)
    return uri.rstrip("/").rpartition("/")[2]


def reattach(features: DataFrame, texts: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Adds columns of the source rows to feature rows by key. A feature without a source row keeps nulls; of repeated source
    rows one is taken, so features are never multiplied."""
    one = texts.select(key, *cols).groupBy(key).agg(*[F.first(c).alias(c) for c in cols])
    return features.join(one, key, "left")


def unequal_tokens(a: str | Column, b: str | Column, mask: str | Column) -> Column:
    """Aggregate: masked tokens whose values differ; a null differs from a value."""
    a, b, mask = (F.col(x) if isinstance(x, str) else x for x in (a, b, mask))
    return F.count_if(~a.eqNullSafe(b) & (mask == 1))


def mean_nll(logp: str | Column, weight: str | Column) -> Column:
    """Aggregate: - sum(log p * w) / sum(w); null where no weight is left."""
    logp, weight = (F.col(x) if isinstance(x, str) else x for x in (logp, weight))
    return F.when(F.sum(weight) != 0, -F.sum(logp * weight) / F.sum(weight))


def append_generated(stream: DataFrame, generate: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """After every micro-batch the rows that ``generate`` makes of it are appended to ``folder``, where a streamed source may
    pick them up; a batch that is repeated after a failure overwrites its own folder only."""
    return stream.writeStream.foreachBatch(lambda b, i: generate(b).write.mode("overwrite").json(f"{folder}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
