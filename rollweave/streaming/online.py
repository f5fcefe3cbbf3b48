"""Structured Streaming forms of the online filter and of the accumulate-until-full loop."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from rollweave.operators.filters import mark_patterns
from rollweave.session import cut


def records(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """JSON files that appear in a folder."""
    return spark.readStream.schema(schema).json(folder)


def keep_mask(stream: DataFrame, patterns: Mapping[str, Column], target: Column | None = None) -> DataFrame:
    """keep and hits of every record; records outside ``target`` stay true. Stateless, so it runs on a stream as on a table."""
    return mark_patterns(stream, patterns, target)


def write_stream(stream: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Exactly-once file sink: what is there is processed, then the query ends; a restart resumes from the checkpoint."""
    return stream.writeStream.format(fmt).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ACCUMULATED = "run string, batch bigint, position int, uid string, attempts int"


def accumulate(stream: DataFrame, run: str, uid: str, prompts: int, most_attempts: int = 0) -> DataFrame:
    """Collects kept prompts per run until ``prompts`` of them are there, then emits them as one batch and carries the rest over.

    State per run: prompts held, batches emitted, attempts since the last batch. Beyond ``most_attempts`` micro-batches
    (0: no limit) without a full batch the query raises.
    """

    def step(key: tuple, pdfs: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, emitted, attempts = state.get if state.exists else ([], 0, 0)
        held, attempts, rows = list(held), attempts + 1, []
        for pdf in pdfs:
            held += [u for u in pdf["uid"] if u is not None]
        while len(held) >= prompts:
            rows += [(key[0], emitted, i, u, attempts) for i, u in enumerate(held[:prompts])]
            held, emitted, attempts = held[prompts:], emitted + 1, 0
        if most_attempts and attempts > most_attempts:
            raise ValueError(f"no full batch within {most_attempts} attempts")
        state.update((held, emitted, attempts))
        yield pd.DataFrame(rows, columns=["run", "batch", "position", "uid", "attempts"])

    s = stream.select(F.col(run).cast("string").alias("run"), F.col(uid).cast("string").alias("uid"))
    return s.groupBy("run").applyInPandasWithState(step, ACCUMULATED, "held array<string>, emitted bigint, attempts int", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, late: str, size: str, key: str, value: str) -> DataFrame:
    """Event-time counts and means per window and key; rows later than ``late`` behind the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def sessions(stream: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


class Curriculum:
    """Sampler that learns from each batch: a weight per group, moved towards the batch's mean score.

    The weights are a table, written anew by each update, so there may be any number of groups.
    """

    def __init__(self, rate: float = 0.5):
        self.rate = rate
        self.weights: DataFrame | None = None

    def update(self, batch: DataFrame, group: str, score: str) -> None:
        """A group seen first takes its mean; groups that the batch lacks keep their weight. Null scores say nothing."""
        new = batch.where(F.col(score).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.avg(score).alias("_m"))
        if self.weights is None:
            self.weights = cut(new.withColumnRenamed("_m", "_w"), "weights")
            return
        old = self.weights.withColumnRenamed("_g", "_old")
        j = new.join(old, F.col("_g").eqNullSafe(F.col("_old")), "full")
        moved = F.when(F.col("_m").isNull(), F.col("_w")).when(F.col("_w").isNull(), F.col("_m")).otherwise(F.col("_w") + self.rate * (F.col("_m") - F.col("_w")))
        self.weights = cut(j.select(F.when(F.col("_m").isNull(), F.col("_old")).otherwise(F.col("_g")).alias("_g"), moved.alias("_w")), "weights")

    def order(self, df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
        """Rows of the groups with the lowest score first; unseen groups before all."""
        by_hash = F.xxhash64(F.lit(seed), key)
        if self.weights is None:
            return df.orderBy(by_hash, key)
        j = df.join(self.weights, F.col(group).eqNullSafe(F.col("_g")), "left")
        return j.orderBy(F.col("_w").asc_nulls_first(), by_hash, key).drop("_g", "_w")
