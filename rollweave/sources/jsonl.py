"""JSON lines: scans with counts, line access, schema probes and partitioned sinks. Compressed files are read as they are."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rollweave.functions.text import file_name
from rollweave.operators.sampling import group_name, reservoir, seeded

#: Scalar fields of a rollout record.
ROLLOUT = (
    "timestamp string, epoch int, global_step int, uid string, filter_state string, filter_reason string, prompt_text string, response_text string, "
    "prompt_len_tokens int, response_len_tokens int, total_len_tokens int, "
    "gen_cfg struct<temperature: double, top_p: double, top_k: int, max_new_tokens: int, n: int, do_sample: boolean>, "
    "old_logprob_mean double, old_logprob_sum double, rollout_logprob_mean double, rollout_logprob_sum double, ref_logprob_mean double, ref_logprob_sum double, "
    "reward_seq_mean double, reward_seq_sum double, adv_seq_mean double, value_seq_mean double, kl_value_mean double, entropy_mean double, "
    "reward_extra_infos map<string, string>, ground_truth string, ground_truth_style string, data_source string, ability string"
)
BAD = "_corrupt_record"


def read(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType = ROLLOUT) -> DataFrame:
    """Records with a fixed schema, so no inference pass; a line that is no JSON object is kept in ``_corrupt_record``."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.read.schema(StructType([*fields, StructField(BAD, StringType())])).json(paths, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with 1-based numbers per file, for files read whole by one task each (as gz files are).

    Splits of a plain file are kept in order by their start, and the numbers come from per-split counts.
    """
    from pyspark.sql.window import Window

    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), "value", F.monotonically_increasing_id().alias("_m"))
    local = F.row_number().over(Window.partitionBy("file", "_b").orderBy("_m"))
    n = d.groupBy("file", "_b").agg(F.count("*").alias("_n"))
    before = n.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return d.withColumn("_l", local).join(before, ["file", "_b"]).select("file", (F.col("_l") + F.col("_o")).alias("line_no"), "value")


def line(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n-th line (from 1) of each file; no row where a file is shorter."""
    return numbered_lines(spark, path).where(F.col("line_no") == n)


def line_hashes(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("file", "line_no", F.octet_length("value").alias("length"), F.sha2("value", 256).alias("sha256"))


def first_keys(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first JSON object that is neither blank nor a # comment; empty without one."""
    d = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.json_object_keys("value").alias("k")).where("k is not null")
    row = d.first()
    return list(row["k"]) if row else []


def source_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def scan_counts(df: DataFrame, kept: Column, correct: Column) -> DataFrame:
    """One row: all, kept, dropped and kept-and-correct records."""
    return df.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_if(kept & correct).alias("kept_correct"))


def train_test(df: DataFrame, key: str, test_size: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Seeded order; the first ``test_size`` rows are the test set, all others the training set."""
    test = reservoir(df, key, test_size, seed)
    return df.join(test.select(key), key, "left_anti"), test


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_by_group(df: DataFrame, path: str, group: str, mode: str = "error") -> None:
    """A folder per value of the group, nulls under __MISSING__, names made safe for files."""
    df.withColumn("bucket", file_name(group_name(group))).write.mode(mode).partitionBy("bucket").json(path)


def write_good_bad(df: DataFrame, path: str, mode: str = "error") -> None:
    """One write for both halves: partitions of ``keep`` with the hit names in ``filter_debug``."""
    d = df.withColumn("filter_debug", F.struct("hits", "keep")).withColumn("part", F.when(F.col("keep"), "good_samples").otherwise("bad_samples"))
    d.drop("hits", "keep").write.mode(mode).partitionBy("part").json(path)


def write_step(df: DataFrame, path: str, step: str = "step", mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(step).json(path)


def export_sample(df: DataFrame, key: str, n: int = 3, seed: int = 0) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(n)


def rollout_lines(df: DataFrame) -> DataFrame:
    """Each record as one JSON line (``value``); absent fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def metric_line(step: int, data: dict[str, float]) -> str:
    return json.dumps({"step": step, "data": data})
