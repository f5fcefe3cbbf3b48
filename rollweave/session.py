"""Session helpers: shared scratch folder, lineage cuts, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (local runs, tests) is a folder of our own
    made; it is removed when the driver ends. On a cluster a folder of one machine would serve nobody, so there the
    setting is asked for.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rollweave-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs a file read,
    not a recomputation, and later passes prune columns.
    """
    path = f"{scratch_dir(df.sparkSession)}/rollweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
