"""Cutting lineage with a written table in the folder that the cluster shares.

Executors can be lost at any time, so intermediate results that are read more than once are
written as Parquet below `spark.checkpoint.dir`. Only where that setting is absent (a local
session, as in tests) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a temporary folder if the session has none (local runs)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tallyloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/tallyloom/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, label: str = "step", compression: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and return it as read back from there; `compression` is Parquet's, the session's if none is given."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
