"""The size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession


BATCH_BYTES = 4 << 20  #: of an Arrow batch, unless one row is larger


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Make Arrow batches small enough for whole, long texts; a smaller setting of the session stays."""
    bytes_key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(bytes_key, "64m")
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(bytes_key, str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
