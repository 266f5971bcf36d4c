"""Rows numbered in one global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.operators.materialize import materialize


def numbered(rows: DataFrame, order: list, name: str = "n", after: int = -1) -> DataFrame:
    """`rows` with `name`: `after` + 1, `after` + 2, ... in `order` (columns or names).

    Ranges of the order are numbered apart and written with their numbers, so that the counts before
    each range belong to the very rows that are read again; ties are numbered once, in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranges")
    counts = placed.groupBy("_part").agg(F.max("_rank").alias("_count"))  # a row for each range
    before = counts.select("_part", F.coalesce(F.sum("_count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_rank") + after).cast("long").alias(name))
