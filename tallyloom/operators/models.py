"""Calling a model (labels, embeddings) on table rows, in parts that are kept, so that a failure costs only what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.operators.materialize import materialize


def results(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The rows that calls gave so far: key and answer columns of `schema`."""
    return _all(spark, store, schema).filter("_error IS NULL").drop("_error")


def _all(spark: SparkSession, store: str, schema: str) -> DataFrame:
    fields = StructType([*StructType.fromDDL(schema).fields, StructField("_error", StringType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(store)


def call_model(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, store: str, parts: int = 8, batch_rows: int = 100) -> int:
    """Call `call` on the rows of `rows` whose key has no result in `store` yet; returns how many still lack one.

    `schema` begins with the key column, which `rows` has, then the columns that `call` adds. A call
    gets up to `batch_rows` rows and gives some of their keys with answers. If it raises, its rows are
    stored with the error and count as not done; rows it leaves out do as well. Rows are dealt
    into `parts`, and each part's results are written before the next begins: when the run itself dies, the next
    one takes up what is left. Only a task that Spark repeats calls twice. Rows without key are left out; a repeated key is called once.
    """
    spark = rows.sparkSession
    key = StructType.fromDDL(schema).fieldNames()[0]
    names = [*StructType.fromDDL(schema).fieldNames(), "_error"]

    def left() -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(results(spark, store, schema).select(key), key, "left_anti")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch_rows):
                some = b.iloc[at : at + batch_rows]
                try:
                    yield call(some).assign(_error=None).reindex(columns=names).astype(object)
                except Exception as e:  # noqa: BLE001  what a model may raise isn't known
                    yield some[[key]].assign(_error=f"{type(e).__name__}: {e}"[:500]).reindex(columns=names).astype(object)

    waiting = materialize(left().withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))), "waiting")
    for part in range(parts):
        mine = waiting.filter(F.col("_part") == part).drop("_part")
        mine.mapInPandas(run, f"{schema}, _error string").write.mode("append").parquet(store)
    return left().count()
