"""Incremental intake by Structured Streaming; every result is recomputed from stored rows, so replays change nothing.

Stored rows lie in folders by drop and by a hash of their key. A drop reads and rewrites only the
hashes that its keys have; the rest of the store isn't opened.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyloom.operators.layers import roll_up
from tallyloom.operators.materialize import materialize, scratch_path

BUCKETS = 64
SPLIT = 8  #: tasks that may write one bucket of a drop
FEW_KEYS = 200_000  #: sightings of a drop whose keys are broadcast to the stored ones


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared directory, which goes with the application."""
    return scratch_path(spark, label)


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    schema = spark.read.parquet(path).schema
    # A pattern that matches the path itself serves for a single file and for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + "[" + path[-1] + "]")


def run_to_end(writer) -> list[dict]:
    """Start a query with all available input and wait for it; its error is ours. Returns the progress of its batches."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]


class KeyedStore:
    """A Parquet folder laid out as `drop=<number>/bucket=<hash of the key>`."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema: StructType | None = None  # known after a drop, else taken from the files

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def put(self, rows: DataFrame, number: int) -> DataFrame:
        """Write a drop in place of what stands under its number, and return it."""
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SPLIT))
        rows.withColumn("bucket", self.bucket()).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/drop={number}")
        self.schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType()), StructField("drop", LongType())])
        return self.spark.read.schema(StructType(self.schema.fields[:-1])).parquet(f"{self.path}/drop={number}")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of `rows`, of which there are `buckets` at most."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All drops, or only these buckets of them; both are folders, so others aren't listed for reading."""
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        rows = reader.option("basePath", self.path).parquet(self.path)
        return rows.filter(F.col("bucket").isin(buckets)) if buckets is not None else rows


class SightingStore:
    """Stored sightings and identities, brought up to date drop by drop.

    A drop replaces what an earlier drop of the same number wrote, and sightings count by id, so a
    drop that is delivered twice changes nothing. The identities of a drop's keys are computed anew
    from the sightings in their buckets, and written as a new version of these identities only: what
    a drop writes is as large as the drop. Of a key the newest version holds. Texts of stored
    sightings are read where they lie, for a drop of up to FEW_KEYS keys.
    """

    KEYS = ["tache", "fp"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.store = KeyedStore(spark, f"{path}/sightings", self.KEYS, buckets)

    def sightings(self) -> DataFrame:
        return self.store.read().drop("drop", "bucket")

    def take(self, batch: DataFrame, number: int) -> list[int]:
        """Take a drop in; returns the buckets that were read and written."""
        fresh = self.store.put(batch.dropDuplicates(["id"]), number)
        touched = self.store.touched(fresh)
        if not touched:
            return touched
        keys = fresh.select("bucket", *self.KEYS).distinct()
        small = F.broadcast if fresh.count() <= FEW_KEYS else lambda rows: rows
        stored = self.store.read(touched)
        near = stored.select("bucket", *self.KEYS, "id", "period", "drop").join(small(keys), ["bucket", *self.KEYS], "left_semi")
        # The drop that came last tells of an id; where its newest sighting lies stands for an identity's text.
        once = near.groupBy("id").agg(F.max_by(F.struct("bucket", *self.KEYS, "period", "drop"), "drop").alias("s")).select("id", "s.*")
        new = materialize(roll_up(once.withColumn("text", F.struct("drop", "id")), ("bucket", *self.KEYS)), "identities")
        place = new.select("bucket", *self.KEYS, F.col("text.drop").alias("drop"), F.col("text.id").alias("id"), *[c for c in new.columns if c not in ("bucket", *self.KEYS, "text")])
        texts = stored.select("bucket", "drop", "id", "text").join(small(place), ["bucket", "drop", "id"])
        rows = texts.select("bucket", *self.KEYS, *[c for c in new.columns if c not in ("bucket", *self.KEYS)])
        version = max(self.versions(), default=-1) + 1
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/identities/version={version}")
        return touched

    def versions(self) -> list[int]:
        """The numbers of the versions of identities that were written."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/identities")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return [int(n.partition("=")[2]) for n in names if n.startswith("version=")]

    def identities(self, buckets: list[int] | None = None) -> DataFrame:
        """All identities, or those of some buckets with their `bucket`."""
        rows = self.spark.read.parquet(f"{self.path}/identities")
        rows = rows.filter(F.col("bucket").isin(buckets)) if buckets is not None else rows
        if len(self.versions()) > 1:
            newest = rows.groupBy("bucket", *self.KEYS).agg(F.max("version").alias("version")).select(*[F.col(c).alias(f"_{c}") for c in ("bucket", *self.KEYS, "version")])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("bucket", *self.KEYS, "version")]
            rows = rows.join(newest, same[0] & same[1] & same[2] & same[3], "left_semi")
        return rows.drop("version") if buckets is not None else rows.drop("version", "bucket")


def stream_intake(sightings: DataFrame, store: SightingStore, checkpoint: str) -> None:
    """Feed a stream of sightings into the store."""

    def take(batch: DataFrame, number: int) -> None:
        store.take(batch, number)

    run_to_end(sightings.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint))


def stream_distinct(rows: DataFrame, keys: list[str], arrived: str, delay: str, store: KeyedStore, checkpoint: str) -> list[dict]:
    """Store the first row of each key across drops; returns the progress of the run.

    `arrived` is when a row came in, so it never runs backwards by more than `delay`. The stream's state
    holds the keys of the last `delay` only; what repeats later is found by an anti join with the
    stored rows in the buckets of the drop's keys.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "distinct")
        if store.exists():
            known = store.read(store.touched(batch)).filter(F.col("drop") != number)
            batch = batch.join(known.select(*keys), keys, "left_anti")
        store.put(batch, number)

    first = rows.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(keys)
    return run_to_end(first.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint))


def monthly_counts(sightings: DataFrame, late: str = "62 days") -> DataFrame:
    """Sightings of each month of `period_start`; the two newest months stay open for late rows."""
    return sightings.withWatermark("period_start", late).groupBy("period_start", "source").agg(F.count("*").alias("n"))


def stream_monthly(sightings: DataFrame, path: str, checkpoint: str) -> dict:
    """Keep the newest count of each month and source as versions by run and batch; returns what came in.

    The result has `rows`, all that the run read, and `late`, how many of them came behind the watermark and were
    not counted: what was read less what the counts grew by. `late_groups` is Spark's own figure, which
    counts a month and source once for each task that dropped it.
    """
    before = _counted(sightings.sparkSession, path)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    seen = sightings.observe("intake", F.count(F.lit(1)).alias("rows"))
    progress = run_to_end(monthly_counts(seen).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint))
    rows = sum(p["observedMetrics"].get("intake", {}).get("rows", 0) for p in progress)
    late_groups = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    return {"rows": rows, "late": rows - (_counted(sightings.sparkSession, path) - before), "late_groups": late_groups}


def newest_counts(spark: SparkSession, path: str) -> DataFrame:
    """`(period_start, source, n)` as the last batch that changed each left it."""
    return spark.read.parquet(path).groupBy("period_start", "source").agg(F.max_by("n", "batch").alias("n"))


def _counted(spark: SparkSession, path: str) -> int:
    if not KeyedStore(spark, path, []).exists():
        return 0
    return newest_counts(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
