"""Global shuffle into shards by a two-pass external shuffle (operator 5), in DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two numbers
each bucket's records in the order of another seeded hash, permutes the numbers with `shuffle`, which is
Fisher-Yates (inside out) on an array, and lays the buckets end to end; position p of the whole goes to shard
p mod n, slot p div n. The numbers alone are an array, four bytes a record; the records are sorted and joined. Shards so differ by one row at most (the law `rows`), whatever the texts are.

`shuffle` draws from a generator that starts anew, with the seed and the partition's number, in
every partition. As a bucket's numbers are a partition, its draws depend on seed, bucket and position alone: a
record's place doesn't depend on how the input was partitioned, and a repeated task finds it again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.common import documents
from tallyloom.operators.materialize import materialize

SHARDS = 40
SEED = 20240717
BUCKET_BYTES = 4 << 20  #: of a bucket, if that makes no more than FEW_BUCKETS
FEW_BUCKETS = 4_000
MOST_BYTES = 512 << 20  #: of a bucket, however large the input is; 100 TB make 195,000 buckets
MIN_BUCKETS = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (0 for null) and 16 for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def bucket_count(size: int) -> int:
    """How many buckets `size` bytes go to: of BUCKET_BYTES each, then FEW_BUCKETS that grow to MOST_BYTES, then of MOST_BYTES each."""
    return max(MIN_BUCKETS, min(math.ceil(size / BUCKET_BYTES), FEW_BUCKETS), math.ceil(size / MOST_BYTES))


def _numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with `_copy`: 0, but counted from 0 among rows that are equal in all `columns`.

    Equal rows can't be told apart, so it doesn't matter which has which number. Such rows are
    counted first, by hash; only where there are some, they are made anew from one row and its count.
    """
    key = F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))
    counted = docs.groupBy(key.alias("_key")).agg(F.count("*").alias("_copies"))
    repeated = materialize(counted.filter("_copies > 1"), "repeated_rows")
    if repeated.isEmpty():
        return docs.withColumn("_copy", F.lit(0).cast("long"))
    keyed = docs.withColumn("_key", key)
    once = keyed.join(repeated.select("_key"), "_key", "left_anti").select(*docs.columns, F.lit(0).cast("long").alias("_copy"))
    some = keyed.join(repeated.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.any_value(F.struct(*docs.columns)).alias("_row"))
    many = some.join(repeated, "_key").select("_row.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
    return once.unionByName(many)


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `_shard` (int, from 0) and `_slot` (long, gapless from 0 in each shard).

    The buckets are `buckets` or bucket_count() of the records' bytes. Records are spread by a hash
    of all their columns but maps, so equal texts under different ids part, and rows that repeat in
    all of them are numbered and part by their number. Nulls are hashed like values. The same rows,
    seed and buckets give the same places under any partitioning. An empty table gives no rows.
    Other columns stay, whatever their names, except that `_shard` and `_slot` are replaced.
    """
    docs = docs.drop("_shard", "_slot")
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    if buckets is None:
        buckets = bucket_count(docs.agg(F.coalesce(F.sum(record_size(F.col(text_col))), F.lit(0))).first()[0])
    numbered = _numbered(docs, hashed)
    place = F.pmod(F.xxhash64(F.lit(seed), *hashed, "_copy"), F.lit(buckets)).cast("int")
    # A row for each bucket: at most a few hundred thousand, so one task can add them up and all can hold them.
    counts = numbered.groupBy(place.alias("_bucket")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    keyed = numbered.select(place.alias("_bucket"), F.xxhash64(F.lit(seed + 1), *hashed, "_copy").alias("_k"), F.xxhash64(F.lit(seed + 2), *hashed, "_copy").alias("_k2"), F.struct(*docs.columns).alias("_r"))
    # Rows of a bucket are sorted, which spills; only the permutation of their numbers is an array.
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_k", "_k2")) - 1).drop("_k", "_k2")
    dealt = counts.repartitionById(buckets, "_bucket").select("_bucket", F.shuffle(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), seed).alias("_order"))
    dealt = dealt.join(F.broadcast(offsets), "_bucket").select("_bucket", "_before", F.posexplode("_order").alias("_at", "_rank"))
    at = F.col("_before") + F.col("_at")
    laid = ranked.join(dealt.select("_bucket", "_rank", at.alias("_place")), ["_bucket", "_rank"])
    return laid.select("_r.*", (F.col("_place") % shards).cast("int").alias("_shard"), F.floor(F.col("_place") / shards).cast("long").alias("_slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the result of shuffle_to_shards() as Parquet, a folder `_shard=k` each, files in slot order."""
    placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 5; its law is `rows`."""
    placed = shuffle_to_shards(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
