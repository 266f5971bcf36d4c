"""Operator 5 against a plain two-pass shuffle, and under other partitionings."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_data import SF

from tallyloom.llm import sharding as S


def plain_order(n, seed):
    """Fisher-Yates inside out, drawn from a Mersenne twister that takes the seed in two halves."""
    twister = np.random.RandomState()
    twister.seed([seed >> 32, seed & 0xFFFFFFFF])

    def below(k):
        while True:
            bits = int(twister.randint(0, 2**32, dtype=np.uint32)) >> 1
            if k & (k - 1) == 0:
                return k * bits >> 31
            if bits - bits % k + k - 1 < 2**31:
                return bits % k

    order = []
    for i in range(n):
        j = below(i + 1)
        order.append(order[j] if j < i else i)
        order[j] = i
    return order


def places(df):
    return sorted((r.doc_id, r.text, r._shard, r._slot) for r in df.collect())


def test_equals_the_plain_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    seed, buckets = 99, 5
    keyed = docs.withColumn("_copy", F.lit(0).cast("long"))
    h = lambda k: F.xxhash64(F.lit(seed + k), "doc_id", "text", "_copy")
    rows = keyed.select("doc_id", "text", F.pmod(h(0), F.lit(buckets)).alias("b"), h(1).alias("k")).collect()
    want, at = [], 0
    for b in range(buckets):
        own = sorted((r for r in rows if r.b == b), key=lambda r: r.k)
        for i in plain_order(len(own), seed + b):
            want.append((own[i].doc_id, own[i].text, at % 7, at // 7))
            at += 1
    assert places(S.shuffle_to_shards(docs, shards=7, seed=seed, buckets=buckets)) == sorted(want)


def test_same_places_under_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id = 2"))
    found = []
    for parts, shuffled in ((1, 4), (7, 3), (13, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
        found.append(places(S.shuffle_to_shards(docs.repartition(parts, F.hash("text")), shards=7)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()
    assert found[0] != places(S.shuffle_to_shards(docs, shards=7, seed=1))


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = places(S.shuffle_to_shards(docs, shards=7))
    for k in range(7):
        slots = sorted(r[3] for r in got if r[2] == k)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(got) / 7) < 1


def test_repeated_rows_part(spark):
    docs = spark.range(4_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = S.shuffle_to_shards(docs, buckets=8).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in got) == 4_000 and max(r["count"] for r in got) < 700


@pytest.mark.parametrize(("size", "want"), [(0, 16), (1 << 30, 256), (1 << 40, 4_000), (100 << 40, 204_800)])
def test_buckets_stay_in_memory(size, want):
    assert S.bucket_count(size) == want and size / want <= S.MOST_BYTES


def test_query_columns(spark):
    got = S.op5_sharding(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    counts = [sum(r.shard == k for r in rows) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and all(0 <= r.slot < math.ceil(len(rows) / 40) for r in rows)
