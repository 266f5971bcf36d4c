from pyspark.sql import functions as F

from tallyloom.plans import base as B, q_dedup
from tests_data import SF


def test_integrity_groups_in_parts_that_grow_with_the_rows(spark, monkeypatch):
    """Each part of the bank is bounded, and an identity lies in one of them."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(B, "BANK_ROWS", rows // 8)
    parts = B.spread_bank(spark, SF).groupBy(F.spark_partition_id().alias("part")).agg(F.collect_set("f_id").alias("ids")).collect()
    assert len(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(len(r.ids) for r in parts) == len({i for r in parts for i in r.ids})
    few = {r.problem: r.n for r in q_dedup.integrity(spark, SF).collect()}
    monkeypatch.setattr(B, "BANK_ROWS", 10 * rows)
    assert few == {r.problem: r.n for r in q_dedup.integrity(spark, SF).collect()}
