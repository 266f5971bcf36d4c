import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import flags as S, intake as I

SCHEMA = "id string, tache int, period string, text string, fp string"


@pytest.fixture
def home():
    path = tempfile.mkdtemp(prefix="intake-")
    yield path
    shutil.rmtree(path)


def test_order_and_repetition_of_drops_do_not_matter(spark, home):
    rows = [(f"{i:03d}", 2, f"2024-{i % 5 + 1:02d}", f"text {i % 7}", f"fp{i % 7}") for i in range(60)]
    drops = [spark.createDataFrame(rows[a : a + 20], SCHEMA) for a in (0, 20, 40)]
    found = []
    for order in ((0, 1, 2), (2, 0, 1, 1)):
        store = I.SightingStore(spark, f"{home}/{len(found)}")
        for n, k in enumerate(order):
            store.take(drops[k], min(n, 2))
        found.append(sorted(map(str, store.identities().collect())))
    assert found[0] == found[1] and len(found[0]) == 7


def test_a_drop_opens_only_the_buckets_of_its_keys(spark, home):
    store = I.SightingStore(spark, home, buckets=32)
    rows = [(f"{i:03d}", 2, "2024-01", f"text {i}", f"fp{i}") for i in range(200)]
    assert len(store.take(spark.createDataFrame(rows, SCHEMA), 0)) == 32
    before = {str(r) for r in store.identities().collect()}
    untouched = {r.p for r in store.identities(list(range(32))).selectExpr("bucket", "_metadata.file_path AS p").distinct().collect()}
    drop = spark.createDataFrame([("900", 2, "2024-03", "newer", "fp5"), ("901", 2, "2024-03", "other", "fp5")], SCHEMA)
    touched = store.take(drop, 1)
    assert len(touched) == 1
    read = store.store.read(touched)
    files = {r.p for r in read.selectExpr("_metadata.file_path AS p").distinct().collect()}
    assert all(f"bucket={touched[0]}/" in f for f in files)
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString()
    now = {r.p for r in store.identities(list(range(32))).selectExpr("_metadata.file_path AS p").distinct().collect()}
    assert all(f"bucket={touched[0]}/" in f for f in now - untouched)
    after = {str(r) for r in store.identities().collect()}
    assert len(after) == 200 and len(after - before) == 1 and "total_sightings=3" in (after - before).pop()
    store.take(drop, 1)
    assert {str(r) for r in store.identities().collect()} == after
    assert store.take(spark.createDataFrame([], SCHEMA), 2) == []


def drops_of(spark, home, drops, schema, run):
    """Each drop as a file of its own, taken by its own run over one checkpoint."""
    out = []
    for n, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/in/drop={n}")
        out.append(run(spark.readStream.schema(schema).parquet(f"{home}/in/*")))
    return out


def test_repeats_within_and_beyond_the_state(spark, home):
    """State holds an hour of keys; a repeat a day later is found in the store."""
    drops = [[(f"k{i}", f"2024-01-0{day} 00:00:00") for i in range(a, b)] for day, a, b in ((1, 0, 100), (1, 90, 100), (3, 100, 110), (5, 0, 5), (5, 200, 201))]
    store = I.KeyedStore(spark, f"{home}/out", ["k"], buckets=8)
    progress = drops_of(
        spark, home, drops, "k string, at string",
        lambda s: I.stream_distinct(s.selectExpr("k", "to_timestamp(at) AS at"), ["k"], "at", "1 hour", store, f"{home}/checkpoint"),
    )
    found = [r.k for r in store.read().collect()]
    assert sorted(found) == sorted({k for d in drops for k, _ in d})
    assert [p[-1]["stateOperators"][0]["numRowsTotal"] for p in progress][-1] < 20


def test_late_rows_are_told(spark, home):
    month = lambda m, n: [(f"2024-{m:02d}-01 00:00:00", "s")] * n
    told = drops_of(
        spark, home, [month(6, 10) + month(5, 4), month(5, 3) + month(2, 7) + month(7, 1), month(4, 2) + month(6, 1)], "at string, source string",
        lambda s: I.stream_monthly(s.selectExpr("to_timestamp(at) AS period_start", "source"), f"{home}/out", f"{home}/checkpoint"),
    )
    assert [(t["rows"], t["late"]) for t in told] == [(14, 0), (11, 7), (3, 2)]
    assert told[1]["late_groups"] >= 1
    counts = {str(r.period_start)[:7]: r.n for r in I.newest_counts(spark, f"{home}/out").collect()}
    assert counts == {"2024-06": 11, "2024-05": 7, "2024-07": 1}


def test_flags_of_late_and_repeated_events(spark, home):
    """Batches of shuffled events, some late, end as the fold of all."""
    dice = random.Random(3)
    events = [(i, f"2024-01-01 00:{dice.randrange(60):02d}:00", dice.randrange(4), dice.randrange(3), dice.choice(S.FLAGS), dice.random() < 0.6) for i in range(240)]
    dice.shuffle(events)
    schema = "event_id long, at string, user_id long, f_id long, flag string, is_on boolean"

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    def run(stream):
        rows = stream.selectExpr("event_id", "to_timestamp(at) AS ts", "user_id", "f_id", "flag", "is_on")
        with S.state_store(spark):
            return I.run_to_end(S.stream_flag_state(rows).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{home}/checkpoint"))

    drops_of(spark, home, [events[:100], events[100:180], events[180:]], schema, run)
    newest = spark.read.parquet(f"{home}/out").groupBy("user_id", "f_id").agg(F.max_by(F.struct(S.FLAGS[0], f"{S.FLAGS[0]}_at", S.FLAGS[1], f"{S.FLAGS[1]}_at"), "batch").alias("r"))
    newest = newest.select("user_id", "f_id", "r.*").filter("bookmarked OR practiced")
    want = S.flag_state(spark.createDataFrame(events, schema).selectExpr("event_id", "to_timestamp(at) AS ts", "user_id", "f_id", "flag", "is_on"))
    assert sorted(map(str, newest.collect())) == sorted(map(str, want.select(*newest.columns).collect()))


def test_flags_by_processor(spark, home, monkeypatch):
    monkeypatch.setattr(S, "stream_flag_state", S.processed_flag_state)
    test_flags_of_late_and_repeated_events(spark, home)


def test_flags_need_no_call_for_each_pair(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, 1, S.FLAGS[0], True)], "event_id long, ts string, user_id long, f_id long, flag string, is_on boolean")
    assert "TransformWithState" not in S.stream_flag_state(rows)._jdf.queryExecution().analyzed().toString()


def test_a_drop_writes_no_more_than_itself(spark, home):
    store = I.SightingStore(spark, home, buckets=4)
    for n in range(4):  # every drop touches every bucket; one key in ten is in all of them
        rows = [(f"{n}-{i:03d}", 2, f"2024-{n + 1:02d}", f"text {n} {i}", f"fp{i if i % 10 == 0 else n * 1000 + i}") for i in range(100)]
        assert len(store.take(spark.createDataFrame(rows, SCHEMA), n)) == 4
    written = spark.read.parquet(f"{home}/identities")
    assert written.count() == 400  # 190 + 280 + 370 would have been written over
    got = {r.fp: r for r in store.identities().collect()}
    assert len(got) == 370 and got["fp0"].total_sightings == 4 and got["fp0"].text == "text 3 0" and got["fp1"].total_sightings == 1
    store.take(spark.createDataFrame(rows, SCHEMA), 7)  # the same sightings again, under another number
    assert {r.fp: r for r in store.identities().collect()} == got
