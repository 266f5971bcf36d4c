import os
import tempfile

from pyspark.sql import functions as F

from tallyloom.operators import dedup as D, html as H, models as M
from tallyloom.plans import q_pages as Q
from tests_data import SF


def test_a_failing_model_is_resumed_without_a_repeated_call(spark):
    home = tempfile.mkdtemp(prefix="model-")
    schema = "id long, answer string"
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(None, "no key"), (3, "text 3")], "id long, text string")

    def told(ids):
        for i in ids:
            open(f"{home}/asked-{i}-{os.getpid()}-{os.urandom(4).hex()}", "w").close()

    def breaks(b):
        if (b["id"] >= 60).any():
            raise ConnectionError("gone")
        told(b["id"])
        return b[["id"]].assign(answer=b["text"].str.upper())[b["id"] != 7]  # no answer for one

    def works(b):
        assert (b["id"] >= 60).all() or list(b["id"]) == [7]
        told(b["id"])
        return b[["id"]].assign(answer=b["text"].str.upper())

    assert M.call_model(rows, breaks, schema, f"{home}/out", parts=4, batch_rows=1) == 41
    assert M.results(spark, f"{home}/out", schema).count() == 59
    assert M.call_model(rows, works, schema, f"{home}/out", parts=4, batch_rows=1) == 0
    assert sorted((r.id, r.answer) for r in M.results(spark, f"{home}/out", schema).collect()) == [(i, f"TEXT {i}") for i in range(100)]
    asked = [int(f.split("-")[1]) for f in os.listdir(home) if f.startswith("asked")]
    assert sorted(asked) == sorted([*range(100), 7])
    assert M.call_model(rows, works, schema, f"{home}/out") == 0


def test_nodes_by_table_function(spark):
    assert sorted(map(str, Q.visible_text_sql(spark, SF).collect())) == sorted(map(str, Q.visible_text(spark, SF).collect()))
    H.register_html_nodes(spark)
    rows = spark.sql("SELECT n.* FROM VALUES ('<p>a<b>b</b></p>'), (NULL) AS t(h), LATERAL html_nodes(h) n").collect()
    assert [(r.tag, r.bold, r.text) for r in rows] == [("p", False, "a"), ("p", True, "b")]


def test_a_strategy_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 9, "y"), (2, "c", 1, "z")], "cluster long, id string, doc_id long, text string").withColumns({c: F.lit("") for c in ("fp", "period", "source")})
    got = {r.cluster: r.id for r in D.canonical_records(rows, lambda: F.col("source") == F.lit("s")).collect()}
    assert got == {1: "a", 2: "c"}
    got = {r.cluster: r.id for r in D.canonical_records(rows, lambda: F.col("text")).collect()}
    assert got == {1: "b", 2: "c"}
