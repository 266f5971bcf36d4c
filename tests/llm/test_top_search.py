"""Exact top-k search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import top_search as K

SCHEMA = "vec_id long, embedding array<float>"


def plainly(rows, k, every):
    fine = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (qi, q) in enumerate(fine):
        if qi % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(fine) if a != b and len(v) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=3, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("own") for c in ("at", "ids", "score", "block")})
    got = sorted(tuple(r) for r in K.top_search(df, F.col("vec_id") % every == 0, k, **how).collect())
    assert got == plainly(rows, k, every)


@pytest.mark.parametrize("lists", [1, 3, 4])
def test_random_with_ties_and_copies(spark, lists, monkeypatch):
    monkeypatch.setattr(K, "SPAN_ROWS", 40)
    monkeypatch.setattr(K, "QUERY_BLOCK", 30)
    monkeypatch.setattr(K, "TILE", 500)
    dice = np.random.default_rng(lists)
    rows = [(i, dice.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)]
    rows += [(i, [0.5, -0.25, 0.1, 0.0, 1.0, -1.0]) for i in range(150, 230)]
    check(spark, rows, lists=lists)


def test_all_scores_below_zero(spark):
    check(spark, [(i, [1.0, 0.5] if i % 3 == 0 else [-1.0 - i, -0.25]) for i in range(20)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, None), (3, [None, 1.0]), (6, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (9, []), (12, []), (15, [1.0, 2.0, 3.0]), (1, [0.1, -0.1]), (18, [3e4, 2e4]), (21, [1e6, -1e6]), (-3, [0.001, 7.0])]
    check(spark, rows)
    check(spark, rows[:1])
    assert K.top_search(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    assert K.top_search(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect() == []
