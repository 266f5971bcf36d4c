"""Products of blocks against numpy over all pairs."""

import numpy as np
import pytest

from tallyloom.operators import knn as K, products as P

SCHEMA = "f_id long, embedding array<double>"


def vectors(spark, n=130, dim=5, seed=1, copies=0):
    dice = np.random.default_rng(seed)
    m = dice.standard_normal((n, dim))
    m[:copies] = m[0]
    m /= np.linalg.norm(m, axis=1)[:, None]
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA)


def scores(m):
    return np.sort((m @ m.T)[np.triu_indices(len(m), 1)])


@pytest.mark.parametrize("block", [7, 60, 4096])
def test_pairs_and_strongest(spark, block):
    m, df = vectors(spark)
    s = m @ m.T
    want = sorted((a, b) for a in range(130) for b in range(a + 1, 130) if s[a, b] >= 0.5)
    assert sorted((r.a_id, r.b_id) for r in P.dense_pairs(df, 0.5, block).collect()) == want
    best = sorted((-round(s[a, b], 6), a, b) for a, b in want)[:20]
    assert [(r.a_id, r.b_id) for r in P.top_pairs(df, 20, 0.5, 6, block).collect()] == [(a, b) for _, a, b in best]


@pytest.mark.parametrize("copies", [0, 50])
def test_quantiles_without_pairs(spark, copies):
    m, df = vectors(spark, copies=copies)
    all_ = scores(m)
    for at in (0, 17, len(all_) // 2, len(all_) - 1):
        assert P.scores_at(df, [at], bins=4, block_rows=50)[at] == pytest.approx(all_[at], abs=1e-12)
    got = P.score_quantiles(df, (0.1, 0.5, 0.999), block_rows=50, bins=64).first()
    assert got["pairs"] == len(all_)
    assert [got["p10"], got["p50"], got["p99_9"], got["min"], got["max"]] == [round(float(x), 6) for x in (*np.quantile(all_, [0.1, 0.5, 0.999]), all_[0], all_[-1])]
    assert got["min"] < 0


def test_few_vectors(spark):
    m, df = vectors(spark, 2)
    assert P.score_quantiles(df, (0.5,)).first()["p50"] == round(float(m[0] @ m[1]), 6)
    assert list(P.score_quantiles(df.limit(1), (0.5,)).first()) == [0, None, None, None]
    assert P.dense_pairs(df.filter("f_id < 0"), 0.1).collect() == []
    assert P.similar_pairs(df.filter("f_id < 0"), 0.1).collect() == []
    with pytest.raises(Exception, match="different length"):
        P.dense_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0])], SCHEMA), 0.1).collect()


def test_random_projections_find_nine_tenths(spark):
    dice = np.random.default_rng(3)
    centres = np.repeat(dice.standard_normal((60, 24)), 8, axis=0)
    m = centres + 0.35 * dice.standard_normal(centres.shape)
    m[:30] = m[0]  # copies fill one bucket of each table
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA)
    s = m @ m.T
    want = {(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if s[a, b] >= 0.85}
    rows = [(r.a_id, r.b_id) for r in P.similar_pairs(df, 0.85, block_rows=20).collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want
    assert len(rows) >= 0.9 * len(want) > 600


@pytest.mark.parametrize(("cells", "block"), [(4000, 4000), (15, 4000), (40, 6)])
def test_nearest_neighbours_in_cells(spark, cells, block):
    m, df = vectors(spark, 140, 3, 5, copies=60)
    s = np.round(m @ m.T, 12)
    want = []
    for a in range(140):
        best = sorted((-s[a, b], b) for b in range(140) if b != a)[:4]
        want += [(a, r + 1, b) for r, (_, b) in enumerate(best)]
    got = K.exact_knn(df, df, 4, block_rows=block, cell_rows=cells)
    assert sorted((r.q_id, r.rank, r.f_id) for r in got.collect()) == want
    few = K.exact_knn(df.filter("f_id < 9"), df, 8, searchable=df.f_id >= 135, cell_rows=cells).collect()
    assert len(few) == 9 * 5 and {r.f_id for r in few} == set(range(135, 140))


def test_cells_far_away_are_skipped(spark):
    dice = np.random.default_rng(8)
    m = np.repeat(dice.standard_normal((20, 16)), 30, axis=0) + 0.02 * dice.standard_normal((600, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA)
    row = K.visits_of(df, df, 5, cell_rows=30).first()
    assert row.cells > 10 and row.skipped > 0.5
    assert K.exact_knn(df, df.filter("f_id < 0"), 5).collect() == []


def test_what_meets_later_moves_packed(spark):
    """Neither a visit to a cell nor a bucket's row carries a vector of its own."""
    _, df = vectors(spark, 300, 16)
    _, visits, about = K._search(df, df, 5, 50, None, 5)
    assert about["cells"] > 30 and "embedding" not in visits.columns
    plan = P.similar_pairs(df, 0.5, bits=4)._jdf.queryExecution().executedPlan().toString()
    assert "data#" in plan and "posexplode" not in plan
