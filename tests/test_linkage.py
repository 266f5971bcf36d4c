"""Linkage in rounds against a walk over all edges in one order."""

import random

import pytest

from tallyloom.operators import linkage as L
from tallyloom.plans import q_dedup as Q
from tallyloom.plans.registry import QUERIES
from tests_data import SF

EDGE = "a_id long, b_id long, score double"


def walk(n, edges, cap, whole):
    member = {i: {i} for i in range(n)}
    linked = {(a, b) for a, b, _ in edges}
    refused = []
    for down, a, b in sorted((-s, a, b) for a, b, s in edges):
        x, y = member[a], member[b]
        if x is y:
            continue
        if whole and any((min(p, q), max(p, q)) not in linked for p in x for q in y):
            refused.append((a, b, -down, "veto"))
        elif len(x) + len(y) > cap:
            refused.append((a, b, -down, "size_cap"))
        else:
            x |= y
            for m in y:
                member[m] = x
    return {i: min(member[i]) for i in range(n)}, sorted(refused)


def groups(dice, n, width, density, places):
    return [(a, b, round(dice.random(), places)) for a in range(n) for b in range(a + 1, min(n, a + width)) if dice.random() < density]


@pytest.mark.parametrize(("seed", "tail", "cap"), [(1, 0, 6), (2, 40, 3), (3, 5000, 6)])
def test_complete_linkage(spark, seed, tail, cap):
    dice = random.Random(seed)
    edges = groups(dice, 90, 9, 0.75 if cap < 6 else 0.95, 2)
    nodes = spark.range(95)
    clusters, refused = L.complete_linkage(nodes, spark.createDataFrame(edges, EDGE), cap, tail)
    want, want_refused = walk(95, edges, cap, True)
    assert {r.id: r.cluster for r in clusters.collect()} == want
    assert sorted((r.a_id, r.b_id, r.score, r.reason) for r in refused.collect()) == want_refused
    assert {r[3] for r in want_refused} == {"veto", "size_cap"}


@pytest.mark.parametrize(("seed", "tail", "cap"), [(4, 0, 5), (5, 30, 12)])
def test_single_linkage_with_a_cap(spark, seed, tail, cap):
    edges = groups(random.Random(seed), 80, 6, 0.5, 2)
    found = L.single_linkage(spark.range(80), spark.createDataFrame(edges, EDGE), cap, tail)
    assert {r.id: r.cluster for r in found.collect()} == walk(80, edges, cap, False)[0]


def test_one_component_of_many_edges(spark):
    """100,000 edges that hang together, in rounds until 5,000 pairs are left."""
    dice = random.Random(6)
    edges = sorted({(min(a, b), max(a, b)) for a in range(20_000) for b in {(a + d) % 20_000 for d in range(1, 6)}})
    edges = [(a, b, dice.random()) for a, b in edges]
    nodes = spark.range(20_000)
    clusters, refused = L.complete_linkage(nodes, spark.createDataFrame(edges, EDGE))
    want, want_refused = walk(20_000, edges, 6, True)
    assert {r.id: r.cluster for r in clusters.collect()} == want
    assert sorted((r.a_id, r.b_id, r.score, r.reason) for r in refused.collect()) == want_refused


def test_odd_edges(spark):
    odd = [(1, 1, 0.9), (2, 1, 0.9), (1, 2, 0.8), (None, 3, 0.9), (3, 4, None)]
    clusters, refused = L.complete_linkage(spark.range(5), spark.createDataFrame(odd, EDGE))
    assert sorted((r.id, r.cluster) for r in clusters.collect()) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4)]
    assert refused.collect() == []
    clusters, refused = L.complete_linkage(spark.range(2), spark.createDataFrame([], EDGE))
    assert clusters.count() == 2 and refused.collect() == []


@pytest.mark.parametrize(("query", "cap", "whole"), [(Q.complete_linkage, 6, True), (Q.capped_linkage, 6, False)])
def test_queries_equal_the_walk(spark, query, cap, whole):
    edges = [tuple(r) for r in Q.pairs(spark, SF).filter("score >= 0.75").select("a_id", "b_id", "score").collect()]
    got = {r.id: r.cluster for r in query(spark, SF).collect()}
    want, _ = walk(max(got) + 1, edges, cap, whole)
    assert edges and got == {i: want[i] for i in got}


@pytest.mark.parametrize("name", ["ded_09_members", "ded_10", "ded_10_pairs", "ded_11", "ded_12"])
def test_texts_do_not_move_with_clusters(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_first_sightings_of_repeated_ids(spark, tmp_path):
    def found(rows):
        home = str(tmp_path / f"{len(rows)}")
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{home}/documents.parquet")
        return sorted((r.id, r.text, r.source) for r in Q.reps(spark, home).collect())

    once = [(1, "one text", "en", "a"), (2, "one text", "en", "b"), (3, "another", "en", "a")]
    assert found(once) == [(1, "one text", "a"), (3, "another", "a")]
    assert found([*once, (3, "another", "en", "a"), (3, "third", "en", "c")]) == [(1, "one text", "a"), (3, "another", "a"), (3, "third", "c")]
