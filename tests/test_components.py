import random

from tallyloom.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = connected_components(spark.createDataFrame(edges + [(7, None)], "a long, b long"))
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.id: r.component for r in got.collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
