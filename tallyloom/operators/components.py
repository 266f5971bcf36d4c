"""Connected components as a chain of edge contractions.

Each round orders the nodes by a hash seeded with the round, maps every node to the first one
next to it (itself included), rewrites the edges to the mapped ends and drops loops and repeats.
The random order keeps the number of rounds logarithmic even on long chains. Edges shrink each
round; every round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.materialize import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """`(id, component)` for every node of `edges`; component is the smallest id reachable.

    Edges with a null end and loops carry no link and are ignored; repeated and reversed edges
    count once. An empty input gives an empty result. Raises if `max_rounds` rounds don't suffice.
    """
    pair = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pair = materialize(pair.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels = None
    for seed in range(max_rounds):
        if pair.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = pair.select(F.col("a").alias("v"), F.explode(F.array(order("a"), order("b"))).alias("to"))
        both = both.unionByName(pair.select(F.col("b").alias("v"), F.explode(F.array(order("a"), order("b"))).alias("to")))
        step = materialize(both.groupBy("v").agg(F.min("to").alias("to")).select("v", F.col("to.id").alias("to")), "nearest")
        if labels is None:
            labels = step.select(F.col("v").alias("id"), F.col("to").alias("component"))
        else:
            labels = labels.join(step, F.col("component") == F.col("v"), "left").select("id", F.coalesce("to", "component").alias("component"))
            labels = materialize(labels, "labels")
        moved = pair.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
        moved = moved.join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        pair = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return pair.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = materialize(labels.groupBy("component").agg(F.min("id").alias("least")), "least")
    return labels.join(least, "component").select("id", F.col("least").alias("component"))
