"""Clusters that grow by their strongest edges first, in rounds of edges that are first at both ends.

Walking all edges in one order (score descending, then ids) is sequential, but whether an edge joins
two clusters depends on these alone. An edge that comes first among all that are left at both its
clusters meets them as the walk would: nothing before it can change them. So each round joins all
such edges at once, and the result is the walk's. Edges that can never join again leave: clusters
only grow, so a union that is too large stays too large, and a pair that is missing between two
clusters stays missing.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.components import connected_components
from tallyloom.operators.materialize import materialize

TAIL_PAIRS = 5_000  #: when no more pairs of clusters are left, one task walks them
#: A pair of clusters: the number of edges between them, the first of these, and for both sides name, size and members (where needed).
SIDE = "struct<id:bigint,size:bigint,members:array<bigint>>"
KEY = "struct<down:double,a_id:bigint,b_id:bigint>"


def ordered_edges(edges: DataFrame) -> DataFrame:
    """`(a_id, b_id, score)` with a_id < b_id, each pair once with its best score; loops and nulls are no edges."""
    real = edges.filter("a_id <> b_id AND score IS NOT NULL")
    return real.groupBy(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).agg(F.max("score").cast("double").alias("score"))


def _key() -> Column:
    return F.struct((-F.col("score")).alias("down"), "a_id", "b_id")


def _open(cap: int, whole: bool) -> Column:
    """Whether a pair of clusters may still join."""
    fits = F.col("p.size") + F.col("q.size") <= cap
    return fits & (F.col("n") == F.col("p.size") * F.col("q.size")) if whole else fits


def _walk(cap: int, whole: bool):
    """The same by a heap, for the last few pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size, members, near, out = {}, {}, {}, []
        heap = []
        for r in pdf.itertuples():
            for side in (r.p, r.q):
                size[side["id"]], members[side["id"]] = side["size"], list(side["members"])
            key = (r.key["down"], r.key["a_id"], r.key["b_id"])
            p, q = r.p["id"], r.q["id"]
            near.setdefault(p, {})[q] = near.setdefault(q, {})[p] = (r.n, key)
            heapq.heappush(heap, (key, p, q))
        while heap:
            key, p, q = heapq.heappop(heap)
            if near.get(p, {}).get(q, (0, None))[1] != key:
                continue  # one of them has joined another, which took this edge over
            n = near[p][q][0]
            del near[p][q], near[q][p]
            if size[p] + size[q] > cap or (whole and n != size[p] * size[q]):
                continue
            out.append(({"id": p, "size": size[p], "members": members[p]}, {"id": q, "size": size[q], "members": members[q]}, dict(zip(("down", "a_id", "b_id"), key))))
            size[p], members[p] = size[p] + size[q], members[p] + members[q]
            for other, (m, k) in near.pop(q).items():
                del near[other][q]
                m0, k0 = near[p].get(other, (0, k))
                near[p][other] = near[other][p] = (m0 + m, min(k0, k))
                heapq.heappush(heap, (min(k0, k), *sorted((p, other))))
        return pd.DataFrame(out, columns=["p", "q", "key"])

    return run


def dominant_merges(edges: DataFrame, cap: int, whole: bool, tail_pairs: int = TAIL_PAIRS) -> DataFrame | None:
    """`(p, q, key)`: the unions of the walk over `ordered_edges`, q into p, by edge `key`; None if there are none.

    Unions have `cap` members at most. With `whole`, two clusters join only if every pair across them
    is an edge, and p and q carry their members. A round costs as much as the pairs of clusters that
    are left; edges of falling strength along a chain need a round for each, until `tail_pairs` are left.
    """
    side = lambda c: F.struct(F.col(c).alias("id"), F.lit(1).cast("long").alias("size"), (F.array(c) if whole else F.array().cast("array<bigint>")).alias("members"))
    live = edges.select(side("a_id").alias("p"), side("b_id").alias("q"), F.lit(1).cast("long").alias("n"), _key().alias("key"))
    live = materialize(live.filter(_open(cap, whole)), "pairs")
    done: list[DataFrame] = []
    while left := live.count():
        if left <= tail_pairs:
            done.append(materialize(live.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_walk(cap, whole), f"p {SIDE}, q {SIDE}, key {KEY}"), "unions"))
            break
        best = live.select(F.explode(F.array("p.id", "q.id")).alias("c"), F.struct("key", "p", "q").alias("best")).groupBy("c").agg(F.min("best").alias("best"))
        unions = materialize(best.groupBy("best.key").agg(F.count("*").alias("ends"), F.min("best").alias("best")).filter("ends = 2").select("best.p", "best.q", "best.key"), "unions")
        done.append(unions)
        joined = F.struct(F.col("p.id").alias("id"), (F.col("p.size") + F.col("q.size")).alias("size"), F.concat("p.members", "q.members").alias("members")).alias("to")
        moved = unions.select(F.explode(F.array("p.id", "q.id")).alias("was"), joined)
        for c in ("p", "q"):
            to = moved.select(F.col("was").alias(f"_{c}"), F.col("to").alias(f"_{c}_to"))
            live = live.join(to, F.col(f"{c}.id") == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_{c}_to", c)).drop(f"_{c}", f"_{c}_to")
        sides = F.array_sort(F.array("p", "q"))
        live = live.filter(F.col("p.id") != F.col("q.id")).select(sides[0].alias("p"), sides[1].alias("q"), "n", "key")
        live = live.groupBy("p", "q").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
        live = materialize(live.filter(_open(cap, whole)), "pairs")
    return reduce(DataFrame.unionByName, done) if done else None


def _named(nodes: DataFrame, unions: DataFrame | None, cap: int) -> DataFrame:
    """`(id, cluster)`: the smallest id of each node's cluster. A union's q is gone for good, so following p from q ends at the cluster's name."""
    if unions is None:
        return nodes.select("id", F.col("id").alias("cluster"))
    up = materialize(unions.select(F.col("q.id").alias("id"), F.col("p.id").alias("up")), "up")
    reach = 1
    while reach < cap - 1:
        further = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(further, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "up")
        reach *= 2
    return nodes.select("id").join(up, "id", "left").select("id", F.coalesce("up", "id").alias("cluster"))


def single_linkage(nodes: DataFrame, edges: DataFrame, max_cluster: int | None = None, tail_pairs: int = TAIL_PAIRS) -> DataFrame:
    """`(id, cluster)` of all nodes; clusters are connected components, named by their smallest id.

    With `max_cluster` edges are taken strongest first, and one that would make a cluster larger joins nothing.
    """
    if max_cluster is None:
        found = connected_components(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    return _named(nodes, dominant_merges(ordered_edges(edges), max_cluster, False, tail_pairs), max_cluster)


def complete_linkage(nodes: DataFrame, edges: DataFrame, max_size: int = 6, tail_pairs: int = TAIL_PAIRS) -> tuple[DataFrame, DataFrame]:
    """`(id, cluster)` and the refused edges `(a_id, b_id, score, reason)`.

    Edges join two clusters, strongest first, only if every pair across them is an edge and the
    union has `max_size` members at most. Nothing larger than a cluster comes together, but for the last
    `tail_pairs` pairs of clusters. The reason is what stood against an edge at its turn: `veto` (a pair was missing) or `size_cap`.
    """
    edges = materialize(ordered_edges(edges), "edges")
    unions = dominant_merges(edges, max_size, True, tail_pairs)
    clusters = _named(nodes, unions, max_size)
    if unions is None:
        return clusters, edges.withColumn("reason", F.lit("size_cap"))
    # When two nodes came together: by which edge.
    met = unions.select(F.explode("p.members").alias("x"), F.col("q.members").alias("ys"), "key").select("x", F.explode("ys").alias("y"), "key")
    met = met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y"), "key"))
    near = materialize(met.groupBy("x").agg(F.collect_list(F.struct("key", "y")).alias("near"), F.least("x", F.min("y")).alias("home")), "near")
    of = lambda c: near.select(F.col("x").alias(f"{c}_id"), F.col("near").alias(f"{c}_near"), F.col("home").alias(f"{c}_home"))
    both = edges.join(of("a"), "a_id", "left").join(of("b"), "b_id", "left")
    both = materialize(both.filter(F.coalesce("a_home", "a_id") != F.coalesce("b_home", "b_id")), "refused")
    then = lambda c: F.concat(F.array(f"{c}_id"), F.coalesce(F.transform(F.filter(f"{c}_near", lambda m: m["key"] < _key()), lambda m: m["y"]), F.array().cast("array<bigint>")))
    across = both.select("a_id", "b_id", F.explode(then("a")).alias("x"), then("b").alias("ys")).select("a_id", "b_id", "x", F.explode("ys").alias("y"))
    across = across.select(F.struct("a_id", "b_id").alias("e"), F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    missing = across.join(edges.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select("e.a_id", "e.b_id", F.lit("veto").alias("reason")).distinct()
    refused = both.select("a_id", "b_id", "score").join(missing, ["a_id", "b_id"], "left").withColumn("reason", F.coalesce("reason", F.lit("size_cap")))
    return clusters, refused
