"""Exact nearest neighbours, as blocked matrix products over cells around pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators.materialize import materialize
from tallyloom.operators.products import PACK, TILE_CELLS, dealt, matrix, pack, packed_by, unpack

CELL_ROWS = 4000
BLOCK_ROWS = 16384  #: vectors that are multiplied out at once, and queries that meet them
MOST_CELLS = 1024  #: pivots are held by the driver and every task
SLACK = 1e-9  #: by which a bound is wider than it need be, for rounding


def _checked(rows: DataFrame, dim: int | None) -> DataFrame:
    """`(f_id, embedding)` as doubles; with `dim` another length is an error."""
    v = F.col("embedding").cast("array<double>")
    if dim:
        v = F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit("vectors of different length")).cast("array<double>"))
    return rows.select(F.col("f_id").cast("long").alias("f_id"), v.alias("embedding"))


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`rows` with the cell of the nearest pivot and the distance from it."""

    def near(batches):
        for b in batches:
            m = matrix(b["embedding"])
            if b.num_rows and m.shape[1] != pivots.shape[1]:
                raise ValueError("vectors of different length")
            far = np.sqrt(np.maximum((m**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * m @ pivots.T, 0))
            cell = far.argmin(axis=1)
            yield pa.record_batch([b["f_id"], b["embedding"], pa.array(cell, pa.int32()), pa.array(far[np.arange(len(m)), cell])], ["f_id", "embedding", "cell", "away"])

    return rows.mapInArrow(near, "f_id long, embedding array<double>, cell int, away double")


FOUND = "q_id long, f_id long, score double"


NONE = pa.table({"q_id": pa.array([], pa.int64()), "f_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _best(own: np.ndarray, x: np.ndarray, bar: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, home: np.ndarray | None = None, cells: np.ndarray | None = None) -> pa.Table:
    """The k best of the vectors `ids`, `y` for each query `own`, `x` that reach its `bar`; never itself, and none of the cell `home` that it knows."""
    if x.shape[1] != y.shape[1]:
        raise ValueError("vectors of different length")
    out, step = [NONE], max(1, TILE_CELLS // len(ids))
    for at in range(0, len(x), step):
        m, mine, least = x[at : at + step] @ y.T, own[at : at + step], bar[at : at + step].copy()
        free = np.flatnonzero(np.isneginf(least))
        # of what a query without a bar knows already there are k at most: its cell's others, and itself
        if len(free) and len(ids) > 2 * k + 1:
            least[free] = np.partition(m[free], -(2 * k + 1), axis=1)[:, -(2 * k + 1)]
        # all that reach the bar, so that ties go to the smaller id
        r, c = np.nonzero(m >= (least - SLACK)[:, None])
        other = ids[c] != mine[r]
        if home is not None:
            other &= cells[c] != home[at : at + step][r]
        r, c = r[other], c[other]
        score = np.round(m[r, c], 12)  # of copies, whatever the order of the sums
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append(pa.table({"q_id": mine[r[first]], "f_id": ids[c[first]], "score": score[first]}))
    return pa.concat_tables(out)


def _asked(asking: DataFrame, packs: DataFrame, parts: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The k best of each part of a cell for the queries that ask it: `asking` is `(f_id, embedding, cell)`."""
    sizes = asking.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("groups"))
    known = F.broadcast(parts.join(sizes, "cell"))  # a row for each cell
    return _meet(asking.join(known, "cell"), packs.join(known.select("cell", "groups"), "cell"), k)


def _meet(asking: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """The same where `asking` knows its cell's parts, and both know in how many groups the queries come."""
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    queries = asking.withColumn("group", F.pmod(F.xxhash64("f_id"), F.col("groups")).cast("int"))
    queries = packed_by(queries, ["cell", "group", "parts"]).withColumn("part", blocks("parts"))
    rows = packs.withColumn("group", blocks("groups"))

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return NONE
        (own, x), (ids, y) = unpack(q), unpack(v)
        return _best(own, x, np.full(len(own), -np.inf), ids, y, k)

    keys = ["cell", "group", "part"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(best, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "f_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int, dim: int | None, cell_rows: int) -> tuple[DataFrame, DataFrame | None, dict]:
    """The k best, counts of `visits` by queries to further cells (None if there is one cell), and the cells."""
    queries, vectors = _checked(queries, dim), _checked(vectors, dim)
    n = vectors.count()
    cells = min(MOST_CELLS, max(1, math.ceil(n / cell_rows)))
    if not n:
        return queries.limit(0).select(F.col("f_id").alias("q_id"), "f_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")), None, {"cells": 0}
    if cells == 1:
        groups, parts = math.ceil(queries.count() / block_rows), math.ceil(n / block_rows)
        whole = packed_by(vectors.withColumn("cell", F.lit(0)).withColumn("part", dealt("f_id", parts)), ["cell", "part"])
        all_ = queries.select("f_id", "embedding", F.lit(0).alias("cell"), F.lit(max(1, groups)).alias("groups"), F.lit(parts).alias("parts"))
        return _ranked(_meet(all_, whole.withColumn("groups", F.lit(max(1, groups))), k), k), None, {"cells": 1}
    chosen = vectors.orderBy(F.xxhash64("f_id"), "f_id").limit(cells).select("embedding").toArrow()
    pivots = matrix(chosen["embedding"])
    placed = materialize(_in_cells(vectors, pivots), "cells")
    about = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).toPandas()  # a row for each pivot at most
    radius, filled = np.zeros(cells), np.zeros(cells, bool)
    radius[about["cell"]], filled[about["cell"]] = about["radius"], True
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    parts = materialize(sizes, "parts")
    split = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("f_id"), F.col("parts")).cast("int"))
    packs = materialize(packed_by(split, ["cell", "part"]), "packs")
    asking = materialize(_in_cells(queries, pivots).drop("away"), "asking")
    near = materialize(_ranked(_asked(asking, packs, parts, k, block_rows), k), "near")
    known = near.filter(F.col("rank") == k).select(F.col("q_id").alias("_q"), F.col("score").alias("bar"))
    knowing = asking.join(known, F.col("f_id") == F.col("_q"), "left").drop("_q")

    def go(m: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        """Which further cells (columns) may hold a better vector for which query."""
        most = m @ pivots.T + np.linalg.norm(m, axis=1)[:, None] * radius + SLACK
        go = (most >= _bars(b)[:, None]) & filled
        go[np.arange(len(m)), np.asarray(b["cell"])] = False
        return go

    # Small cells share a block, and large ones have several; a query is sent once to a block, however many of its cells it asks.
    rows_of = np.zeros(cells, np.int64)
    rows_of[about["cell"]] = about["n"]
    first, pieces, at, room = np.zeros(cells, np.int64), np.maximum(1, -(-rows_of // block_rows)), -1, 0
    for cell in np.flatnonzero(filled):
        if pieces[cell] > 1 or rows_of[cell] > room:
            at, room = at + 1, block_rows
        first[cell] = at
        room = 0 if pieces[cell] > 1 else room - rows_of[cell]
        at += pieces[cell] - 1
    blocks = at + 1
    holds = np.zeros((cells, blocks), np.float32)
    for cell in np.flatnonzero(filled):
        holds[cell, first[cell] : first[cell] + pieces[cell]] = 1
    groups = math.ceil(queries.count() / block_rows)

    def sent(batches):
        for b in batches:
            if b.num_rows:
                m, ids = matrix(b["embedding"]), np.asarray(b["f_id"])
                to = (go(m, b).astype(np.float32) @ holds > 0).T
                group = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
                extra = np.asarray(b["cell"]).astype(np.int64), _bars(b)
                for block in np.flatnonzero(to.any(axis=1)):
                    for g in np.unique(group[to[block]]):
                        here = to[block] & (group == g)
                        row = pack(ids[here], m[here])
                        for name, x in zip(("homes", "bars"), extra):
                            row = row.append_column(name, pa.array([x[here].tobytes()], pa.binary()))
                        row = row.append_column("block", pa.array([block], pa.int32())).append_column("group", pa.array([g], pa.int32()))
                        yield row.combine_chunks().to_batches()[0]

    asked = knowing.mapInArrow(sent, f"{PACK}, homes binary, bars binary, block int, group int")
    place = F.element_at(F.lit([int(x) for x in first]), F.col("cell") + 1)
    offered = packs.withColumn("block", (place + F.col("part")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(1, groups) - 1))))

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return NONE
        (own, x), (ids, y) = unpack(q), unpack(v)
        home, bar = (np.concatenate([np.frombuffer(r, t) for r in q[c].to_pylist()]) for c, t in (("homes", np.int64), ("bars", np.float64)))
        cell_of = np.concatenate([np.full(len(r["ids"]) // 8, r["cell"]) for r in v.select(["ids", "cell"]).to_pylist()])
        return _best(own, x, bar, ids, y, k, home, cell_of)

    further = asked.groupBy("block", "group").cogroup(offered.groupBy("block", "group")).applyInArrow(best, FOUND)

    def counted(batches):
        for b in batches:
            yield pa.record_batch([pa.array([int(go(matrix(b["embedding"]), b).sum()) if b.num_rows else 0])], ["visits"])

    return _ranked(near.drop("rank").unionByName(further), k), knowing.mapInArrow(counted, "visits long"), {"cells": int(filled.sum())}


def _bars(b: pa.RecordBatch) -> np.ndarray:
    """The k-th best score so far, if there are k."""
    return np.asarray(b["bar"].fill_null(-np.inf), np.float64)


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, dim: int | None = None, searchable: Column | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`(q_id, f_id, score, rank)`: the k nearest of each query, itself left out; ties go to the smaller id.

    `queries` and `vectors` are `(f_id, embedding)`; of `vectors` only rows for which `searchable`
    holds are candidates (as: those with a subject). With `dim` another length is an error. k is held to 1..8.

    Vectors lie in cells around pivots, about one for `cell_rows` vectors. A query first meets its own
    cell, which gives it a k-th best so far. A product with a vector is at most that with the cell's
    pivot and the query's length times the cell's radius more, so cells that can't reach the k-th
    best are skipped. Large cells and many queries of one cell are split into blocks of `block_rows`; small
    cells that are asked later lie in one block, to which a query is sent once. So if no cell can be
    skipped, a vector is sent n / `block_rows` times, in four bytes a component if these hold it.
    Scores are rounded to four places last.
    """
    found, _, _ = _search(queries, vectors.filter(searchable) if searchable is not None else vectors, max(1, min(8, k)), block_rows, dim, cell_rows)
    return found.withColumn("score", F.round("score", 4))


def visits_of(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: queries, cells, visits of queries to cells, and the share of all that was skipped."""
    found, visits, about = _search(queries, vectors, max(1, min(8, k)), block_rows, None, cell_rows)
    n, cells = queries.count(), about["cells"]
    made = n * min(1, cells) + ((visits.agg(F.sum("visits")).first()[0] or 0) if visits is not None else 0)
    return queries.sparkSession.createDataFrame([(n, cells, made, 1 - made / (n * cells) if n and cells else 0.0)], "queries long, cells int, visits long, skipped double")


def recall_at_k(neighbours: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """One row: of each field the share of queries with a neighbour of their own value."""
    a = labels.select(F.col("f_id").alias("q_id"), *[F.col(f).alias(f"_q_{f}") for f in fields])
    both = neighbours.join(a, "q_id").join(labels.select("f_id", *fields), "f_id")
    per = both.groupBy("q_id").agg(*[F.max((F.col(f) == F.col(f"_q_{f}")).cast("int")).alias(f) for f in fields])
    return per.agg(F.count("*").alias("queries"), *[F.round(F.avg(f), 6).alias(f) for f in fields])


def label_vote(neighbours: DataFrame, labels: DataFrame, field: str) -> DataFrame:
    """Neighbours' labels as evidence: votes and best score of each label."""
    return neighbours.join(labels.select("f_id", field), "f_id").groupBy("q_id", field).agg(F.count("*").alias("votes"), F.max("score").alias("best"))


def missing_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """`(key, text)` of the distinct texts whose vector the cache lacks; the key hashes model and text."""
    keyed = texts.select(F.sha2(F.concat(F.lit(model + "\x00"), "text"), 256).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")
