"""Exact top-k search by inner product, with a three-phase uniform threshold (operator 11).

The dimensions are split into a few groups; a query's local score list is the inner products within
one group. A score is the sum of its local scores, so what reaches a cutoff in all reaches the
cutoff's equal share in one list at least.

1. Blocks of queries meet spans of candidates. Each takes the heads of its local lists and sends the
   best few full scores of what stands there.
2. The k-th best of these over all spans is a safe cutoff: k candidates reach it. It goes with the
   queries to all spans, where the entries that reach their share of it in some list are collected.
3. Only these are summed up; those that reach the cutoff, k of a span at most, are ranked.

Vectors are packed into rows of bytes, a block of queries or candidates each, so a task holds one
block and one span, whatever the size of the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.common import bounded_batches
from tallyloom.operators.materialize import materialize
from tallyloom.sources.tables import table

LISTS = 4  #: groups of dimensions
PACKED_ROWS = 2_000
QUERY_BLOCK = 16_384  #: queries that a task holds
SPAN_ROWS = 32_768  #: candidates that a task holds, about
TILE = 4_000_000  #: scores of a list computed at once

PACKED = "blk long, dim int, n int, n_queries int, width int, at binary, ids binary, asks binary, comps binary"


def quantised(embedding: Column | str) -> Column:
    """floor(256 * x) of each component; null if the vector or a component is null or not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _pack(blk: int, dim: int, at: np.ndarray, ids: np.ndarray, asks: np.ndarray, comps: np.ndarray) -> list:
    most = int(max(-int(comps.min(initial=0)), int(comps.max(initial=0))))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return [blk, dim, len(ids), int(asks.sum()), width, at.tobytes(), ids.tobytes(), asks.tobytes(), comps.astype(f"i{width}").tobytes()]


def _rows(made: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 9, types)], [c.split()[0] for c in PACKED.split(", ")])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`at`, `ids`, `asks` and the matrix of components of packed rows of one dimension."""
    parts = [(np.frombuffer(r["at"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["asks"], bool), np.frombuffer(r["comps"], f"i{r['width']}").reshape(r["n"], r["dim"])) for r in rows.to_pylist()]
    at, ids, asks, comps = zip(*parts)
    return np.concatenate(at), np.concatenate(ids), np.concatenate(asks), np.concatenate([c.astype(np.int64) if c.dtype != comps[0].dtype else c for c in comps])


def packed(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """The vectors that take part, packed where they lie; `at` numbers the rows of the table."""
    rows = vectors.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("ask"), quantised(vector_col).alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b["v"].value_lengths())
            flat, first = np.asarray(b["v"].flatten()), np.concatenate([[0], np.cumsum(size)])
            at, ids, asks = np.asarray(b["at"]), np.asarray(b["id"]), np.asarray(b["ask"])
            made = []
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                comps = flat[first[mine][:, None] + np.arange(dim)]
                made.append(_pack(int(at[mine[0]]), int(dim), at[mine], ids[mine], asks[mine], comps))
            if made:
                yield _rows(made)

    return rows.filter("id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, PACKED)


def query_blocks(packs: DataFrame, blocks: int) -> DataFrame:
    """The queries of `packs`, packed anew into `blocks` blocks of each dimension: `block` and the packed columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                at, ids, asks, comps = _unpacked(pa.Table.from_batches([b.slice(row, 1)]))
                if asks.any():
                    dim = comps.shape[1]
                    yield _rows([_pack(int(a), dim, at[[i]], ids[[i]], asks[[i]], comps[[i]]) for i, a in zip(np.flatnonzero(asks), at[asks])])

    def together(rows: pa.Table) -> pa.Table:
        at, ids, asks, comps = _unpacked(rows.sort_by("blk"))
        out = pa.Table.from_batches([_rows([_pack(0, comps.shape[1], at, ids, asks, comps)])])
        return out.add_column(0, "block", rows["block"].slice(0, 1))

    each = packs.filter("n_queries > 0").mapInArrow(run, PACKED).withColumn("block", F.pmod(F.xxhash64("blk"), F.lit(blocks)).cast("int"))
    return each.groupBy("dim", "block").applyInArrow(together, f"block int, {PACKED}")


def _exact_type(q: np.ndarray, v: np.ndarray) -> type:
    """A number type in which every partial sum of every product of these rows is exact."""
    norm = lambda m: math.sqrt(float((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    most = norm(q) * norm(v)
    return np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64


def _tiles(q_rows: pa.Table, v_rows: pa.Table, lists: int) -> Iterator[tuple]:
    """For some queries at once: their rows, ids and vectors, the candidates' ids and vectors, and the local lists, a query's own row lowest."""
    qa, qi, _, q = _unpacked(q_rows)
    va, vi, _, v = _unpacked(v_rows)
    order = np.argsort(va)
    va, vi, v = va[order], vi[order], v[order]
    kind = _exact_type(q, v)
    q, v = q.astype(kind), v.astype(kind)
    cuts = np.array_split(np.arange(q.shape[1]), max(1, min(lists, q.shape[1])))
    low = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    step = max(1, TILE // max(1, len(v)))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        own = np.minimum(np.searchsorted(va, qa[part]), len(va) - 1)
        hit = np.flatnonzero(va[own] == qa[part])
        local = []
        for dims in cuts:
            m = q[part][:, dims] @ v[:, dims].T
            m[hit, own[hit]] = low
            local.append(m)
        yield part, qa[part], qi[part], q[part], vi, v, local, low


def _heads(k: int, lists: int):
    """Phase 1: the k best full scores among the heads of the local lists."""

    def run(q_rows: pa.Table, v_rows: pa.Table) -> pa.Table:
        out = [pa.table({"at": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})]
        if len(q_rows) and len(v_rows):
            for _, at, _, q, _, v, local, low in _tiles(q_rows, v_rows, lists):
                few = min(k, len(v))
                heads = np.concatenate([np.argpartition(m, len(v) - few, axis=1)[:, len(v) - few :] for m in local], axis=1)
                heads.sort(axis=1)
                known = np.take_along_axis(local[0], heads, 1) == low  # the query's own row
                known[:, 1:] |= heads[:, 1:] == heads[:, :-1]
                score = np.einsum("qd,qhd->qh", q, v[heads]).astype(np.int64)
                row, col = np.nonzero(~known)
                order = np.lexsort((-score[row, col], row))
                row, col = row[order], col[order]
                best = _place(row) < k
                out.append(pa.table({"at": at[row[best]], "score": score[row[best], col[best]]}))
        return pa.concat_tables(out)

    return run


def _place(group: np.ndarray) -> np.ndarray:
    """The place of each entry in its group; groups lie together."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


def _collected(k: int, lists: int):
    """Phases 2 and 3: what reaches the cutoff's share in some list, summed up; the k best of the span that reach the cutoff."""
    names = {"at": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(q_rows: pa.Table, v_rows: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], t) for c, t in names.items()})]
        if len(q_rows) and len(v_rows):
            cutoff = np.concatenate([np.frombuffer(c, np.int64) for c in q_rows["cuts"].to_pylist()])
            for part, at, qi, _, vi, _, local, low in _tiles(q_rows, v_rows, lists):
                cut = cutoff[part]
                share = -(-cut // len(local))
                share = np.maximum(share, np.iinfo(np.int64).min + 1).astype(local[0].dtype)[:, None]
                enough = local[0] >= share
                for m in local[1:]:
                    enough |= m >= share
                enough &= local[0] != low
                row, col = np.nonzero(enough)
                score = sum(m[row, col].astype(np.int64) for m in local)
                reached = score >= cut[row]
                row, col, score = row[reached], col[reached], score[reached]
                order = np.lexsort((vi[col], -score, row))
                order = order[_place(row[order]) < k]
                row, col = row[order], col[order]
                out.append(pa.table({"at": at[row], "query_id": qi[row], "vec_id": vi[col], "score": score[order]}))
        return pa.concat_tables(out)

    return run


def top_search(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = LISTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: the k rows with the largest integer inner products, for each row that asks.

    Candidates are all rows but the query's own; ties go to the smaller id. Components are counted
    in 256ths, rounded down; scores must fit a long. Rows without id, null vectors and vectors with null
    or non-finite components take no part. Vectors meet those of their own length. Rows that repeat
    an id or a vector are rows of their own, so a query that stands twice is answered twice. Fewer
    candidates than k give fewer rows; an empty table gives an empty one. Other columns are left out.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, PACKED_ROWS)
    packs = materialize(packed(vectors, is_query, id_col, vector_col), "vectors")
    n, asked = packs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_queries"), F.lit(0))).first()
    blocks = max(1, math.ceil(asked / QUERY_BLOCK))
    spans = max(math.ceil(n / SPAN_ROWS), min(math.ceil(n / PACKED_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    queries = materialize(query_blocks(packs, blocks), "queries")
    some = packs.withColumn("span", F.pmod(F.xxhash64("blk"), F.lit(spans)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span")
    keys = ["dim", "block", "span"]
    meet = lambda asking, run, schema: asking.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(run, schema)

    heads = meet(queries.select("*", every), _heads(k, lists), "at long, score long")
    best = Window.partitionBy("at").orderBy(F.desc("score"))
    heads = heads.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # A query with fewer than k candidates has no cutoff.
    cut = materialize(heads.groupBy("at").agg(F.when(F.count("*") == k, F.min("score")).alias("cut")), "cutoffs")
    told = _with_cutoffs(queries, cut, blocks)
    found = meet(told.select("*", every), _collected(k, lists), "at long, query_id long, vec_id long, score long")
    ranks = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_cutoffs(queries: DataFrame, cut: DataFrame, blocks: int) -> DataFrame:
    """The packed queries with the cutoffs of their rows, in their order, as `cuts`."""
    none = int(np.iinfo(np.int64).min)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))

    def put(q_rows: pa.Table, cuts: pa.Table) -> pa.Table:
        at, known = np.asarray(cuts["at"]), np.asarray(cuts["cut"].fill_null(none))
        order = np.argsort(at)
        at, known = at[order], known[order]
        out = []
        for row in q_rows["at"].to_pylist():
            mine = np.frombuffer(row, np.int64)
            i = np.minimum(np.searchsorted(at, mine), max(0, len(at) - 1))
            out.append((np.where(at[i] == mine, known[i], none) if len(at) else np.full(len(mine), none)).tobytes())
        return q_rows.append_column("cuts", pa.array(out, pa.binary()))

    return queries.groupBy("block").cogroup(cut.groupBy("block")).applyInArrow(put, f"block int, {PACKED}, cuts binary")


def op11_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 11: the five best of all rows for every vec_id divisible by 50."""
    return top_search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r AS r, q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.r <> v.r AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5"""
