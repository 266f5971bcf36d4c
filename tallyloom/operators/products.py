"""All products of vectors, block by block, and what is wanted of them: pairs, the strongest, their distribution.

Vectors are packed into rows of bytes, one for each block, and blocks meet in pairs. What leaves a
pair of blocks is bounded (histograms, its strongest few) or is the answer itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.materialize import materialize

BLOCK_ROWS = 16384
TILE_ROWS = 512
TILE_CELLS = 1 << 21  #: products that are held at once
PACK = "ids binary, width int, data binary"


def pack(ids: np.ndarray, m: np.ndarray) -> pa.Table:
    """One row: ids, how many bytes a component takes, and the components, in 4 bytes if these hold them exactly."""
    short = m.astype(np.float32)
    m = short if (short == m).all() else np.ascontiguousarray(m, np.float64)
    return pa.table({"ids": pa.array([np.ascontiguousarray(ids, np.int64).tobytes()], pa.binary()), "width": pa.array([m.itemsize], pa.int32()), "data": pa.array([m.tobytes()], pa.binary())})


def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of packed rows; all vectors must have one length."""
    ids, parts = [], []
    for r in rows.to_pylist():
        here = np.frombuffer(r["ids"], np.int64)
        ids.append(here)
        parts.append(np.frombuffer(r["data"], f"f{r['width']}").reshape(len(here), len(r["data"]) // r["width"] // len(here)).astype(np.float64))
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError("vectors of different length")
    return np.concatenate(ids), np.concatenate(parts)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.unique(np.asarray(column.value_lengths()))
    if len(size) > 1:
        raise ValueError("vectors of different length")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), int(size[0]) if len(size) else 0)


def packed_by(rows: DataFrame, keys: list[str], id_col: str = "f_id", vector_col: str = "embedding") -> DataFrame:
    """`keys` and the packed vectors of each group, which must fit a task."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(group: pa.Table) -> pa.Table:
        out = pack(np.asarray(group[id_col]), matrix(group[vector_col]))
        for i, k in enumerate(keys):
            out = out.add_column(i, k, group[k].slice(0, 1).combine_chunks())
        return out

    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    return rows.select(*keys, F.col(id_col).cast("long").alias(id_col), vector_col).groupBy(*keys).applyInArrow(run, f"{fields}, {PACK}")


def dealt(id_col: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")


def block_products(vectors: DataFrame, use: Callable, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of `use(tiles)` for every two blocks of `vectors` (f_id, embedding).

    `tiles` gives `(a, b, scores)`: ids of some rows and columns and their products, with every
    unordered pair of vectors in one tile once; the rest of a tile is NaN.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n / block_rows), min(math.ceil(n / TILE_ROWS), math.isqrt(2 * tasks)))
    packs = materialize(packed_by(vectors.withColumn("home", dealt("f_id", blocks)), ["home"]), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    pairs = packs.select("*", other).withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other"))

    def run(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        home = np.asarray(group["home"])
        sides = [group.filter(pa.array(home == x)) for x in (i, j)]
        if not all(map(len, sides)):
            return use(iter(()))
        (a, p), (b, q) = (unpack(s) for s in sides)
        if p.shape[1] != q.shape[1]:
            raise ValueError("vectors of different length")

        def tiles():
            step = max(1, TILE_CELLS // len(b))
            for at in range(0, len(a), step):
                m = p[at : at + step] @ q.T
                if i == j:  # each pair once, and none with itself
                    m[np.arange(at, at + len(m))[:, None] >= np.arange(len(b))] = np.nan
                yield a[at : at + step], b, m

        return use(tiles())

    return pairs.groupBy("i", "j").applyInArrow(run, schema)


PAIR = "a_id long, b_id long, score double"


def _pairs(a: np.ndarray, b: np.ndarray, m: np.ndarray, hit: np.ndarray) -> pa.Table:
    x, y = np.nonzero(hit)
    return pa.table({"a_id": np.minimum(a[x], b[y]), "b_id": np.maximum(a[x], b[y]), "score": m[x, y]})


NO_PAIRS = pa.table({"a_id": pa.array([], pa.int64()), "b_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def dense_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`(a_id, b_id, score)`, a_id < b_id, of all pairs of `(f_id, embedding)` with a product of `threshold` or more."""
    return block_products(vectors, lambda tiles: pa.concat_tables([NO_PAIRS, *[_pairs(a, b, m, m >= threshold) for a, b, m in tiles]]), PAIR, block_rows)


def _best(pairs: pa.Table, n: int) -> pa.Table:
    order = np.lexsort((np.asarray(pairs["b_id"]), np.asarray(pairs["a_id"]), -np.asarray(pairs["score"])))
    return pairs.take(pa.array(order[:n]))


def top_pairs(vectors: DataFrame, n: int, threshold: float, digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The n strongest pairs of `threshold` or more, scores rounded to `digits`; ties go to the smaller ids.

    Two blocks keep their n best while they are multiplied, so no more than that leaves them.
    """

    def use(tiles) -> pa.Table:
        kept, bar = NO_PAIRS, threshold
        for a, b, m in tiles:
            m = np.round(m, digits)
            kept = pa.concat_tables([kept, _pairs(a, b, m, m >= bar)])
            if len(kept) > n:
                kept = _best(kept, n)
                bar = max(bar, kept["score"][n - 1].as_py())
        return kept

    return block_products(vectors, use, PAIR, block_rows).orderBy(F.desc("score"), "a_id", "b_id").limit(n)


COUNTED = "part int, bin int, n long, low double, high double"


def _counted(tiles, spans: list[tuple[float, float]], bins: int) -> pa.Table:
    """How many scores lie in each bin of each span, and the least and largest of them."""
    n = np.zeros((len(spans), bins), np.int64)
    low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
    for _, _, m in tiles:
        m = m[~np.isnan(m)]
        for part, (a, b) in enumerate(spans):
            s = m[(m >= a) & (m <= b)]
            at = np.minimum((s - a) * (bins / (b - a)), bins - 1).astype(np.int64) if b > a else np.zeros(len(s), np.int64)
            n[part] += np.bincount(at, minlength=bins)
            np.minimum.at(low[part], at, s)
            np.maximum.at(high[part], at, s)
    part, bin_ = np.nonzero(n)
    return pa.table({"part": pa.array(part, pa.int32()), "bin": pa.array(bin_, pa.int32()), "n": n[part, bin_], "low": low[part, bin_], "high": high[part, bin_]})


def scores_at(vectors: DataFrame, ranks: list[int], bins: int = 4096, block_rows: int = BLOCK_ROWS) -> dict[int, float]:
    """The scores that stand at `ranks` (from 0) among those of all pairs, in ascending order; exact.

    Blocks count their scores in bins, at most `bins` for each rank, and only the counts are added
    up. The bin that holds a rank, from its least score to its largest, is what the next pass
    looks into, until it holds one value. Equal scores share a bin, so any number of them ends it.
    """
    bound = vectors.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    sought = {r: ((-1.001 * bound - 1e-9, 1.001 * bound + 1e-9), 0) for r in ranks}  #: where it must be, and what lies below
    found: dict[int, float] = {}
    while sought:
        spans = sorted({span for span, _ in sought.values()})
        counts = block_products(vectors, lambda tiles: _counted(tiles, spans, bins), COUNTED, block_rows)  # noqa: B023
        counts = counts.groupBy("part", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        by_span = {spans[p]: c.sort_values("bin") for p, c in counts.groupby("part")}
        for r, (span, below) in list(sought.items()):
            c = by_span[span]
            ends = below + c["n"].cumsum().to_numpy()
            i = int(np.searchsorted(ends, r, "right"))
            low, high = float(c["low"].iat[i]), float(c["high"].iat[i])
            if low == high:
                found[r] = low
                del sought[r]
            else:
                sought[r] = ((low, high), int(ends[i] - c["n"].iat[i]))
    return found


def score_quantiles(vectors: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999), block_rows: int = BLOCK_ROWS, bins: int = 4096) -> DataFrame:
    """One row: the number of pairs, the linear quantiles of their scores, least and largest; null without pairs."""
    n = vectors.count()
    total = n * (n - 1) // 2
    names = [f"p{q * 100:g}".replace(".", "_") for q in at]
    values: list = [None] * (len(at) + 2)
    if total:
        places = [q * (total - 1) for q in at]
        known = scores_at(vectors, sorted({0, total - 1, *(f(p) for p in places for f in (math.floor, math.ceil))}), bins, block_rows)
        between = lambda p: known[math.floor(p)] + (known[math.ceil(p)] - known[math.floor(p)]) * (p % 1)
        values = [round(v, 6) for v in (*map(between, places), known[0], known[total - 1])]
    fields = ", ".join(f"{c} double" for c in [*names, "min", "max"])
    return vectors.sparkSession.createDataFrame([(total, *values)], f"pairs long, {fields}")


def similar_pairs(vectors: DataFrame, threshold: float, bits: int = 6, recall: float = 0.95, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Most of the pairs of unit vectors with a cosine of `threshold` or more; what is given is exact.

    The signs of `bits` random projections are a bucket; there are as many tables of buckets as bring
    the chance of a pair at the threshold to `recall`. Buckets are multiplied out by themselves, large ones in
    blocks, which move as packed bytes; a pair is given by the first table in which its two share a bucket.
    """
    if not -1 < threshold < 1:
        raise ValueError("threshold must lie between -1 and 1")
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))
    dim = vectors.select(F.size("embedding")).first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], PAIR)
    planes = np.random.default_rng(seed).standard_normal((dim[0], tables * bits))
    weights = 1 << np.arange(bits)

    kind = np.uint8 if bits <= 8 else np.int32

    def code_of(column) -> np.ndarray:
        sign = (matrix(column) @ planes > 0).reshape(len(column), tables, bits)
        return (sign * weights).sum(axis=2).astype(kind)

    def coded(batches):
        for b in batches:
            if b.num_rows:
                code = code_of(b["embedding"])
                t, bucket = np.divmod(np.arange(tables << bits), 1 << bits)
                n = np.concatenate([np.bincount(code[:, t], minlength=1 << bits) for t in range(tables)])
                yield pa.record_batch([pa.array(x[n > 0]) for x in (t, bucket, n)], ["t", "bucket", "n"])

    rows = vectors.select(F.col("f_id").cast("long").alias("f_id"), "embedding")
    sizes = rows.mapInArrow(coded, "t long, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).toPandas()  # 2^bits rows for each table at most
    blocks = np.ones((tables, 1 << bits), np.int64)
    blocks[sizes["t"], sizes["bucket"]] = -(-sizes["n"] // block_rows)

    def packs(batches):
        for b in batches:
            if b.num_rows:
                m, ids, code = matrix(b["embedding"]), np.asarray(b["f_id"]), code_of(b["embedding"])
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for t in range(tables):
                    many = blocks[t, code[:, t]]
                    place = code[:, t].astype(np.int64) << 32 | (spread % many.astype(np.uint64)).astype(np.int64)
                    order = np.argsort(place, kind="stable")
                    for here in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                        bucket, home = int(code[here[0], t]), int(place[here[0]] & 0xFFFFFFFF)
                        row = pack(ids[here], m[here])
                        for name, x in (("t", t), ("bucket", bucket), ("home", home), ("blocks", int(many[here[0]]))):
                            row = row.append_column(name, pa.array([x], pa.int32()))
                        yield row.append_column("codes", pa.array([code[here, :t].tobytes()], pa.binary())).combine_chunks().to_batches()[0]

    each = rows.mapInArrow(packs, f"{PACK}, t int, bucket int, home int, blocks int, codes binary")
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other"))

    def run(group: pa.Table) -> pa.Table:
        i, j, t = (group[c][0].as_py() for c in ("i", "j", "t"))
        home = np.asarray(group["home"])
        sides = [group.filter(pa.array(home == x)) for x in (i, j)]
        if not all(map(len, sides)):
            return NO_PAIRS
        (a, p), (b, q) = map(unpack, sides)
        seen_a, seen_b = (np.frombuffer(b"".join(x["codes"].to_pylist()), kind).reshape(-1, t) if t else np.zeros((n, 0), kind) for x, n in zip(sides, (len(a), len(b))))
        out, step = [NO_PAIRS], max(1, TILE_CELLS // len(b))
        for at in range(0, len(a), step):
            m = p[at : at + step] @ q.T
            hit = m >= threshold
            if i == j:
                hit &= np.arange(at, at + len(m))[:, None] < np.arange(len(b))
            x, y = np.nonzero(hit)
            fresh = np.ones(len(x), bool)
            for u in range(t):
                fresh &= seen_a[at + x, u] != seen_b[y, u]
            x, y = x[fresh], y[fresh]
            ids = a[at + x], b[y]
            out.append(pa.table({"a_id": np.minimum(*ids), "b_id": np.maximum(*ids), "score": m[x, y]}))
        return pa.concat_tables(out)

    return each.groupBy("t", "bucket", "i", "j").applyInArrow(run, PAIR)
