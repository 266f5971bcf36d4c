"""Near-duplicate documents by an LSH forest of sorted MinHash orders (operator 2).

1. Every text becomes the set of its word shingles (64-bit hashes), a digest of that set and a
   MinHash signature. Texts with equal sets are one class, so groups of exact copies collapse
   before anything is compared.
2. The classes are sorted sixteen times, each time by the signature rotated to another start, and
   range-partitioned in that order with the id as tie-break. A group of any size is therefore
   spread over tasks by its sort position; no group is collected.
3. Within an order, a region is a run of rows that share a prefix of PREFIX hashes. In a small
   region all pairs are candidates. A larger one is cut deeper, hash by hash, until its parts are
   small; besides, every row is paired with its neighbours of longest common prefix.
4. Candidates are confirmed on the full shingle sets, in two rounds: the closest neighbours first,
   then those pairs that aren't yet connected.
5. Regions in which not all pairs were made (too large, or cut by the border of a task) and that
   aren't connected yet are finished by an exact prefix filter: in an order of shingles that is the
   same for all texts, rare ones first, two similar texts share a shingle among their first ones.
   Texts that do are confirmed too. So every two texts that share a prefix in any order are
   compared or connected; a link is lost only if its texts share none in sixteen orders, which
   happens to one of 100,000 at a similarity of 0.8 and to one of four million at 0.85. Components
   of all confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.common import bounded_batches, documents
from tallyloom.operators.components import connected_components
from tallyloom.operators.materialize import materialize

TREES = 16
PREFIX = 3  #: hashes that candidates share at least; TREES * PREFIX hash functions in all
DEPTH = 8  #: hashes of a sort key, the deepest cut
REGION = 8  #: rows of a region within which all pairs are candidates
NEIGHBOURS = 3  #: on the sorted order, in regions of any size
HELD = 20_000  #: rows of one region that a task holds at once
FIRST_ROUND_TREES = 6
SAMPLE = 6_000  #: documents from which the shingles' frequencies are estimated; they only set the order
FREQUENT = 4  #: documents of a full sample that make a shingle frequent
BITS = 2048  #: of a set's parity bitmap
SIZE_STEP = 1.04  #: sizes of sets within this ratio share a bucket of the prefix filter
CACHE = 100_000  #: distinct words whose hashes a task remembers

_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 2**63, TREES * PREFIX, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TREES * PREFIX, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_hashes(text: str | None, words: int, known: _WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty for null, empty or blank texts.

    A-Z are lower-cased; words are runs without ASCII white space. Texts with fewer than `words`
    words have their whole word sequence as the only shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(w))
    acc = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            acc = _mix(acc * _STEP + w[j : len(w) - size + 1 + j])
    return np.unique(acc)


def signature(hashes: np.ndarray) -> bytes:
    """TREES * PREFIX MinHash values, 32 bits each, big-endian so that bytes sort as numbers."""
    least = np.full(len(_MUL), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = (_MUL[:, None] * hashes[None, at : at + 4096] + _ADD[:, None]) >> np.uint64(32)
            np.minimum(least, part.min(axis=1), out=least)
    return least.astype(">u4").tobytes()


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap in which each shingle flips a bit: two sets differ in as many shingles at least as their bitmaps in bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(53)).astype(np.int64), minlength=BITS) & 1).tobytes()


def profiles(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, n_shingles, digest, sig, bits)` per row; the last three are null for empty sets."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"]):
                h = shingle_hashes(t, words, known)
                rows.append((i, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None, signature(h) if len(h) else None, parity(h) if len(h) else None))
            yield pd.DataFrame(rows, columns=["id", "n_shingles", "digest", "sig", "bits"]).astype({"id": "Int64"})
        pa.default_memory_pool().release_unused()  # the worker lives on and does other work

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, n_shingles long, digest binary, sig binary, bits binary")


def _region_pairs(keys: np.ndarray, lo: int, hi: int, out: set[tuple[int, int]]) -> None:
    """Candidates within rows lo to hi, which share a prefix: index pairs."""
    if hi - lo <= REGION:
        out.update((i, j) for i in range(lo, hi) for j in range(i + 1, hi))
        return
    for d in range(1, NEIGHBOURS + 1):
        out.update((i, i + d) for i in range(lo, hi - d))
    todo = [(lo, hi, PREFIX)]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= REGION:
            out.update((i, j) for i in range(a, b) for j in range(i + 1, b))
        elif depth < DEPTH:
            cuts = [a, *(np.flatnonzero(keys[a + 1 : b, depth] != keys[a : b - 1, depth]) + a + 1), b]
            todo += [(x, y, depth + 1) for x, y in zip(cuts, cuts[1:]) if y - x > 1]


def _region_names(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit name for the region of each row, the same in every task."""
    with np.errstate(over="ignore"):
        name = tree.astype(np.uint64)
        for k in range(PREFIX):
            name = _mix(name * _STEP + keys[:, k].astype(np.uint64))
    return name.view(np.int64)


def _neighbours(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What one sorted partition gives: candidate pairs (region null), and rows whose region was not wholly paired (b null).

    Such regions hold over REGION rows, or lie at an end of the partition and may go on in the next.
    A region is held whole up to HELD rows; of a longer one the last rows stay for their neighbours.
    """
    rest: pd.DataFrame | None = None
    first_region, going_on = True, False

    def looked_at(part: pd.DataFrame, ends: list[int], keys: np.ndarray, partly: list[bool]) -> pd.DataFrame:
        ids, tree = part["id"].to_numpy(), part["tree"].to_numpy()
        found: set[tuple[int, int]] = set()
        marked = np.zeros(len(part), bool)
        for a, b, more in zip(ends, ends[1:], partly):
            if b - a > 1:
                _region_pairs(keys, a, b, found)
            marked[a:b] = more or b - a > REGION
        at = np.array(sorted(found), np.int64).reshape(-1, 2)
        x, y = ids[at[:, 0]], ids[at[:, 1]]
        first = (at[:, 1] == at[:, 0] + 1) & (tree[at[:, 0]] < FIRST_ROUND_TREES)
        pairs = pd.DataFrame({"a": np.minimum(x, y), "b": pd.array(np.maximum(x, y), "Int64"), "first": first, "region": pd.array([None] * len(at), "Int64")})[x != y]
        open_ = pd.DataFrame({"a": ids[marked], "b": pd.array([None] * int(marked.sum()), "Int64"), "first": False, "region": pd.array(_region_names(tree[marked], keys[marked]), "Int64")})
        return pd.concat([pairs, open_], ignore_index=True)

    unpacked = lambda part: np.frombuffer(b"".join(part["key"]), ">u4").reshape(len(part), DEPTH)
    for b in batches:
        if not len(b):
            continue
        part = b if rest is None else pd.concat([rest, b], ignore_index=True)
        keys, tree = unpacked(part), part["tree"].to_numpy()
        new = np.flatnonzero((keys[1:, :PREFIX] != keys[:-1, :PREFIX]).any(axis=1) | (tree[1:] != tree[:-1])) + 1
        ends = [0, *new.tolist()]
        if len(ends) > 1:
            yield looked_at(part.iloc[: ends[-1]], ends, keys[: ends[-1]], [first_region or going_on] + [False] * (len(ends) - 2))
            first_region = going_on = False
        rest = part.iloc[ends[-1] :].reset_index(drop=True)
        if len(rest) > HELD:
            yield looked_at(rest, [0, len(rest)], keys[ends[-1] :], [True])
            rest, going_on = rest.iloc[-NEIGHBOURS:].reset_index(drop=True), True
    if rest is not None and len(rest):
        yield looked_at(rest, [0, len(rest)], unpacked(rest), [True])


def forest_candidates(classes: DataFrame) -> DataFrame:
    """What the sorted orders of classes `(id, sig)` give: distinct rows `(a, b, region, first)`.

    With a null region, a < b are a pair; first: closest neighbours in some of the first orders. With
    a null b, class a lies in a region of that name in which not all pairs were made.
    """
    doubled = F.concat(F.col("sig"), F.col("sig"))
    width = 4 * PREFIX
    cut = F.expr(f"substring(twice, tree * {width} + 1, {4 * DEPTH})")
    rows = classes.select("id", doubled.alias("twice"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", cut.alias("key"), "id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    return ordered.mapInPandas(_neighbours, "a long, b long, first boolean, region long").groupBy("a", "b", "region").agg(F.max("first").alias("first"))


def not_wholly_paired(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """`(id)` of the classes in regions `(id, region)` that hold several of the components `(id, component)`."""
    placed = materialize(marks.join(groups, "id", "left").select("id", "region", F.coalesce("component", "id").alias("comp")), "marks")
    several = placed.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("region")
    return placed.join(several, "region", "left_semi").select("id").distinct()


def shingle_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, shingles)`: the sorted set as packed 64-bit hashes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "shingles": [shingle_hashes(t, words, known).tobytes() for t in b["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs `(a, b)` with den * intersection >= num * union of their sets. Each pair moves one set."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if den * min(len(a), len(b)) < num * max(len(a), len(b)):
                out.append(False)
                continue
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            out.append(den * both >= num * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    with_a = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    return with_a.filter(linked("set_a", "set_b")).select("a", "b").distinct()


def frequent_shingles(base: DataFrame, n_rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that many of about SAMPLE documents `(doc_id, text)` have."""
    share = min(1.0, SAMPLE / max(1, n_rows))
    some = base.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else base

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for b in batches:
            if len(b):
                found, n = np.unique(np.concatenate([shingle_hashes(t, words, known) for t in b["text"]]), return_counts=True)
                yield pd.DataFrame({"shingle": found.view(np.int64), "n": n})

    least = max(2, round(FREQUENT * min(n_rows, SAMPLE) / SAMPLE))
    found = some.select("text").mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count")).filter(F.col("count") >= least).toPandas()
    hashes = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, words: int, num: int, den: int, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """`(id, n, at, shingle)`: the first shingles of each set of `(doc_id, text)`, by frequency, then hash.

    A partner with den * intersection >= num * union has den * intersection >= num * n, so it has one of them.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for b in batches:
            first, sizes = [], []
            for t in b["text"]:
                h = shingle_hashes(t, words, known)
                sizes.append(len(h))
                if len(hashes) and len(h):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    h = h[np.argsort(np.where(hashes[at] == h, counts[at], 0), kind="stable")]
                first.append(h[: len(h) - -(-num * len(h) // den) + 1])
            long = [len(f) for f in first]
            rows = {"id": np.repeat(b["doc_id"].to_numpy(np.int64), long), "n": np.repeat(np.array(sizes, np.int32), long)}
            at = np.concatenate([np.arange(k) for k in long]) if long else np.empty(0, np.int64)
            shingle = np.concatenate(first).view(np.int64) if first else np.empty(0, np.int64)
            yield pd.DataFrame(rows | {"at": at.astype(np.int32), "shingle": shingle})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, n int, at int, shingle long")


def prefix_candidates(rows: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """`(a, b, x, y, bound)` of all pairs a < b in different components x, y that may be similar.

    `rows` are prefixes(), `comps` has `(id, comp)` of those that count.

    The pair's first common shingle leaves min(n - at) of both for their intersection, which must
    reach num / (num + den) of the summed sizes; that bounds the smaller set's places and, by
    buckets of size, the partners of each row. In a bucket the largest component's members only
    meet the others', so a connected group of any size makes no pairs with itself.
    """
    rows = materialize(rows, "prefixes")
    several = lambda of, by: of.groupBy("shingle").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo <> hi").select("shingle")
    rows = materialize(rows.join(materialize(several(rows, "id"), "shared"), "shingle").join(comps, "id"), "shared_prefixes")
    rows = materialize(rows.join(materialize(several(rows, "comp"), "shared"), "shingle").select("shingle", "id", "comp", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at")), "shared_prefixes")
    step = float(np.log(SIZE_STEP))
    bucket = lambda n: F.floor(F.log(n) / step)
    room = F.col("n") - F.col("at")
    small = rows.filter((num + den) * room >= 2 * num * F.col("n")).withColumn("size", bucket(F.col("n")))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * num / den))
    most = F.least(F.col("n"), F.floor((num + den) * room / num) - F.col("n"))
    large = rows.withColumn("least", least).withColumn("most", most).filter("least <= most")
    large = large.withColumn("size", F.explode(F.sequence(bucket(F.col("least")), bucket(F.col("most"))))).drop("least", "most")
    both = small.select("shingle", "size", "comp").unionByName(large.select("shingle", "size", "comp"))
    hubs = both.groupBy("shingle", "size", "comp").agg(F.count("*").alias("k")).groupBy("shingle", "size").agg(F.max_by("comp", "k").alias("hub"), F.count("*").alias("comps"))
    hubs = materialize(hubs.filter("comps > 1").select("shingle", "size", "hub"), "hubs")
    small = materialize(small.join(hubs, ["shingle", "size"]), "small").alias("s")
    large = materialize(large.join(hubs, ["shingle", "size"]), "large").alias("l")
    fits = F.expr(f"s.shingle = l.shingle and s.size = l.size and s.comp <> l.comp and (s.n < l.n or s.n = l.n and s.id < l.id) and {num + den} * least(s.n - s.at, l.n - l.at) >= {num} * (s.n + l.n)")
    out = [F.least("s.id", "l.id").alias("a"), F.greatest("s.id", "l.id").alias("b"), F.least("s.comp", "l.comp").alias("x"), F.greatest("s.comp", "l.comp").alias("y"), F.least(F.expr("s.n - s.at"), F.expr("l.n - l.at")).alias("bound")]
    met = small.filter("comp <> hub").alias("s").join(large, fits).select(*out)
    met = met.unionByName(small.filter("comp = hub").alias("s").join(large.filter("comp <> hub").alias("l"), fits).select(*out))
    return met.groupBy("a", "b", "x", "y").agg(F.max("bound").alias("bound"))


def not_too_different(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps don't rule out den * intersection >= num * union."""
    ones = np.array([bin(i).count("1") for i in range(256)], np.int64)

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        apart = ones[np.frombuffer(b"".join(x), np.uint8) ^ np.frombuffer(b"".join(y), np.uint8)].reshape(len(x), -1).sum(axis=1)
        both = (n.to_numpy() - apart) // 2
        return pd.Series(den * both >= num * (n.to_numpy() - both))

    of = lambda c: classes.select(F.col("id").alias(c), F.col("bits").alias(f"{c}_bits"), F.col("n").alias(f"{c}_n"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(possible("a_bits", "b_bits", F.col("a_n") + F.col("b_n"))).select(*pairs.columns).distinct()


def missed_links(base: DataFrame, classes: DataFrame, groups: DataFrame, ids: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links `(a, b)` between classes among `ids` such that with them no similar pair of these is apart in `groups`."""
    base = materialize(base.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "open_texts")
    comps = materialize(ids.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("comp")), "open_groups")
    classes = materialize(classes.join(ids, "id", "left_semi").select("id", "bits", "n"), "open_classes")
    hashes, counts = frequent_shingles(base, base.count(), words)
    pairs = prefix_candidates(prefixes(base, words, num, den, hashes, counts), comps, num, den)
    pairs = materialize(not_too_different(materialize(pairs, "met"), classes, num, den), "prefix_pairs")
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
    sets = materialize(shingle_sets(base.join(involved, "doc_id", "left_semi"), words), "sets")
    # One pair of each two components first: where that links them, the others needn't be looked at.
    best = pairs.groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), "bound").alias("p")).select("p.a", "p.b")
    links = materialize(confirmed(best, sets, num, den), "links")
    joined = links.join(pairs.select("a", "b", "x", "y"), ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = materialize(connected_components(joined), "groups")
    left = pairs.join(near.select(F.col("id").alias("x"), F.col("component").alias("p")), "x", "left").join(near.select(F.col("id").alias("y"), F.col("component").alias("q")), "y", "left")
    left = left.filter("p is null or q is null or p <> q").select("a", "b")
    return links.unionByName(materialize(confirmed(left, sets, num, den), "links"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for every row of `docs`, under the name of `id_col`.

    Linked are documents with den * intersection >= num * union of their sets of `words`-word
    shingles. component_id is the smallest id reachable, kept says that it is the row's own.
    Texts without words (null, empty, blank) link with nothing. A row with a null id links with
    nothing and is kept; its component_id is null. Rows that repeat an id share its component. An
    empty table gives no rows. Long texts are read whole. Other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = materialize(profiles(base, words), "profiles")
    usable = seen.filter("id is not null and digest is not null")
    classes = materialize(usable.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("bits").alias("bits"), F.any_value("n_shingles").alias("n")), "classes")
    met = materialize(forest_candidates(classes.select("id", "sig")), "candidates")
    pairs, marks = met.filter("region is null"), met.filter("b is null").select(F.col("a").alias("id"), "region")
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
    sets = materialize(shingle_sets(base.join(involved, "doc_id", "left_semi"), words), "sets")
    links = materialize(confirmed(pairs.filter("first").select("a", "b"), sets, num, den), "links")
    near = materialize(connected_components(links), "groups")
    left = pairs.filter("not first").select("a", "b")
    left = left.join(near.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left")
    left = left.join(near.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left").filter("x is null or y is null or x <> y")
    more = materialize(confirmed(left.select("a", "b"), sets, num, den), "links")
    links = links.unionByName(more)
    groups = materialize(connected_components(links), "groups")
    apart = materialize(not_wholly_paired(marks, groups), "apart")
    if not apart.isEmpty():
        links = links.unionByName(missed_links(base, classes, groups, apart, words, num, den))
        groups = connected_components(links)
    by_digest = classes.select("digest", "id").join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    by_digest = materialize(by_digest, "components")
    out = seen.join(by_digest, "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 2, with three-word shingles and a similarity of 0.85."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=3, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS id, a AS root FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.id),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id
"""
