"""Exact and near duplicates of short texts: weighted terms, cosine pairs, linkage, canonical records."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import text as T
from tallyloom.operators.linkage import complete_linkage, single_linkage  # noqa: F401
from tallyloom.operators.products import dense_pairs, score_quantiles, similar_pairs, top_pairs  # noqa: F401
from tallyloom.operators.terms import cosine_pairs, packed_weights  # noqa: F401


def exact_groups(rows: DataFrame, ignore_task: bool = False) -> DataFrame:
    """Buckets of equal fingerprint: members, and the first of them. Tasks never mix unless asked."""
    keys = ["fp"] if ignore_task else ["tache", "fp"]
    return rows.groupBy(*keys).agg(F.count("*").alias("members"), F.min("id").alias("first_id"))


def well_formed(c: Column) -> Column:
    return c.rlike(r"[?.]$")


def canonical_order(strategy: str | Callable[[], Column] = "latest") -> Column:
    """What the canonical record of a group has most of; on ties the first id stays first.

    `latest`, `longest`, or a function that gives a Column over the rows' own columns.
    """
    if callable(strategy):
        return F.struct(strategy().alias("own"), (-F.col("doc_id")).alias("first"))
    parts = {"latest": ["period", "ends", "len"], "longest": ["ends", "len"]}[strategy]
    values = {"period": F.col("period"), "ends": well_formed(F.trim("text")).cast("int"), "len": F.length("text")}
    return F.struct(*[values[p].alias(p) for p in parts], (-F.col("doc_id")).alias("first"))


def term_weights(docs: DataFrame, ngram: int = 2) -> DataFrame:
    """`packed_weights` as rows `(id, tache, term, df, w)`."""
    rows = packed_weights(docs, ngram).select("id", "tache", F.explode(F.arrays_zip("terms", "dfs", "ws")).alias("t"))
    return rows.select("id", "tache", F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"), F.col("t.ws").alias("w"))


def banded(pairs: DataFrame, review_low: float = 0.55, auto_merge: float = 0.95) -> DataFrame:
    """`band` of each pair: merge or review; weaker ones are gone."""
    if review_low > auto_merge:
        raise ValueError("review_low must not exceed auto_merge")
    return pairs.filter(F.col("score") >= review_low).withColumn("band", F.when(F.col("score") >= auto_merge, "merge").otherwise("review"))


def _with_normal(rows: DataFrame) -> DataFrame:
    """`rows` with the normal form of their text as `normal`, unless they bring that, or a digest of it."""
    return rows if "normal" in rows.columns else rows.withColumn("normal", T.normalize_text(F.col("text")))


def canonical_heads(rows: DataFrame, strategy: str | Callable[[], Column] = "latest") -> DataFrame:
    """`(cluster, canonical_id, canonical_fp, canonical_normal)` of each cluster; combined before the shuffle, one row a cluster."""
    grouped = _with_normal(rows).groupBy("cluster").agg(F.max_by(F.struct("id", "fp", "normal"), canonical_order(strategy)).alias("h"))
    return grouped.select("cluster", *[F.col(f"h.{c}").alias(f"canonical_{c}") for c in ("id", "fp", "normal")])


def cluster_members(rows: DataFrame, strategy: str | Callable[[], Column] = "latest") -> DataFrame:
    """`(cluster, canonical_id, id, kind, variant)`: a row for each sighting of `canonical_records`, however many a cluster has.

    kind is `canonical`, `exact` (of the canonical's own fingerprint) or `duplicate`; variant says
    that the normal form is another than the canonical's. No row holds a cluster's members.
    """
    rows = _with_normal(rows)
    both = rows.join(canonical_heads(rows, strategy), "cluster")
    kind = F.when(F.col("id") == F.col("canonical_id"), "canonical").when(F.col("fp") == F.col("canonical_fp"), "exact").otherwise("duplicate")
    return both.select("cluster", "canonical_id", "id", kind.alias("kind"), (F.col("normal") != F.col("canonical_normal")).alias("variant"))


def canonical_records(rows: DataFrame, strategy: str | Callable[[], Column] = "latest") -> DataFrame:
    """One record for each cluster of sightings `(cluster, doc_id, id, fp, text, period, source)`.

    duplicate_ids are the other members, exact_duplicate_ids those of the canonical's own fingerprint,
    variants the other normal forms. Rows that bring `normal`, a digest say, need no text; the result's text is then the canonical's `normal`.
    """
    rows = _with_normal(rows)
    head = F.max_by(F.struct("id", "normal", "period", "fp"), canonical_order(strategy))
    grouped = rows.groupBy("cluster").agg(
        head.alias("h"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.nullif("period", F.lit("")))).alias("months"), F.count("*").alias("occurrences"),
        F.collect_set("id").alias("ids"), F.collect_set("normal").alias("normals"), F.collect_set(F.struct("fp", "id")).alias("by_fp"),
    )
    exact = F.transform(F.filter("by_fp", lambda x: x["fp"] == F.col("h.fp")), lambda x: x["id"])
    without = lambda xs, x: F.array_sort(F.array_except(xs, F.array(x)))
    return grouped.select(
        "cluster", F.col("h.id").alias("id"), F.col("h.normal").alias("text"), F.col("h.period").alias("month"), "sources", "months", "occurrences",
        without(F.col("ids"), F.col("h.id")).alias("duplicate_ids"), without(exact, F.col("h.id")).alias("exact_duplicate_ids"), without(F.col("normals"), F.col("h.normal")).alias("variants"),
    )


def near_duplicate_pairs(review: DataFrame, clusters: DataFrame, heads: DataFrame) -> DataFrame:
    """`(id, near_id)`: review pairs lifted to canonical ids, both ways, none with itself, each once."""
    c = clusters.join(heads.select("cluster", F.col("canonical_id").alias("canonical")), "cluster").select(F.col("id").alias("member"), "canonical")
    lifted = review.join(c.select(F.col("member").alias("a_id"), F.col("canonical").alias("x")), "a_id").join(c.select(F.col("member").alias("b_id"), F.col("canonical").alias("y")), "b_id").filter("x <> y")
    sides = F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("near_id")), F.struct(F.col("y").alias("id"), F.col("x").alias("near_id"))))
    return lifted.select(sides.alias("p")).select("p.*").distinct()


def near_duplicate_ids(review: DataFrame, clusters: DataFrame, heads: DataFrame) -> DataFrame:
    """`(id, near_duplicate_ids)`: `near_duplicate_pairs` as one array for each id."""
    return near_duplicate_pairs(review, clusters, heads).groupBy("id").agg(F.array_sort(F.collect_list("near_id")).alias("near_duplicate_ids"))


def ranked(canonicals: DataFrame) -> DataFrame:
    return canonicals.orderBy(F.size("sources").desc(), F.desc("occurrences"), "id")


def accounting(canonicals: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of invariants: every sighting is a canonical or a duplicate, exact ones are among the duplicates."""
    n = rows.agg(F.count("*").alias("n_rows"))
    c = canonicals.agg(
        F.count("*").alias("n_canonical"), F.sum(F.size("duplicate_ids")).alias("n_duplicates"),
        F.coalesce(F.bool_and(F.size(F.array_except("exact_duplicate_ids", "duplicate_ids")) == 0), F.lit(True)).alias("exact_within"),
    )
    both = c.crossJoin(F.broadcast(n))  # one row each
    return both.select("n_rows", "n_canonical", "n_duplicates", "exact_within", (F.col("n_canonical") + F.col("n_duplicates") == F.col("n_rows")).alias("balanced"))


def review_queue(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with all columns of both sides, as `a_` and `b_`, score to four places, strongest first. `texts` has id and text."""
    side = lambda x: texts.select(*[F.col(c).alias(f"{x}_{c}") for c in texts.columns])
    out = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    return out.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "a_id", "b_id")


def apply_pair_decisions(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """`(id, canonical_id)` after verdicts `(pair, verdict)`, pairs written `a|b`; only `merge` joins."""
    parts = F.split("pair", r"\|")
    merges = decisions.filter("verdict = 'merge'").select(parts[0].cast("long").alias("a_id"), parts[1].cast("long").alias("b_id"))
    return single_linkage(nodes, merges).select("id", F.col("cluster").alias("canonical_id"))


def score_distribution(pairs: DataFrame, n_docs: int, at: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """Quantiles (linear) over all n(n-1)/2 pairs, of which those not listed score 0. `pairs` has every score above 0."""
    total = n_docs * (n_docs - 1) // 2
    listed = pairs.agg(F.count("*").alias("k"), F.min("score").alias("min"), F.max("score").alias("max"))
    k = listed.first()["k"]
    # Rank r of all pairs is rank r - zeros of the listed ones: zeros come first.
    wanted = sorted({int(f) for q in at for f in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    ranks = [r - (total - k) for r in wanted if r >= total - k]
    found = {}
    if ranks:
        share = [r / max(1, k - 1) for r in ranks]
        got = pairs.agg(F.percentile("score", F.array(*map(F.lit, share)))).first()[0]
        found = {r + total - k: v for r, v in zip(ranks, got)}
    quantile = lambda q: (lambda lo, hi, f: found.get(lo, 0.0) + (found.get(hi, 0.0) - found.get(lo, 0.0)) * f)(math.floor(q * (total - 1)), math.ceil(q * (total - 1)), q * (total - 1) % 1)
    return listed.select(F.lit(total).cast("long").alias("pairs"), *[F.round(F.lit(quantile(q)), 6).alias(f"p{q * 100:g}".replace(".", "_")) for q in at], F.round(F.col("min") if k == total else F.lit(0.0), 6).alias("min"), F.round("max", 6).alias("max"))
