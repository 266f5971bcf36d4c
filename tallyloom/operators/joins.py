"""Joins of the star of sightings, identities and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def star(rows: DataFrame, identities: DataFrame, themes: DataFrame, subjects: DataFrame) -> DataFrame:
    """List rows with their identity (inner) and its labels' names (left: labels lag behind). Small dimensions are broadcast by their measured size."""
    return rows.join(identities, "f_id").join(themes, "theme_id", "left").join(subjects, "subject_id", "left")


def seen_in(identities: DataFrame, sightings: DataFrame, source: Column) -> DataFrame:
    """Identities with a sighting of the source; none twice."""
    return identities.join(sightings.filter(source).select("f_id"), "f_id", "left_semi")


def unused(vocabulary: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Vocabulary no row uses. Null keys among the used don't empty the result."""
    return vocabulary.join(used.select(*keys).dropna(), keys, "left_anti")


def resolve_ids(rows: DataFrame, own: DataFrame, foreign: DataFrame, precedence: str = "own") -> DataFrame:
    """`rows` with f_id and how it was found: `own`, `foreign` or `unmatched`.

    `own` is `(f_id)`, `foreign` is `(raw_id, f_id)`. precedence `own`: digits under twelve are an
    identity first; `integer`: any integer is; `foreign`: the scraper's id comes first.
    """
    number = F.col("id").try_cast("long")
    rows = rows.withColumn("_n", F.when(F.length("id") < 12, number) if precedence == "own" else number)
    a = own.select(F.col("f_id").alias("_n"), F.col("f_id").alias("_own"))
    b = foreign.select(F.col("raw_id").alias("id"), F.col("f_id").alias("_foreign"))
    out = rows.join(a, "_n", "left").join(b, "id", "left")
    first, second = (("_foreign", "_own") if precedence == "foreign" else ("_own", "_foreign"))
    how = F.when(F.col(first).isNotNull(), first.strip("_")).when(F.col(second).isNotNull(), second.strip("_")).otherwise("unmatched")
    return out.select(*[c for c in rows.columns if c != "_n"], F.coalesce(first, second).alias("f_id"), how.alias("found_by"))


def resolve_names(rows: DataFrame, vocabulary: DataFrame, scope: str, key_of) -> tuple[DataFrame, DataFrame]:
    """Rows with their label's id, and counts of names that have none, with the reason.

    `rows` has value and `scope`; `vocabulary` has label_id, name and `scope`. Names meet by `key_of`.
    """
    v = vocabulary.select(F.col(scope), key_of(F.col("name")).alias("_k"), "label_id").dropDuplicates([scope, "_k"])
    out = rows.withColumn("_k", key_of(F.col("value"))).join(v, [scope, "_k"], "left")
    lost = out.filter(F.col("label_id").isNull() & (F.coalesce(F.col("_k"), F.lit("")) != ""))
    lost = lost.groupBy(F.col("_k").alias("name"), F.when(F.col(scope).isNull(), "no theme").otherwise("not in vocabulary").alias("reason")).agg(F.count("*").alias("n"))
    return out.drop("_k"), lost


def merge_runs(labels: DataFrame) -> DataFrame:
    """`(id, answers)`: a map of run to value; of repeated rows the last by `pos` counts."""
    last = labels.groupBy("id", "run").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "value")))).alias("answers"))


def missing_periods(discovered: DataFrame, loaded: DataFrame, newest: int = 2, cap: int = 12) -> DataFrame:
    """`(source, period)` to read: what isn't loaded and the newest two of each source, newest first, twelve at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("period"))
    ranked = discovered.select("source", "period").distinct().withColumn("_r", F.row_number().over(w))
    new = ranked.join(loaded.select("source", "period").distinct().withColumn("_have", F.lit(True)), ["source", "period"], "left")
    todo = new.filter(F.col("_have").isNull() | (F.col("_r") <= newest))
    return todo.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("source", "period", "rank")


def enrich_queue(queue: DataFrame, bank: DataFrame, gold: DataFrame) -> DataFrame:
    """Low-confidence rows with the bank's text and theme, gold ones first; `status` says what is missing."""
    g = gold.select("f_id", F.col("text").alias("_gt"), F.col("theme").alias("_gh"))
    b = bank.select("f_id", F.col("text").alias("_bt"), F.col("theme").alias("_bh"))
    out = queue.join(b, "f_id", "left").join(g, "f_id", "left")
    filled = lambda a, c: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(c))
    status = F.when(F.col("_bt").isNull(), "unresolved").when(filled("_gh", "_bh").isNull(), "no theme").otherwise("ready")
    return out.select(*queue.columns, filled("_gt", "_bt").alias("text"), filled("_gh", "_bh").alias("theme"), status.alias("status"))
