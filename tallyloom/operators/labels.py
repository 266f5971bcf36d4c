"""The life of labels: loading, review decisions, merges, vocabulary upkeep. All are table to table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.components import connected_components


def load_labels(proposals: DataFrame, bank: DataFrame, overwrite: bool = False) -> DataFrame:
    """`(f_id, old, new, action)` of label files applied in order.

    `proposals` is `(f_id, value, pos)`, `bank` is `(f_id, label)`. Without overwrite the first
    proposal of an id counts and labels that are set stay; with it the last one counts.
    """
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    real = proposals.filter(~blank)
    pick = F.max_by("value", "pos") if overwrite else F.min_by("value", "pos")
    one = real.groupBy("f_id").agg(pick.alias("new"))
    empty = proposals.filter(blank).select("f_id").distinct().join(one, "f_id", "left_anti").withColumn("new", F.lit(None).cast("string"))
    out = one.unionByName(empty).join(bank.select("f_id", F.col("label").alias("old"), F.lit(True).alias("_in")), "f_id", "left")
    action = F.when(F.col("_in").isNull(), "unmatched").when(F.col("new").isNull(), "blank").when(F.col("old").eqNullSafe(F.col("new")), "same")
    action = action.when(F.col("old").isNotNull(), "changed" if overwrite else "skipped").otherwise("changed")
    return out.select("f_id", "old", "new", action.alias("action"))


def apply_decisions(items: DataFrame, bank: DataFrame, vocabulary: DataFrame, key_of) -> DataFrame:
    """`items` `(f_id, decision)` against the bank: skipped, unresolved, unchanged or applied, with the label to set."""
    v = vocabulary.select(key_of(F.col("name")).alias("_k"), "name").dropDuplicates(["_k"])
    out = items.withColumn("_k", key_of(F.col("decision"))).join(v, "_k", "left").join(bank.select("f_id", F.col("label").alias("old"), F.lit(True).alias("_in")), "f_id", "left")
    skip = F.col("_in").isNull() | (F.coalesce(F.col("decision"), F.lit("")) == "")
    action = F.when(skip, "skipped").when(F.col("name").isNull(), "unresolved").when(F.col("old").eqNullSafe(F.col("name")), "unchanged").otherwise("applied")
    return out.select("f_id", F.when(action == "applied", F.col("name")).otherwise(F.col("old")).alias("label"), action.alias("action"))


def decide_all(items: DataFrame, run: str) -> DataFrame:
    """Undecided items take the named run's value, or their only candidate; others stay as they are."""
    only = F.when(F.size("candidates") == 1, F.map_values("candidates")[0])
    return items.withColumn("decision", F.coalesce("decision", F.try_element_at("candidates", F.lit(run)), only))


def decide_agreed(items: DataFrame, key_of) -> DataFrame:
    """`items` with the first run's value where two or more candidates agree, and how each went: agreed, split, single, kept."""
    n = F.size("candidates")
    alike = F.size(F.array_distinct(F.transform(F.map_values("candidates"), key_of))) == 1
    how = F.when(F.col("decision").isNotNull(), "kept").when(n < 2, "single").when(alike, "agreed").otherwise("split")
    first = F.element_at(F.map_values(F.map_from_entries(F.array_sort(F.map_entries("candidates")))), 1)
    return items.withColumns({"decision": F.when(how == "agreed", first).otherwise(F.col("decision")), "how": how})


def candidate_usage(items: DataFrame, usage: DataFrame, vocabulary: DataFrame, key_of) -> DataFrame:
    """Each candidate value and how many questions use it: null if it is no label, 0 if it is unused. `usage` is `(name, uses)`."""
    values = items.select(F.explode(F.map_values("candidates")).alias("value")).distinct().withColumn("_k", key_of(F.col("value")))
    v = vocabulary.join(usage, "name", "left").select(key_of(F.col("name")).alias("_k"), F.coalesce("uses", F.lit(0)).alias("uses"))
    return values.join(v.groupBy("_k").agg(F.sum("uses").alias("uses")), "_k", "left").select("value", "uses")


def set_labels(bank: DataFrame, patch: DataFrame) -> DataFrame:
    """`bank` after a patch `(f_id, has_theme, new_theme, has_subject, new_subject)`. Absent and null differ; a new theme clears the old subject."""
    out = bank.join(patch, "f_id", "left")
    theme = F.when(F.col("has_theme"), F.col("new_theme")).otherwise(F.col("theme"))
    moved = F.coalesce(F.col("has_theme"), F.lit(False)) & ~F.col("new_theme").eqNullSafe(F.col("theme"))
    subject = F.when(F.col("has_subject"), F.col("new_subject")).when(moved, None).otherwise(F.col("core_subject"))
    return out.select("f_id", theme.alias("theme"), subject.alias("core_subject"))


def bulk_label(bank: DataFrame, ids: DataFrame, theme: str, subject: str | None = None) -> DataFrame:
    """`bank` with one label set on many; with a subject, rows of another theme are skipped. `action` tells."""
    hit = bank.join(ids.select("f_id", F.lit(True).alias("_hit")), "f_id", "left")
    chosen = F.col("_hit").isNotNull()
    if subject is not None:
        fits = F.coalesce(F.col("theme") == theme, F.lit(False))
        action = F.when(~chosen, "untouched").when(fits, "applied").otherwise("wrong theme")
        return hit.select("f_id", "theme", F.when(chosen & fits, F.lit(subject)).otherwise(F.col("core_subject")).alias("core_subject"), action.alias("action"))
    moves = chosen & ~F.col("theme").eqNullSafe(F.lit(theme))
    action = F.when(~chosen, "untouched").when(moves, "applied").otherwise("unchanged")
    return hit.select("f_id", F.when(chosen, F.lit(theme)).otherwise(F.col("theme")).alias("theme"), F.when(~moves, F.col("core_subject")).alias("core_subject"), action.alias("action"))


def merge_labels(bank: DataFrame, merges: DataFrame) -> DataFrame:
    """`bank` with merged subjects repointed. `merges` is `(src, dst)` of numbers; chains end at their smallest number."""
    to = connected_components(merges, "src", "dst").select(F.col("id").alias("subject_id"), F.col("component").alias("_to"))
    return bank.join(to, "subject_id", "left").select(*[F.coalesce("_to", "subject_id").alias(c) if c == "subject_id" else F.col(c) for c in bank.columns])


def move_subject(bank: DataFrame, moves: DataFrame) -> DataFrame:
    """`bank` with the theme of moved subjects. `moves` is `(core_subject, to_theme)`."""
    out = bank.join(moves, "core_subject", "left")
    return out.select(*[F.coalesce("to_theme", "theme").alias(c) if c == "theme" else F.col(c) for c in bank.columns])


def delete_guard(doomed: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Labels asked to go, with how many rows use them and whether they may."""
    uses = used.groupBy(*keys).agg(F.count("*").alias("_u"))
    return doomed.join(uses, keys, "left").select(*keys, F.coalesce("_u", F.lit(0)).alias("uses"), F.col("_u").isNull().alias("deletable"))


def colliding_names(vocabulary: DataFrame, scope: str, key: Column) -> DataFrame:
    """Names of one scope that look alike."""
    return vocabulary.groupBy(scope, key.alias("key")).agg(F.countDistinct("name").alias("n")).filter("n > 1")


def human_gold(items: DataFrame, field: str) -> DataFrame:
    """Decided rows as a gold set."""
    return items.filter(F.coalesce("decision", F.lit("")) != "").select("id", F.lit(field).alias("field"), F.col("decision").alias("value"), F.lit("human").alias("model"))


def vocab_diff(wanted: DataFrame, have: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, action)`: add, orphaned, or blocked (an orphan in use, which stops the whole prune)."""
    add = wanted.distinct().join(have, keys, "left_anti").withColumn("action", F.lit("add"))
    orphan = have.join(wanted, keys, "left_anti").join(used.distinct().withColumn("_u", F.lit(True)), keys, "left")
    return add.unionByName(orphan.select(*keys, F.when(F.col("_u"), "blocked").otherwise("orphaned").alias("action")))


def prune_allowed(diff: DataFrame) -> DataFrame:
    """One row: whether nothing blocks the prune."""
    return diff.agg(F.count(F.when(F.col("action") == "blocked", 1)).alias("blocked")).select("blocked", (F.col("blocked") == 0).alias("allowed"))
