"""The three layers: sightings, identities, and a row for each identity and month; and their upkeep.

Derived counts are recomputed, never incremented, so loading twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.numbering import numbered


def roll_up(sightings: DataFrame, keys: tuple[str, ...] = ("tache", "fp")) -> DataFrame:
    """One row for each identity: text of the newest sighting, first and last month, counts. One shuffle."""
    newest = F.struct("period", "id")
    return sightings.groupBy(*keys).agg(
        F.max_by("text", newest).alias("text"), F.min("period").alias("first_seen"), F.max("period").alias("last_seen"), F.count("*").alias("total_sightings"), F.countDistinct("period").alias("months_seen")
    )


def month_rows(sightings: DataFrame, keys: tuple[str, ...] = ("tache", "period", "f_id")) -> DataFrame:
    """One row for each identity and month, with the largest sighting id as representative."""
    return sightings.groupBy(*keys).agg(F.count("*").alias("month_sightings"), F.max("id").alias("representative_raw_id"))


def assign_ids(identities: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("tache", "fp")) -> DataFrame:
    """`(keys, f_id)` for all: known ids stay; new keys get numbers after the largest, in key order.

    New keys are numbered by ranges, so no window sees all.
    """
    new = identities.select(*keys).distinct().join(known, list(keys), "left_anti")
    top = known.agg(F.coalesce(F.max("f_id"), F.lit(0))).first()[0]
    return known.select(*keys, "f_id").unionByName(numbered(new, list(keys), "f_id", top))


def upsert_actions(new: DataFrame, old: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """`(keys, action)`: added, updated, unchanged or stale, by null-safe comparison of the columns."""
    a = new.select(*keys, F.struct(*compared).alias("_new"))
    b = old.select(*keys, F.struct(*compared).alias("_old"))
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "stale").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def apply_upsert(new: DataFrame, old: DataFrame, keys: list[str], owned: list[str], prune: bool = False) -> DataFrame:
    """`old` brought up to `new`; columns of `old` beyond keys and `owned` (labels) are kept."""
    rest = [c for c in old.columns if c not in keys and c not in owned]
    a = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in owned], F.lit(True).alias("_in"))
    b = old.select(*keys, *owned, *rest, F.lit(True).alias("_was"))
    both = a.join(b, keys, "left" if prune else "full")
    return both.select(*keys, *[F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in owned], *rest)


def stale_rows(old: DataFrame, new: DataFrame, keys: list[str], tache: int | None = None) -> DataFrame:
    """Rows of the table that the input no longer has, of one task if asked."""
    scope = old.filter(F.col("tache") == tache) if tache is not None else old
    return scope.join(new.select(*keys).distinct(), keys, "left_anti")


def touched_keys(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """All stored and new sightings of the identities that a batch touches; a repeated id counts once."""
    ids = batch.select(*keys).distinct()
    return stored.join(ids, keys, "left_semi").unionByName(batch).dropDuplicates(["id"])


def dry_run(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """What a load would add, without writing: new sightings, identities and month rows."""

    def count(keys: list[str], name: str) -> DataFrame:
        fresh = batch.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")
        return fresh.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")

    return count(["id"], "sightings").unionByName(count(["tache", "fp"], "identities")).unionByName(count(["tache", "fp", "period"], "month rows"))


def integrity(sightings: DataFrame, months: DataFrame, identities: DataFrame, themes: DataFrame) -> DataFrame:
    """`(problem, n)`: orphans, labels under the wrong theme, repeated natural keys."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    wrong = identities.join(themes, "core_subject").filter(F.col("theme") != F.col("subject_theme"))
    twice = months.groupBy("tache", "period", "f_id").count().filter("count > 1")
    return (
        n(sightings.join(identities, "f_id", "left_anti"), "orphan sightings")
        .unionByName(n(months.join(identities, "f_id", "left_anti"), "orphan months"))
        .unionByName(n(wrong, "wrong theme"))
        .unionByName(n(twice, "repeated keys"))
    )


def rekey(rows: DataFrame, mapping: DataFrame, old: str, new: str, per: str, order: str) -> DataFrame:
    """Rows moved from old keys to new ones; unmapped rows go, and the first of each `per` and new key stays."""
    moved = rows.join(mapping.select(old, new), old)
    cols = [c for c in rows.columns if c not in (old, per)]
    first = moved.groupBy(per, new).agg(F.min_by(F.struct(*cols), order).alias("r"))
    return first.select(per, new, "r.*")


def coverage(identities: DataFrame, fields: list[str]) -> DataFrame:
    """By task, how many identities there are and what share has each label."""
    return identities.groupBy("tache").agg(F.count("*").alias("n"), *[F.round(F.count(f) / F.count("*"), 6).alias(f) for f in fields])


