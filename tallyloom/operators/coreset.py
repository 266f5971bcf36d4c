"""Core sets: which topics recur in how many months, and the question that stands for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def subject_months(sightings: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct months of each subject: a union of months, not a sum over questions."""
    months = F.approx_count_distinct("period") if approximate else F.countDistinct("period")
    return sightings.groupBy("theme", "core_subject").agg(months.alias("months"))


def representatives(identities: DataFrame) -> DataFrame:
    """The first identity of each subject: most sightings, then earliest last month, then smallest id.

    A null last month sorts as an empty one. An aggregate does it; no window sorts a whole subject.
    """
    order = F.struct((-F.col("total_sightings")).alias("s"), F.coalesce("last_seen", F.lit("")).alias("l"), F.col("f_id"))
    return identities.groupBy("theme", "core_subject").agg(F.min_by(F.struct("f_id", "text"), order).alias("r")).select("theme", "core_subject", "r.f_id", "r.text")


def core_set(identities: DataFrame, sightings: DataFrame, min_questions: int = 2) -> DataFrame:
    """Subjects with `min_questions` or more, ranked in their theme, and themes ranked.

    Subjects rank by months, sightings, name; themes by their best subject's months, sightings, name.
    The windows see one row for each subject and theme.
    """
    subjects = identities.groupBy("theme", "core_subject").agg(F.count("*").alias("questions"), F.sum("total_sightings").alias("sightings")).filter(F.col("questions") >= min_questions)
    out = subjects.join(subject_months(sightings), ["theme", "core_subject"]).join(representatives(identities).select("theme", "core_subject", F.col("f_id").alias("representative")), ["theme", "core_subject"])
    out = out.withColumn("subject_rank", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("months"), F.desc("sightings"), "core_subject")))
    themes = out.groupBy("theme").agg(F.max("months").alias("_m"), F.sum("sightings").alias("theme_sightings"))
    themes = themes.select("theme", "theme_sightings", F.row_number().over(Window.orderBy(F.desc("_m"), F.desc("theme_sightings"), "theme")).alias("theme_rank"))
    return out.join(themes, "theme").select("theme", "theme_rank", "theme_sightings", "core_subject", "subject_rank", "months", "questions", "sightings", "representative")


def progress(core: DataFrame, done: DataFrame) -> DataFrame:
    """Done and total representatives of each theme, and of all (null theme)."""
    hit = core.join(done.select(F.col("f_id").alias("representative")).distinct().withColumn("_done", F.lit(1)), "representative", "left")
    return hit.rollup("theme").agg(F.count("_done").alias("done"), F.count("*").alias("total"))
