"""Predicates and selections of question lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def question_filter(q: str | None = None, tache: int | None = None, theme=None, core_subject=None, year: int | None = None, period: str | None = None) -> list[Column]:
    """The conditions that are asked for. `q` is a pattern part: % and _ in it are wildcards. A year is a prefix of the period."""
    out = []
    if tache is not None:
        out.append(F.col("tache") == tache)
    if q:
        out.append(F.col("text").ilike(f"%{q}%"))
    if theme is not None:
        out.append(F.col("theme") == theme)
    if core_subject is not None:
        out.append(F.col("core_subject") == core_subject)
    if year is not None:
        out.append(F.col("period").startswith(f"{year}-"))
    if period is not None:
        out.append(F.col("period") == period)
    return out


def apply_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def admin_filter(identities: DataFrame, subjects: DataFrame, q: str | None = None, unlabelled: str | None = None, inconsistent: bool = False) -> DataFrame:
    """Identities by text or abstract, by a missing label, or with a subject under another theme.

    `subjects` is `(core_subject, subject_theme)`. A null theme is not inconsistent (plain `<>`).
    """
    df = identities.join(subjects, "core_subject", "left")
    if q:
        df = df.filter(F.col("text").ilike(f"%{q}%") | F.col("abstract").ilike(f"%{q}%"))
    if unlabelled:
        df = df.filter(F.col(unlabelled).isNull())
    if inconsistent:
        df = df.filter(F.col("core_subject").isNotNull() & (F.col("theme") != F.col("subject_theme")))
    return df


def unlabelled_scope(identities: DataFrame, field: str, theme=None, ids: DataFrame | None = None, cap: int = 600) -> DataFrame:
    """What a labelling run works on, most months first, `cap` rows at most.

    With `ids` (one column f_id) exactly these, labelled or not, cut to the cap before the theme
    counts; else those that lack `field`. A subject can only be asked for where there is a theme.
    """
    order = [F.col("months_seen").desc(), F.col("f_id").desc()]
    df = identities.join(ids, "f_id", "left_semi").orderBy(*order).limit(cap) if ids is not None else identities.filter(F.col(field).isNull())
    if theme is not None:
        df = df.filter(F.col("theme") == theme)
    if field == "core_subject":
        df = df.filter(F.col("theme").isNotNull())
    return df.orderBy(*order).limit(cap)


def pending(rows: DataFrame, done: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rows with id and text whose key has no result yet."""
    return rows.filter(F.col(keys[0]).isNotNull() & (F.coalesce(F.trim(text_col), F.lit("")) != "")).join(done.select(*keys).distinct(), keys, "left_anti")


def low_confidence(rows: DataFrame, below: float) -> DataFrame:
    """Rows under the bar; a missing confidence is 0."""
    return rows.filter(F.coalesce("confidence", F.lit(0.0)) < below)


def sane_slug(slug: Column, period: Column) -> Column:
    """Neither empty, long nor an address, with a period of a real month."""
    return (slug != "") & (F.length(slug) <= 40) & ~F.contains(slug, F.lit("http")) & period.rlike(r"^20[0-9]{2}-(0[1-9]|1[0-2])$")


def page(df: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """One page of an ordered list, with total and pages of the whole filter."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)))
    rows = df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)
    return rows.crossJoin(F.broadcast(total))  # one row


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None, per_page: int) -> DataFrame:
    """The rows that follow the row `last` (None: the first page) in `order`, pairs of column and whether it descends.

    The order must be total. Nulls come first where it ascends and last where it descends. The first
    column's range covers all that follows, so it is a filter that files may be skipped by; nothing before is sorted or counted.
    """

    def same(c: str) -> Column:
        return F.col(c).isNull() if last[c] is None else F.col(c) == F.lit(last[c])

    def behind(c: str, down: bool) -> Column:
        if last[c] is None:
            return F.lit(False) if down else F.col(c).isNotNull()
        return (F.col(c) < F.lit(last[c])) | F.col(c).isNull() if down else F.col(c) > F.lit(last[c])

    if last is not None:
        df = df.filter(same(order[0][0]) | behind(*order[0]))
        ways, equal = [], F.lit(True)
        for c, down in order:
            ways.append(equal & behind(c, down))
            equal = equal & same(c)
        df = df.filter(reduce(Column.__or__, ways))
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(per_page)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)
