"""Agreement of several annotators, and scores against a gold set.

`answers` columns are maps of run to value, from joins.merge_runs().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _values(key_of=None) -> Column:
    return F.transform(F.map_values("answers"), key_of) if key_of else F.map_values("answers")


def agreed(key_of=None) -> Column:
    return F.size(F.array_distinct(_values(key_of))) == 1


def shared(merged: DataFrame, n_runs: int) -> DataFrame:
    return merged.filter(F.size("answers") == n_runs)


def agreement(merged: DataFrame, n_runs: int, key_of=None) -> DataFrame:
    """One row: ids that all runs labelled, how many agree and disagree, and the rate."""
    ok = F.sum(F.when(agreed(key_of), 1).otherwise(0))
    out = shared(merged, n_runs).agg(F.count("*").alias("shared"), F.coalesce(ok, F.lit(0)).alias("agreed"))
    return out.select("shared", "agreed", (F.col("shared") - F.col("agreed")).alias("disagreed"), F.round(F.col("agreed") / F.nullif("shared", F.lit(0)), 4).alias("rate"))


def label_pairs(merged: DataFrame, n_runs: int) -> DataFrame:
    """Disagreements by their sorted set of labels, largest first, with the running share."""
    pair = F.array_join(F.array_sort(F.array_distinct(_values())), " | ")
    counts = shared(merged, n_runs).filter(~agreed()).groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "pair")
    return counts.select("pair", "n", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 6).alias("cumulative"))


def contest_rate(merged: DataFrame, n_runs: int) -> DataFrame:
    """Of each label how often it is disputed. An agreed id counts once for each run, a disputed one once for each of its labels."""
    both = shared(merged, n_runs)
    sure = both.filter(agreed()).select(F.map_values("answers")[0].alias("label"), F.lit(n_runs).alias("total"), F.lit(0).alias("disputed"))
    open_ = both.filter(~agreed()).select(F.explode(F.array_distinct(_values())).alias("label"), F.lit(1).alias("total"), F.lit(1).alias("disputed"))
    out = sure.unionByName(open_).groupBy("label").agg(F.sum("disputed").alias("disputed"), F.sum("total").alias("total"))
    return out.withColumn("rate", F.round(F.col("disputed") / F.col("total"), 6))


def gold_scores(merged: DataFrame, gold: DataFrame, n_runs: int) -> DataFrame:
    """`(what, right, total)`: agreed answers right, disputed ones right somewhere, each run alone."""
    both = shared(merged, n_runs).join(gold, "id")
    hit = F.exists(F.map_values("answers"), lambda v: v == F.col("gold"))
    whole = both.groupBy(F.when(agreed(), "agreed").otherwise("disagreed").alias("what")).agg(F.sum(hit.cast("int")).alias("right"), F.count("*").alias("total"))
    alone = both.select("gold", F.explode("answers").alias("run", "value")).groupBy(F.concat(F.lit("run "), "run").alias("what"))
    return whole.unionByName(alone.agg(F.sum((F.col("value") == F.col("gold")).cast("int")).alias("right"), F.count("*").alias("total")))


def blind_spots(merged: DataFrame, gold: DataFrame, n_runs: int) -> DataFrame:
    """What all runs say alike and wrongly: gold, said, count."""
    said = F.map_values("answers")[0]
    return shared(merged, n_runs).filter(agreed()).join(gold, "id").filter(said != F.col("gold")).groupBy("gold", said.alias("said")).agg(F.count("*").alias("n"))


FLOORS = (0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95)


def confidence_curve(rows: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """For each confidence floor that any answer reaches: kept, coverage, accuracy. Null answers are declined.

    One pass: every row is exploded to the floors it reaches, of which there is a fixed number.
    """
    reached = F.filter(F.array(*map(F.lit, floors)), lambda t: F.coalesce(F.col("confidence"), F.lit(0.0)) >= t)
    total = rows.agg(F.count("*").alias("_all"))
    kept = rows.filter(F.col("value").isNotNull()).select(F.explode(reached).alias("floor"), (F.col("value") == F.col("gold")).cast("int").alias("ok"))
    out = kept.groupBy("floor").agg(F.count("*").alias("kept"), F.sum("ok").alias("_ok")).crossJoin(F.broadcast(total))  # one row
    return out.select("floor", "kept", F.round(F.col("kept") / F.col("_all"), 6).alias("coverage"), F.round(F.col("_ok") / F.col("kept"), 6).alias("accuracy"))


def option_coverage(gold: DataFrame, options: DataFrame) -> DataFrame:
    """Gold values that the offered options lack, with counts. `options` is `(gold)`."""
    return gold.join(options.select("gold").distinct(), "gold", "left_anti").groupBy("gold").agg(F.count("*").alias("n"))


def new_labels(answers: DataFrame, vocabulary: DataFrame, key_of) -> DataFrame:
    """Answers outside their theme's vocabulary: theme, value, count, and whether only the case differs. Rows without theme are skipped."""
    v = vocabulary.select("theme", key_of(F.col("name")).alias("_k"), "name")
    rows = answers.filter(F.col("theme").isNotNull() & (F.coalesce(F.trim("value"), F.lit("")) != "")).withColumn("_k", key_of(F.col("value")))
    counts = rows.groupBy("theme", "_k", "value").agg(F.count("*").alias("n"))
    out = counts.join(v.dropDuplicates(["theme", "_k"]), ["theme", "_k"], "left")
    return out.filter(F.col("name").isNull() | (F.col("name") != F.col("value"))).select("theme", "value", "n", F.col("name").isNotNull().alias("case_only"))


def evidence(rows: DataFrame) -> DataFrame:
    """Rows with the cited ids that were never retrieved, and whether the evidence holds."""
    fake = F.array_except("evidence_ids", "retrieved")
    return rows.withColumns({"fabricated": fake, "evidence_ok": (F.size(fake) == 0) & (F.size("evidence_ids") > 0)})


def agent_report(rows: DataFrame) -> DataFrame:
    """One row of counts, tokens (sum, upper median, maximum) and changes against the baseline."""
    n = lambda c: F.count(F.when(c, 1))
    done = evidence(rows)
    right, base = F.col("agent") == F.col("gold"), F.col("blind") == F.col("gold")
    fixed = n(right & ~base)
    out = done.agg(
        F.count("*").alias("n"), n(F.col("agent") == F.col("bank")).alias("agreed"), n(F.col("agent") != F.col("blind")).alias("revised"), n(F.col("is_new")).alias("new"), n(F.col("theme_wrong")).alias("theme_wrong"),
        n(F.col("agent").isNull() & F.col("action").isNotNull()).alias("deferred"), n(F.col("action").isNull()).alias("capped"), n(F.size("fabricated") > 0).alias("fabricated"),
        F.sum("tokens").alias("tokens"), F.max("tokens").alias("max_tokens"), F.count("tokens").alias("_m"), fixed.alias("fixed"), n(base & ~right).alias("broke"), n(right & (F.col("agent") == F.col("bank"))).alias("both_right"),
    )
    # The upper median is the value of 0-based rank n div 2; a discrete percentile just beyond the half gives it.
    upper = done.groupBy("tokens").agg(F.count("*").alias("c")).filter("tokens is not null")
    w = Window.orderBy("tokens")
    ranked = upper.select("tokens", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("total"))
    median = ranked.filter("upto > total div 2").agg(F.min("tokens").alias("median_tokens"))
    return out.drop("_m").crossJoin(F.broadcast(median))  # one row each
