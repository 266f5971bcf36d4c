"""Lists, filters, counts, ranks and core sets over the labelled bank."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallyloom.functions import text as T
from tallyloom.operators import coreset as C, filters as L, joins as J, models as M
from tallyloom.operators.materialize import scratch_path
from tallyloom.plans.base import query, v_bank, v_identity, v_list, v_runs, v_sightings, v_vocab
from tallyloom.sources.tables import table

LABELLED = """labelled AS (SELECT f_id, tache, text, 'about ' || text AS abstract, CASE WHEN f_id % 5 = 0 THEN NULL ELSE theme END AS theme, CASE WHEN f_id % 3 = 0 THEN NULL ELSE core_subject END AS core_subject,
    last_seen, total_sightings, months_seen FROM v_identity)"""
SUBJECTS = "subjects AS (SELECT core_subject, min(theme) AS subject_theme FROM v_vocab GROUP BY core_subject)"


def labelled(spark, d):
    """Identities some of which lack labels."""
    return v_identity(spark, d).withColumns({"abstract": F.concat(F.lit("about "), "text"), "theme": F.when(F.col("f_id") % 5 != 0, F.col("theme")), "core_subject": F.when(F.col("f_id") % 3 != 0, F.col("core_subject"))}).drop("first_seen")


def subjects(spark, d):
    """Each subject under the first of its themes."""
    return v_vocab(spark, d).groupBy("core_subject").agg(F.min("theme").alias("subject_theme"))


@query("fil_01", "SELECT raw_id, f_id, period FROM v_bank WHERE tache = 2 AND text ILIKE '%r_d%' AND theme = 'Brand#17' AND starts_with(period, '1996-')", "v_bank")
def list_filter(spark, d):
    """The conjunctive list filter; the pattern's wildcard stays one."""
    return L.apply_all(v_bank(spark, d), L.question_filter(q="r_d", tache=2, theme="Brand#17", year=1996)).select("raw_id", "f_id", "period")


@query("fil_02", f"WITH {LABELLED}, {SUBJECTS} SELECT f_id, theme, subject_theme FROM labelled JOIN subjects USING (core_subject) WHERE (text ILIKE '%ring%' OR abstract ILIKE '%ring%') AND theme <> subject_theme", "v_identity v_vocab")
def admin_filter(spark, d):
    """Identities whose subject belongs to another theme."""
    return L.admin_filter(labelled(spark, d), subjects(spark, d), q="ring", inconsistent=True).select("f_id", "theme", "subject_theme")


@query("fil_03", f"WITH {LABELLED} SELECT f_id FROM labelled WHERE core_subject IS NULL AND theme IS NOT NULL ORDER BY months_seen DESC, f_id DESC LIMIT 600", "v_identity")
def unlabelled_scope(spark, d):
    """The scope of a run that labels subjects."""
    return L.unlabelled_scope(labelled(spark, d), "core_subject").select("f_id")


@query("fil_04", "SELECT id FROM v_runs WHERE trim(text) <> '' AND id % 3 <> 0", "v_runs")
def pending(spark, d):
    """Rows that have no result yet."""
    rows = v_runs(spark, d)
    return L.pending(rows, rows.filter("id % 3 = 0"), ["id"]).select("id")


@query("fil_04_model", "SELECT doc_id AS id, CAST(length(text) % 7 AS VARCHAR) AS answer FROM documents WHERE doc_id % 3 <> 0")
def model_resumed(spark, d):
    """Answers of a model that fails on some calls at first and is asked again for what is left."""
    rows = table(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "text")
    store, schema = scratch_path(spark, "answers"), "id long, answer string"

    def label(b):
        return b[["id"]].assign(answer=(b["text"].str.len() % 7).astype(str))

    def unsure(b):
        if b["id"].iat[0] % 2:
            raise TimeoutError("no reply")
        return label(b)

    for call in (unsure, label):
        M.call_model(rows, call, schema, store)
    return M.results(spark, store, schema)


@query("fil_05", "SELECT id FROM v_runs WHERE CASE WHEN id % 7 = 0 THEN 0 ELSE confidence END < 0.4", "v_runs")
def low_confidence(spark, d):
    """Rows for the second stage."""
    return L.low_confidence(v_runs(spark, d).withColumn("confidence", F.when(F.col("id") % 7 != 0, F.col("confidence"))), 0.4).select("id")


@query("fil_06", r"""SELECT page_id, url FROM (SELECT page_id, url, regexp_extract(url, '//[^/]*/([^?]*)', 1) AS slug, '2024-' || lpad(CAST(page_id % 14 AS VARCHAR), 2, '0') AS period FROM pages)
    WHERE slug <> '' AND length(slug) <= 40 AND slug NOT LIKE '%http%' AND regexp_matches(period, '^20[0-9]{2}-(0[1-9]|1[0-2])$')""")
def sane_slugs(spark, d):
    """Pages with a usable slug and period."""
    slug = F.regexp_extract("url", "//[^/]*/([^?]*)", 1)
    period = F.concat(F.lit("2024-"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"))
    return table(spark, d, "pages").filter(L.sane_slug(slug, period)).select("page_id", "url")


@query("fil_07", f"WITH {LABELLED} SELECT f_id FROM labelled WHERE theme IS NULL", "v_identity")
def bounded_selection(spark, d):
    """All ids that a filter matches."""
    return L.admin_filter(labelled(spark, d), subjects(spark, d), unlabelled="theme").select("f_id")


@query("joi_01", "SELECT l.period, l.f_id, i.text, i.theme, i.core_subject, l.month_sightings FROM v_list l JOIN v_identity i USING (f_id)", "v_identity v_list")
def star_join(spark, d):
    """List rows with identity, theme and subject."""
    ids = v_identity(spark, d).select("f_id", "text", F.col("theme").alias("theme_id"), F.concat_ws("/", "theme", "core_subject").alias("subject_id"))
    vocab = v_vocab(spark, d)
    themes = vocab.select(F.col("theme").alias("theme_id"), "theme").distinct()
    subs = vocab.select(F.concat_ws("/", "theme", "core_subject").alias("subject_id"), "core_subject")
    return J.star(v_list(spark, d), ids, themes, subs).select("period", "f_id", "text", "theme", "core_subject", "month_sightings")


@query("joi_02", f"WITH {LABELLED}, {SUBJECTS} SELECT f_id, text, theme, core_subject, subject_theme FROM labelled LEFT JOIN subjects USING (core_subject)", "v_identity v_vocab")
def question_labels(spark, d):
    """Every identity with its labels, absent ones null."""
    return labelled(spark, d).join(subjects(spark, d), "core_subject", "left").select("f_id", "text", "theme", "core_subject", "subject_theme")


@query("joi_03", "SELECT f_id, text FROM v_identity i WHERE EXISTS (SELECT 1 FROM v_bank b WHERE b.f_id = i.f_id AND b.source = 7)", "v_identity")
def semi_source(spark, d):
    """Identities seen at a source."""
    return J.seen_in(v_identity(spark, d), v_bank(spark, d), F.col("source") == 7).select("f_id", "text")


@query("joi_04", "SELECT theme, core_subject FROM v_vocab v WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 40 <> 3 AND p.p_brand = v.theme AND p.p_type = v.core_subject AND p.p_size > 44)", "v_vocab")
def vocabulary_drift(spark, d):
    """Subjects that no row uses."""
    used = table(spark, d, "part").filter("p_size > 44").select(F.when(F.col("p_partkey") % 40 != 3, F.col("p_brand")).alias("theme"), F.col("p_type").alias("core_subject"))
    return J.unused(v_vocab(spark, d), used, ["theme", "core_subject"])


@query("joi_05", """WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN lpad(CAST(doc_id AS VARCHAR), 13, '0') ELSE 'x' || doc_id END AS id FROM documents)
    SELECT id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS f_id, CASE doc_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'foreign' ELSE 'unmatched' END AS found_by FROM q""")
def id_resolution(spark, d):
    """Ids of label files resolved to identities."""
    rows = v_sightings(spark, d)
    k = F.col("doc_id") % 3
    asked = rows.select(F.when(k == 0, F.col("doc_id").cast("string")).when(k == 1, F.col("id")).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("id"))
    return J.resolve_ids(asked, rows.select(F.col("doc_id").alias("f_id")), rows.select(F.col("id").alias("raw_id"), F.col("doc_id").alias("f_id")))


@query("joi_06", """SELECT lower(p_name) AS name, CASE WHEN p_partkey % 6 = 0 THEN 'no theme' ELSE 'not in vocabulary' END AS reason, count(*) AS n FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 4 = 1 GROUP BY ALL""")
def name_resolution(spark, d):
    """Label names that don't resolve, with the reason."""
    part = table(spark, d, "part")
    vocab = part.filter("p_partkey % 6 <> 0 and p_partkey % 4 <> 1").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("theme"), F.upper("p_name").alias("name"), F.col("p_partkey").alias("label_id"))
    rows = part.select(F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("theme"), F.concat(F.lit(" "), "p_name").alias("value"))
    return J.resolve_names(rows, vocab, "theme", T.label_key)[1]


@query("joi_07", "SELECT id, 'a=' || a || ',b=' || b AS answers FROM v_runs", "v_runs")
def merge_runs(spark, d):
    """Runs merged to one map for each id; the last row of a run wins."""
    r = v_runs(spark, d)
    rows = r.select("id", F.lit("a").alias("run"), F.col("a").alias("value"), F.lit(2).alias("pos")).unionByName(r.select("id", F.lit("a").alias("run"), F.lit("?").alias("value"), F.lit(1).alias("pos")))
    rows = rows.unionByName(r.select("id", F.lit("b").alias("run"), F.col("b").alias("value"), F.lit(1).alias("pos")))
    return J.merge_runs(rows).select("id", F.array_join(F.transform(F.map_entries("answers"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("answers"))


@query("joi_09", """WITH seen AS (SELECT DISTINCT source, period FROM v_bank), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY period DESC) AS r FROM seen),
    todo AS (SELECT source, period FROM r WHERE r <= 2 OR (source + CAST(substr(period, 6, 2) AS INTEGER)) % 4 = 0)
    SELECT * FROM (SELECT source, period, CAST(row_number() OVER (PARTITION BY source ORDER BY period DESC) AS INTEGER) AS rank FROM todo) WHERE rank <= 12""", "v_bank")
def missing_months(spark, d):
    """Months to read again or for the first time."""
    seen = v_bank(spark, d).select("source", "period").distinct()
    return J.missing_periods(seen, seen.filter((F.col("source") + F.substring("period", 6, 2).cast("int")) % 4 != 0))


@query("joi_10", """SELECT r.id, CASE WHEN r.id % 5 = 0 THEN 'gold ' || r.id ELSE r.text END AS text, CASE WHEN r.id % 4 = 0 THEN NULL ELSE r.theme END AS theme,
    CASE WHEN r.id % 4 = 0 THEN 'no theme' ELSE 'ready' END AS status FROM v_runs r WHERE confidence < 0.5""", "v_runs")
def queue_enrich(spark, d):
    """Low-confidence rows with text and theme, gold first."""
    runs = v_runs(spark, d)
    bank = runs.select(F.col("id").alias("f_id"), "text", F.when(F.col("id") % 4 != 0, F.col("theme")).alias("theme"))
    gold = runs.filter("id % 5 = 0").select(F.col("id").alias("f_id"), F.concat(F.lit("gold "), F.col("id").cast("string")).alias("text"), F.lit("").alias("theme"))
    out = J.enrich_queue(L.low_confidence(runs, 0.5).select(F.col("id").alias("f_id")), bank, gold)
    return out.select(F.col("f_id").alias("id"), "text", "theme", "status")


@query("agg_01", "SELECT period, count(*) AS n FROM v_bank WHERE tache = 3 GROUP BY period", "v_bank")
def period_counts(spark, d):
    """Entries of each month under a filter."""
    return L.apply_all(v_bank(spark, d), L.question_filter(tache=3)).groupBy("period").agg(F.count("*").alias("n"))


@query("agg_02", "SELECT tache, count(DISTINCT f_id) AS questions, count(*) AS entries FROM v_list GROUP BY tache", "v_bank v_list")
def meta_counts(spark, d):
    """Questions and list entries of each task."""
    return v_list(spark, d).groupBy("tache").agg(F.countDistinct("f_id").alias("questions"), F.count("*").alias("entries"))


@query("agg_03", "SELECT theme, count(*) AS n FROM v_list JOIN v_identity USING (f_id) GROUP BY theme", "v_identity v_list")
def theme_counts(spark, d):
    """List rows of each theme."""
    return v_list(spark, d).join(v_identity(spark, d).select("f_id", "theme"), "f_id").groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme")


@query("agg_04", "SELECT DISTINCT period FROM v_bank", "v_bank")
def distinct_periods(spark, d):
    """All months, newest first."""
    return v_bank(spark, d).select("period").distinct().orderBy(F.desc("period"))


@query("agg_05", "SELECT theme, core_subject, count(DISTINCT period) AS months FROM v_bank GROUP BY ALL", "v_bank")
def subject_months(spark, d):
    """Distinct months of each subject."""
    return C.subject_months(v_bank(spark, d))


CORE = """m AS (SELECT theme, core_subject, count(DISTINCT period) AS months FROM v_bank GROUP BY ALL),
    s AS (SELECT theme, core_subject, count(*) AS questions, CAST(sum(total_sightings) AS BIGINT) AS sightings FROM v_identity GROUP BY ALL HAVING count(*) >= 2),
    rep AS (SELECT theme, core_subject, f_id, row_number() OVER (PARTITION BY theme, core_subject ORDER BY total_sightings DESC, last_seen, f_id) AS r FROM v_identity),
    sub AS (SELECT s.*, m.months, rep.f_id AS representative, CAST(row_number() OVER (PARTITION BY s.theme ORDER BY months DESC, sightings DESC, s.core_subject) AS INTEGER) AS subject_rank
      FROM s JOIN m USING (theme, core_subject) JOIN rep ON rep.theme = s.theme AND rep.core_subject = s.core_subject AND r = 1),
    th AS (SELECT theme, CAST(row_number() OVER (ORDER BY max(months) DESC, sum(sightings) DESC, theme) AS INTEGER) AS theme_rank, CAST(sum(sightings) AS BIGINT) AS theme_sightings FROM sub GROUP BY theme)"""


@query("agg_06", f"WITH {CORE} SELECT theme, theme_rank, theme_sightings, core_subject, subject_rank, months, questions, sightings, representative FROM sub JOIN th USING (theme)", "v_identity")
def core_set(spark, d):
    """The core set: themes, their subjects, and the question that stands for each."""
    return C.core_set(v_identity(spark, d), v_bank(spark, d), min_questions=2)


@query("agg_07", "SELECT v.theme, v.core_subject, count(p_partkey) AS uses FROM v_vocab v LEFT JOIN (SELECT * FROM part WHERE p_size > 40) p ON p_brand = theme AND p_type = core_subject GROUP BY ALL", "v_vocab")
def vocabulary_usage(spark, d):
    """How often each subject is used, unused ones with 0."""
    uses = table(spark, d, "part").filter("p_size > 40").select(F.col("p_brand").alias("theme"), F.col("p_type").alias("core_subject"), "p_partkey")
    return v_vocab(spark, d).join(uses, ["theme", "core_subject"], "left").groupBy("theme", "core_subject").agg(F.count("p_partkey").alias("uses")).orderBy(F.desc("uses"), "theme", "core_subject")


@query("agg_08", "SELECT CASE WHEN months_seen <= 4 THEN CAST(months_seen AS VARCHAR) WHEN months_seen <= 8 THEN '5-8' ELSE '9+' END AS bucket, count(*) AS n FROM v_identity GROUP BY ALL", "v_identity")
def recurrence(spark, d):
    """Identities by the number of months they recur in."""
    m = F.col("months_seen")
    return v_identity(spark, d).groupBy(F.when(m <= 4, m.cast("string")).when(m <= 8, "5-8").otherwise("9+").alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_09", """WITH ms AS (SELECT tache, period, f_id, count(DISTINCT source) AS k FROM v_bank GROUP BY ALL), r AS (SELECT tache, count(*) AS raw FROM v_bank GROUP BY ROLLUP (tache)), i AS (SELECT tache, count(*) AS identities FROM v_identity GROUP BY ROLLUP (tache)),
    l AS (SELECT tache, count(*) AS entries, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END), 6) AS multi_source FROM ms GROUP BY ROLLUP (tache))
    SELECT coalesce(CAST(r.tache AS VARCHAR), 'all') AS tache, raw, identities, entries, multi_source, round(identities / raw, 6) AS ratio FROM r JOIN i ON r.tache IS NOT DISTINCT FROM i.tache JOIN l ON r.tache IS NOT DISTINCT FROM l.tache""", "v_identity")
def layer_sizes(spark, d):
    """Rows of each layer, by task and in all."""
    per_entry = v_bank(spark, d).groupBy("tache", "period", "f_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("k"))
    out = per_entry.groupBy("tache", "f_id").agg(F.sum("n").alias("n"), F.count("*").alias("e"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("multi"))
    out = out.rollup("tache").agg(F.sum("n").alias("raw"), F.count("*").alias("identities"), F.sum("e").alias("entries"), F.sum("multi").alias("multi"))
    return out.select(F.coalesce(F.col("tache").cast("string"), F.lit("all")).alias("tache"), "raw", "identities", "entries", F.round(F.col("multi") / F.col("entries"), 6).alias("multi_source"), F.round(F.col("identities") / F.col("raw"), 6).alias("ratio"))


@query("agg_25", f"WITH {LABELLED} SELECT theme, tache, count(*) AS n FROM labelled GROUP BY ALL", "v_identity")
def theme_inventory(spark, d):
    """Themes in use by task; the null theme counts what is unlabelled."""
    return labelled(spark, d).groupBy("theme", "tache").agg(F.count("*").alias("n"))


@query("win_01", f"WITH {CORE} SELECT theme, core_subject, f_id FROM rep WHERE r = 1", "v_identity")
def representatives(spark, d):
    """The question that stands for each subject."""
    return C.representatives(v_identity(spark, d)).select("theme", "core_subject", "f_id")


@query("win_02", f"WITH {CORE} SELECT theme, theme_rank FROM th", "v_identity")
def theme_ranks(spark, d):
    """Ranks of themes."""
    return C.core_set(v_identity(spark, d), v_bank(spark, d), 2).select("theme", "theme_rank").distinct()


@query("win_03", "SELECT f_id, string_agg(period, ',' ORDER BY period DESC) AS periods FROM v_list GROUP BY f_id", "v_bank v_list")
def also_asked_in(spark, d):
    """All months of an identity, newest first."""
    rows = v_list(spark, d).groupBy("f_id").agg(F.sort_array(F.collect_list("period"), asc=False).alias("p"))
    return rows.select("f_id", F.array_join("p", ",").alias("periods"))


@query("win_05", "SELECT theme, core_subject, f_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY theme, core_subject ORDER BY months_seen DESC, f_id) AS INTEGER) AS rank FROM v_identity WHERE f_id <> 10) WHERE rank <= 3", "v_identity")
def samples(spark, d):
    """Three questions of each subject, the asking one left out."""
    return L.top_per_group(v_identity(spark, d).filter("f_id <> 10"), ["theme", "core_subject"], [F.desc("months_seen"), F.col("f_id")], 3).select("theme", "core_subject", "f_id", "rank")


@query("top_01", """SELECT l.f_id, l.period, t.total, CAST(greatest(1, ceil(t.total / 50.0)) AS BIGINT) AS pages FROM (SELECT * FROM v_list WHERE tache = 2 ORDER BY period DESC, f_id DESC LIMIT 50 OFFSET 100) l, (SELECT count(*) AS total FROM v_list WHERE tache = 2) t""", "v_bank v_list")
def list_page(spark, d):
    """The third page of a list, newest first."""
    return L.page(v_list(spark, d).filter("tache = 2"), [F.desc("period"), F.desc("f_id")], 3, 50).select("f_id", "period", "total", "pages")


@query("top_01_keyset", "SELECT f_id, period FROM v_list WHERE tache = 2 ORDER BY period DESC, f_id DESC LIMIT 50 OFFSET 100", "v_bank v_list")
def list_page_by_key(spark, d):
    """The same page, reached by the last rows of the pages before it."""
    rows = v_list(spark, d).filter("tache = 2").select("f_id", "period")
    order, last = [("period", True), ("f_id", True)], None
    for _ in range(2):
        *_, end = L.page_after(rows, order, last, 50).collect() or [None]
        if end is None:
            return rows.limit(0)
        last = end.asDict()
    return L.page_after(rows, order, last, 50)


@query("top_02", "SELECT tache, fp, count(*) AS total_sightings, arg_max(text, period || id) AS text FROM v_sightings GROUP BY tache, fp ORDER BY total_sightings DESC, tache, fp LIMIT 100", "v_sightings")
def core_top(spark, d):
    """The identities seen most often (flagship)."""
    from tallyloom.operators.layers import roll_up

    top = roll_up(v_sightings(spark, d)).orderBy(F.desc("total_sightings"), "tache", "fp").limit(100)
    return top.select("tache", "fp", "total_sightings", "text")


@query("set_01", "SELECT id, CASE WHEN id % 4 = 0 THEN 'b' WHEN id % 5 = 0 THEN 'a' ELSE 'common' END AS side FROM v_runs", "v_runs")
def common_ids(spark, d):
    """Ids that every run labelled, and extras of one run."""
    r = v_runs(spark, d)
    rows = r.filter("id % 4 <> 0").select("id", F.lit("a").alias("run")).unionByName(r.filter("id % 4 = 0 or id % 5 <> 0").select("id", F.lit("b").alias("run")))
    return rows.groupBy("id").agg(F.collect_set("run").alias("runs")).select("id", F.when(F.size("runs") == 2, "common").otherwise(F.col("runs")[0]).alias("side"))


@query("set_02", "SELECT 's' || (doc_id % 3) AS origin, id FROM v_sightings", "v_sightings")
def union_sources(spark, d):
    """Three files with different columns as one table."""
    rows = v_sightings(spark, d)
    parts = [rows.filter(F.col("doc_id") % 3 == k).select("id", F.lit(f"s{k}").alias("origin"), *(["text"] if k else ["period"])) for k in range(3)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).select("origin", "id")


@query("set_03", """WITH wanted AS (SELECT theme, core_subject FROM v_vocab WHERE length(theme || core_subject) % 3 <> 0 UNION SELECT theme, 'NEW' FROM v_vocab),
    used AS (SELECT DISTINCT p_brand AS theme, p_type AS core_subject FROM part WHERE p_size > 45)
    SELECT theme, core_subject, 'add' AS action FROM (SELECT * FROM wanted EXCEPT SELECT * FROM v_vocab) UNION ALL
    SELECT o.theme, o.core_subject, CASE WHEN u.theme IS NULL THEN 'orphaned' ELSE 'blocked' END FROM (SELECT * FROM v_vocab EXCEPT SELECT * FROM wanted) o LEFT JOIN used u USING (theme, core_subject)""", "v_vocab")
def vocab_diff(spark, d):
    """What to add to the vocabulary, what is orphaned, and what can't go because it is used."""
    from tallyloom.operators.labels import vocab_diff as diff

    have = v_vocab(spark, d)
    wanted = have.filter(F.length(F.concat("theme", "core_subject")) % 3 != 0).union(have.select("theme", F.lit("NEW")).distinct())
    used = table(spark, d, "part").filter("p_size > 45").select(F.col("p_brand").alias("theme"), F.col("p_type").alias("core_subject")).distinct()
    return diff(wanted, have, used, ["theme", "core_subject"])


@query("set_04", f"WITH {CORE} SELECT count(*) FILTER (representative IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS done, count(*) AS total FROM sub", "v_identity")
def representatives_done(spark, d):
    """How many representatives are practised."""
    reps = C.core_set(v_identity(spark, d), v_bank(spark, d), 2).select(F.col("representative").alias("f_id"))
    done = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("f_id")).distinct().withColumn("hit", F.lit(1))
    return reps.join(done, "f_id", "left").agg(F.count("hit").alias("done"), F.count("*").alias("total"))


@query("win_06", "SELECT theme, n, round(sum(n) OVER (ORDER BY n DESC, theme) / sum(n) OVER (), 6) AS cumulative FROM (SELECT theme, count(*) AS n FROM v_identity GROUP BY theme)", "v_identity")
def cumulative_share(spark, d):
    """Running share of themes, largest first."""
    counts = v_identity(spark, d).groupBy("theme").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "theme")
    return counts.select("theme", "n", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 6).alias("cumulative"))
