"""Duplicates, layers, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T, vectors as V
from tallyloom.operators import dedup as D, knn as K, layers as L
from tallyloom.operators.materialize import materialize
from tallyloom.plans.base import query, spread_bank, sql_normalize, v_identity, v_list, v_sightings, v_vectors
from tallyloom.plans.q_text import TOK
from tallyloom.sources.tables import stamp, table

REPS = "reps AS (SELECT tache, fp, min(doc_id) AS id, arg_min(text, doc_id) AS text, arg_min(source, doc_id) AS source FROM v_sightings GROUP BY tache, fp)"
VEC = f"""{REPS}, toks AS (SELECT id, tache, {TOK} AS w FROM reps), grams AS (SELECT id, tache, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM toks),
    tf AS (SELECT id, tache, term, 1 + ln(count(*)) AS tf FROM grams GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    wt AS (SELECT id, tache, term, df, tf * (ln((1.0 + (SELECT count(*) FROM reps)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term)), nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM wt GROUP BY id),
    vec AS (SELECT id, tache, term, df, w / n AS w FROM wt JOIN nm USING (id) WHERE df >= 2)"""
PAIRS = f"{VEC}, pairs AS (SELECT a.id AS a_id, b.id AS b_id, sum(a.w * b.w) AS score FROM vec a JOIN vec b ON a.term = b.term AND a.tache = b.tache AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.55)"
CLUSTERS = f"""{PAIRS}, edges AS (SELECT a_id AS x, b_id AS y FROM pairs WHERE score >= 0.75 UNION SELECT b_id, a_id FROM pairs WHERE score >= 0.75),
    reach AS (SELECT id, id AS root FROM reps UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.id), clusters AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"""

PRODUCTS = "p AS (SELECT list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


def told(spark, d, *columns):
    """These columns of the sightings as a written table: a text's fingerprint is computed once, however often it is read or joined."""
    return materialize(v_sightings(spark, d).select(*columns), "told")


FEW_ROWS = 1_000_000  #: rows of exact groups that are broadcast to the texts
_kept = {}  #: tables that several queries read, by application, folder and state of its files


def kept(spark, d, name, make, compression=None):
    """The table that `make` gives, written once in an application for each state of the documents."""
    key = (spark.sparkContext.applicationId, d, stamp(spark, d, "documents"), name)
    if key not in _kept:
        _kept[key] = materialize(make(), name, compression)
    return _kept[key]


def forget():
    """Let the next query compute what several share anew."""
    _kept.clear()


def briefs(spark, d):
    """All sightings, as a written table, with what ranks them and the digest of their normal form instead of the text: a text is read for it once, and stays."""
    rows = v_sightings(spark, d)
    brief = rows.select("doc_id", "id", "tache", "fp", "period", "source", D.canonical_order().alias("latest"), F.sha2(T.normalize_text(F.col("text")), 256).alias("normal"))
    return kept(spark, d, "briefs", lambda: brief, "zstd")


def reps(spark, d):
    """One sighting for each exact group: the first. As a written table, since several steps read it."""

    def first():
        brief = briefs(spark, d)
        n, ids = brief.agg(F.count("*"), F.countDistinct("doc_id")).first()
        if n > ids:  # ids that repeat or are null don't tell rows apart: these come with their texts
            chosen = v_sightings(spark, d).groupBy("tache", "fp").agg(F.min(F.struct("doc_id", "text", "source")).alias("r"))
            return chosen.select("tache", "fp", F.col("r.doc_id").alias("id"), F.col("r.text").alias("text"), F.col("r.source").alias("source"))
        chosen = brief.groupBy("tache", "fp").agg(F.min(F.struct("doc_id", "source")).alias("r")).select("tache", "fp", F.col("r.doc_id").alias("id"), F.col("r.source").alias("source"))
        texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
        return texts.join(F.broadcast(chosen) if n <= FEW_ROWS else chosen, "id").select("tache", "fp", "id", "text", "source")

    return kept(spark, d, "reps", first, "zstd")


def pairs(spark, d):
    return kept(spark, d, "pairs", lambda: D.cosine_pairs(D.packed_weights(reps(spark, d).select("id", "tache", "text")), 0.55))


def clusters(spark, d):
    """Single-linkage clusters at 0.75, as a table."""
    return kept(spark, d, "clusters", lambda: D.single_linkage(reps(spark, d), pairs(spark, d).filter("score >= 0.75")))


def clustered(spark, d):
    """All sightings with their cluster, as briefs: no text moves."""
    groups = clusters(spark, d).join(reps(spark, d).select("id", "tache", "fp"), "id").select("tache", "fp", "cluster")
    return briefs(spark, d).join(groups, ["tache", "fp"])


def latest():
    return F.col("latest")


@query("ded_01", "SELECT tache, fp, count(*) AS members, min(id) AS first_id FROM v_sightings GROUP BY ALL", "v_sightings")
def exact_groups(spark, d):
    """Exact duplicates within a task."""
    return D.exact_groups(v_sightings(spark, d))


@query("ded_02", r"""SELECT tache, fp, arg_max(id, (period, CAST(regexp_matches(trim(text), '[?.]$') AS INTEGER), length(text), -doc_id)) AS latest,
    arg_max(id, (CAST(regexp_matches(trim(text), '[?.]$') AS INTEGER), length(text), -doc_id)) AS longest FROM v_sightings GROUP BY ALL""", "v_sightings")
def pick_canonical(spark, d):
    """The record that stands for each exact group, by two strategies."""
    return v_sightings(spark, d).groupBy("tache", "fp").agg(F.max_by("id", D.canonical_order("latest")).alias("latest"), F.max_by("id", D.canonical_order("longest")).alias("longest"))


@query("ded_03", f"WITH {VEC} SELECT id, count(*) AS terms, round(sum(w), 6) AS mass, round(sum(w * w), 6) AS kept FROM vec GROUP BY id", "v_sightings")
def term_weights(spark, d):
    """The weighted vector of each representative, summed up."""
    v = D.packed_weights(reps(spark, d).select("id", "tache", "text"))
    of = lambda f: F.round(F.aggregate("ws", F.lit(0.0), lambda s, w: s + f(w)), 6)
    return v.select("id", F.size("terms").cast("long").alias("terms"), of(lambda w: w).alias("mass"), of(lambda w: w * w).alias("kept"))


@query("ded_04", f"WITH {PAIRS} SELECT a_id, b_id, round(score, 6) AS score FROM pairs", "v_sightings")
def sparse_pairs(spark, d):
    """All pairs of weighted cosine 0.55 or more."""
    return pairs(spark, d).withColumn("score", F.round("score", 6))


@query("ded_05", "SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4")
def dense_pairs(spark, d):
    """All pairs of vectors with cosine 0.4 or more."""
    return D.dense_pairs(v_vectors(spark, d), 0.4).withColumn("score", F.round("score", 6))


@query("ded_05_lsh", f"WITH {PRODUCTS} SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS wrong, true AS enough FROM p WHERE s >= 0.4")
def similar_pairs(spark, d):
    """The pairs that buckets of random projections find, against all: none is wrong, and nine tenths at least are found."""
    v = v_vectors(spark, d)
    every = D.dense_pairs(v, 0.4).select("a_id", "b_id", F.lit(1).alias("real"))
    found = D.similar_pairs(v, 0.4, bits=4).select("a_id", "b_id", F.lit(1).alias("given"))
    both = every.join(found, ["a_id", "b_id"], "full")
    return both.agg(F.count("real").alias("pairs"), F.count(F.when(F.col("real").isNull(), 1)).alias("wrong"), (F.coalesce(F.count(F.when(F.col("real").isNotNull(), F.col("given"))) / F.count("real"), F.lit(1.0)) >= 0.9).alias("enough"))


@query("ded_06", f"WITH {PAIRS} SELECT CASE WHEN score >= 0.95 THEN 'merge' ELSE 'review' END AS band, count(*) AS n FROM pairs GROUP BY ALL", "v_sightings")
def banding(spark, d):
    """Pairs to merge and pairs to review."""
    return D.banded(pairs(spark, d)).groupBy("band").agg(F.count("*").alias("n"))


@query("ded_07", f"WITH RECURSIVE {CLUSTERS} SELECT id, cluster FROM clusters", "v_sightings")
def single_linkage(spark, d):
    """Clusters by single linkage."""
    return clusters(spark, d)


@query("ded_07_capped")
def capped_linkage(spark, d):
    """Single linkage with six members at most, strongest edges first; tested against a plain walk."""
    return D.single_linkage(reps(spark, d), pairs(spark, d).filter("score >= 0.75"), max_cluster=6)


@query("ded_08")
def complete_linkage(spark, d):
    """Clusters by complete linkage; tested against a plain walk."""
    out, _ = D.complete_linkage(reps(spark, d), pairs(spark, d).filter("score >= 0.75"))
    return out


CANON = f"""{CLUSTERS}, rows AS (SELECT s.*, {sql_normalize('s.text')} AS normal, c.cluster FROM v_sightings s JOIN reps r USING (tache, fp) JOIN clusters c ON c.id = r.id),
    heads AS (SELECT cluster, arg_max(id, k) AS head, arg_max(normal, k) AS text, arg_max(period, k) AS month, arg_max(fp, k) AS head_fp, count(*) AS occurrences,
      count(DISTINCT source) AS n_sources, string_agg(DISTINCT period, ',' ORDER BY period) AS months, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
      FROM (SELECT *, (period, CAST(regexp_matches(trim(text), '[?.]$') AS INTEGER), length(text), -doc_id) AS k FROM rows) GROUP BY cluster)"""


def canon(spark, d):
    return D.canonical_records(clustered(spark, d), latest)


@query("ded_09", f"""WITH RECURSIVE {CANON} SELECT h.cluster, head AS id, any_value(h.text) AS text, any_value(month) AS month, any_value(sources) AS sources, any_value(months) AS months, any_value(occurrences) AS occurrences,
    coalesce(string_agg(id, ',' ORDER BY id) FILTER (id <> head), '') AS duplicates, coalesce(string_agg(id, ',' ORDER BY id) FILTER (id <> head AND fp = head_fp), '') AS exact_duplicates,
    CAST(count(DISTINCT normal) - 1 AS INTEGER) AS n_variants FROM heads h JOIN rows r ON r.cluster = h.cluster GROUP BY h.cluster, head""", "v_sightings")
def canonical_records(spark, d):
    """Canonical records with their duplicates."""
    # The records move with digests; then the canonicals' texts come, each by one shuffle.
    normal = v_sightings(spark, d).select("id", T.normalize_text(F.col("text")).alias("text")).select(F.col("id").alias("_id"), F.sha2("text", 256).alias("_normal"), "text")
    texts = normal.groupBy("_id", "_normal").agg(F.min("text").alias("text"))
    records = canon(spark, d).withColumnRenamed("text", "normal")
    c = records.join(texts, F.col("id").eqNullSafe(F.col("_id")) & F.col("normal").eqNullSafe(F.col("_normal")))
    join = lambda x: F.array_join(x, ",")
    return c.select("cluster", "id", "text", "month", join("sources").alias("sources"), join("months").alias("months"), "occurrences", join("duplicate_ids").alias("duplicates"), join("exact_duplicate_ids").alias("exact_duplicates"), F.size("variants").alias("n_variants"))


@query("ded_09_members", f"""WITH RECURSIVE {CANON} SELECT r.cluster, h.head AS canonical_id, r.id, CASE WHEN r.id = h.head THEN 'canonical' WHEN r.fp = h.head_fp THEN 'exact' ELSE 'duplicate' END AS kind, r.normal <> h.text AS variant
    FROM heads h JOIN rows r ON r.cluster = h.cluster""", "v_sightings")
def cluster_members(spark, d):
    """Each sighting with the canonical record that stands for it."""
    return D.cluster_members(clustered(spark, d), latest)


@query("ded_10", f"""WITH RECURSIVE {CANON}, l AS (SELECT x.head AS a, y.head AS b FROM pairs p JOIN clusters ca ON ca.id = p.a_id JOIN clusters cb ON cb.id = p.b_id JOIN heads x ON x.cluster = ca.cluster JOIN heads y ON y.cluster = cb.cluster WHERE p.score < 0.75 AND x.head <> y.head)
    SELECT a AS id, string_agg(DISTINCT b, ',' ORDER BY b) AS near FROM (SELECT a, b FROM l UNION SELECT b, a FROM l) GROUP BY a""", "v_sightings")
def near_duplicates(spark, d):
    """Uncertain neighbours of canonical records."""
    out = D.near_duplicate_ids(pairs(spark, d).filter("score < 0.75"), clusters(spark, d), D.canonical_heads(clustered(spark, d), latest))
    return out.select("id", F.array_join("near_duplicate_ids", ",").alias("near"))


@query("ded_10_pairs", f"""WITH RECURSIVE {CANON}, l AS (SELECT x.head AS a, y.head AS b FROM pairs p JOIN clusters ca ON ca.id = p.a_id JOIN clusters cb ON cb.id = p.b_id JOIN heads x ON x.cluster = ca.cluster JOIN heads y ON y.cluster = cb.cluster WHERE p.score < 0.75 AND x.head <> y.head)
    SELECT a AS id, b AS near_id FROM l UNION SELECT b, a FROM l""", "v_sightings")
def near_duplicate_rows(spark, d):
    """The same as rows, for records with any number of neighbours."""
    return D.near_duplicate_pairs(pairs(spark, d).filter("score < 0.75"), clusters(spark, d), D.canonical_heads(clustered(spark, d), latest))


@query("ded_11", f"WITH RECURSIVE {CANON} SELECT head AS id, n_sources, occurrences FROM heads ORDER BY n_sources DESC, occurrences DESC, head LIMIT 200", "v_sightings")
def rank_canonicals(spark, d):
    """Canonical records seen in most sources."""
    return D.ranked(canon(spark, d)).limit(200).select("id", F.size("sources").cast("long").alias("n_sources"), "occurrences")


@query("ded_12", f"WITH RECURSIVE {CLUSTERS} SELECT (SELECT count(*) FROM v_sightings) AS n_rows, count(DISTINCT cluster) AS n_canonical, (SELECT count(*) FROM v_sightings) - count(DISTINCT cluster) AS n_duplicates, true AS exact_within, true AS balanced FROM clusters", "v_sightings")
def accounting(spark, d):
    """Nothing is lost or counted twice."""
    return D.accounting(canon(spark, d), v_sightings(spark, d))


@query("ded_13", f"WITH {PAIRS} SELECT a_id, b_id, round(score, 4) AS score, a.text AS a_text, a.source AS a_theme, substr(a.text, 1, 160) AS a_abstract, b.text AS b_text, b.source AS b_theme, substr(b.text, 1, 160) AS b_abstract FROM pairs JOIN reps a ON a.id = a_id JOIN reps b ON b.id = b_id WHERE score < 0.95", "v_sightings")
def review_queue(spark, d):
    """Pairs to review with the texts, themes and abstracts of both sides; a source stands for the theme, a text's head for its abstract."""
    sides = reps(spark, d).select("id", "text", F.col("source").alias("theme"), T.snippet(F.col("text"), 160).alias("abstract"))
    return D.review_queue(pairs(spark, d).filter("score < 0.95"), sides)


@query("ded_14", f"""WITH RECURSIVE {PAIRS}, merges AS (SELECT a_id AS x, b_id AS y FROM pairs WHERE (a_id + b_id) % 2 = 0 UNION SELECT b_id, a_id FROM pairs WHERE (a_id + b_id) % 2 = 0),
    reach AS (SELECT id, id AS root FROM reps UNION SELECT m.y, r.root FROM reach r JOIN merges m ON m.x = r.id) SELECT id, min(root) AS canonical_id FROM reach GROUP BY id""", "v_sightings")
def pair_decisions(spark, d):
    """Reviewers' verdicts applied."""
    verdicts = pairs(spark, d).select(F.concat_ws("|", "a_id", "b_id").alias("pair"), F.when((F.col("a_id") + F.col("b_id")) % 2 == 0, "merge").otherwise("reject").alias("verdict"))
    return D.apply_pair_decisions(reps(spark, d), verdicts)


@query("joi_08", f"WITH {PAIRS} SELECT a_id, b_id FROM pairs", "v_sightings")
def pair_self_join(spark, d):
    """Unordered pairs of one task, each once."""
    return pairs(spark, d).select("a_id", "b_id")


@query("agg_20", f"""WITH {PRODUCTS} SELECT count(*) AS pairs, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(s, 0.99), 6) AS p99,
    round(quantile_cont(s, 0.999), 6) AS p99_9, round(min(s), 6) AS min, round(max(s), 6) AS max FROM p""")
def score_distribution(spark, d):
    """Quantiles of the scores of all pairs, those below 0 as well."""
    return D.score_quantiles(v_vectors(spark, d))


@query("lay_01", "SELECT tache, fp, arg_max(text, period || id) AS text, min(period) AS first_seen, max(period) AS last_seen, count(*) AS total_sightings, count(DISTINCT period) AS months_seen FROM v_sightings GROUP BY tache, fp", "v_sightings")
def fingerprint_rollup(spark, d):
    """The identity layer."""
    return L.roll_up(v_sightings(spark, d))


@query("lay_02", """WITH k AS (SELECT DISTINCT tache, fp FROM v_sightings WHERE doc_id % 3 <> 0), known AS (SELECT tache, fp, row_number() OVER (ORDER BY tache, fp) AS f_id FROM k),
    new AS (SELECT DISTINCT tache, fp FROM v_sightings ANTI JOIN known USING (tache, fp)) SELECT tache, fp, f_id FROM known UNION ALL SELECT tache, fp, (SELECT count(*) FROM known) + row_number() OVER (ORDER BY tache, fp) FROM new""", "v_sightings")
def stable_ids(spark, d):
    """Ids of a first load stay when the rest is loaded."""
    rows = told(spark, d, "doc_id", "tache", "fp")
    none = spark.createDataFrame([], "tache int, fp string, f_id long")
    known = materialize(L.assign_ids(rows.filter("doc_id % 3 <> 0"), none), "ids")
    return L.assign_ids(rows, known)


@query("lay_03", "SELECT tache, period, fp, count(*) AS month_sightings, max(id) AS representative_raw_id FROM v_sightings GROUP BY ALL", "v_sightings")
def list_rollup(spark, d):
    """The month layer."""
    return L.month_rows(v_sightings(spark, d), ("tache", "period", "fp"))


@query("lay_04", """WITH o AS (SELECT f_id, total_sightings + CASE WHEN f_id % 10 = 3 THEN 1 ELSE 0 END AS t FROM v_identity WHERE f_id % 7 <> 0), n AS (SELECT f_id, total_sightings AS t FROM v_identity WHERE f_id % 11 <> 0)
    SELECT f_id, CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'stale' WHEN o.t = n.t THEN 'unchanged' ELSE 'updated' END AS action FROM n FULL JOIN o USING (f_id)""", "v_identity")
def upsert_diff(spark, d):
    """What a load would add, change, or leave."""
    ids = v_identity(spark, d).select("f_id", "total_sightings")
    old = ids.filter("f_id % 7 <> 0").select("f_id", (F.col("total_sightings") + F.when(F.col("f_id") % 10 == 3, 1).otherwise(0)).alias("total_sightings"))
    return L.upsert_actions(ids.filter("f_id % 11 <> 0"), old, ["f_id"], ["total_sightings"])


@query("lay_05", "SELECT f_id FROM v_identity WHERE tache = 2 AND f_id % 9 = 4", "v_identity")
def prune_stale(spark, d):
    """Rows of one task that the input no longer has."""
    ids = v_identity(spark, d)
    return L.stale_rows(ids, ids.filter("f_id % 9 <> 4"), ["f_id"], tache=2).select("f_id")


@query("lay_06", """WITH s AS (SELECT * FROM v_sightings WHERE doc_id % 4 <> 0), b AS (SELECT * FROM v_sightings WHERE doc_id % 2 = 0)
    SELECT 'sightings' AS what, count(*) AS n FROM (SELECT id FROM b EXCEPT SELECT id FROM s) UNION ALL SELECT 'identities', count(*) FROM (SELECT tache, fp FROM b EXCEPT SELECT tache, fp FROM s)
    UNION ALL SELECT 'month rows', count(*) FROM (SELECT tache, fp, period FROM b EXCEPT SELECT tache, fp, period FROM s)""", "v_sightings")
def dry_run(spark, d):
    """What a batch would add."""
    rows = told(spark, d, "doc_id", "id", "tache", "fp", "period")
    return L.dry_run(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 4 <> 0"))


@query("lay_07", "SELECT tache, fp, count(*) AS total_sightings FROM v_sightings SEMI JOIN (SELECT tache, fp FROM v_sightings WHERE doc_id % 10 = 0) t USING (tache, fp) GROUP BY ALL", "v_sightings")
def idempotent_import(spark, d):
    """A batch that is loaded again: only its identities are computed anew, and to the same counts."""
    rows = told(spark, d, "doc_id", "id", "tache", "fp", "period", "text")
    return L.roll_up(L.touched_keys(rows.filter("doc_id % 10 = 0"), rows, ["tache", "fp"])).select("tache", "fp", "total_sightings")


@query("lay_08", """SELECT 'orphan sightings' AS problem, count(*) AS n FROM v_bank WHERE f_id % 50 = 7 UNION ALL SELECT 'orphan months', count(*) FROM v_list WHERE f_id % 50 = 7
    UNION ALL SELECT 'wrong theme', count(*) FROM v_identity i JOIN (SELECT core_subject, min(theme) AS t FROM v_identity GROUP BY 1) USING (core_subject) WHERE theme <> t AND f_id % 50 <> 7 UNION ALL SELECT 'repeated keys', 0""", "v_identity v_list")
def integrity(spark, d):
    """Broken references of the layers."""
    bank = spread_bank(spark, d)
    ids = v_identity(spark, d, bank)
    themes = F.broadcast(ids.groupBy("core_subject").agg(F.min("theme").alias("subject_theme")))  # a row for each subject of the vocabulary
    return L.integrity(bank, v_list(spark, d, bank), ids.filter("f_id % 50 <> 7"), themes)


@query("lay_09", """SELECT user_id, event_id % 50 AS f_id, min(event_id) AS id FROM events WHERE event_id % 60 < 50 GROUP BY ALL""")
def rekey(spark, d):
    """Users' rows moved to new keys; the first of each stays."""
    ev = table(spark, d, "events").select("user_id", (F.col("event_id") % 60).alias("old"), F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("new_hint"))
    mapping = ev.filter("old < 50").select(F.concat_ws("-", "old", "new_hint").alias("key"), F.col("new_hint").alias("f_id")).distinct()
    rows = ev.select("user_id", F.concat_ws("-", "old", "new_hint").alias("key"), "id")
    return L.rekey(rows, mapping, "key", "f_id", "user_id", "id").select("user_id", "f_id", "id")


@query("lay_10", "SELECT event_id FROM events")
def straggler_sweep(spark, d):
    """Rows that a table lacks are added, others stay."""
    ev = table(spark, d, "events").select("event_id")
    new, old = ev.filter("event_id % 3 <> 1"), ev
    return new.unionByName(L.stale_rows(old, new, ["event_id"]))


@query("lay_11", "SELECT tache, count(*) AS n, round(count(CASE WHEN f_id % 5 <> 0 THEN 1 END) / count(*), 6) AS theme, round(count(CASE WHEN f_id % 3 <> 0 THEN 1 END) / count(*), 6) AS core_subject FROM v_identity GROUP BY tache", "v_identity")
def coverage(spark, d):
    """The share of identities that have each label."""
    from tallyloom.plans.q_bank import labelled

    return L.coverage(labelled(spark, d), ["theme", "core_subject"])


NEAR = """s AS (SELECT a.vec_id AS q_id, b.vec_id AS f_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score, a.label AS ql, b.label AS fl FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, f_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5)"""


@query("knn_01", f"WITH {NEAR} SELECT q_id, f_id, round(score, 4) AS score, rank FROM near")
def knn(spark, d):
    """The five nearest vectors of every vector."""
    v = v_vectors(spark, d).select("f_id", "embedding")
    return K.exact_knn(v, v, 5)


NEAR_SEARCHABLE = NEAR.replace("ON a.vec_id <> b.vec_id", "ON a.vec_id <> b.vec_id WHERE b.label % 3 <> 0")


@query("knn_01_cells", f"WITH {NEAR_SEARCHABLE} SELECT q_id, f_id, round(score, 4) AS score, rank FROM near")
def knn_cells(spark, d):
    """The same among the vectors that have a subject, in small cells, most of which a query may skip."""
    v = v_vectors(spark, d).withColumn("core_subject", F.when(F.col("core_subject") % 3 != 0, F.col("core_subject")))
    return K.exact_knn(v, v, 5, searchable=F.col("core_subject").isNotNull(), cell_rows=100)


@query("knn_02", "SELECT vec_id AS f_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) , 4) AS before, 1.0::DOUBLE AS after FROM embeddings")
def unit_vectors(spark, d):
    """Vectors scaled to unit length."""
    v = v_vectors(spark, d)
    scaled = v.select("f_id", "embedding", V.unit(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("u"))
    norm = lambda c: F.sqrt(V.dot(F.col(c), F.col(c)))
    return scaled.select("f_id", F.round(norm("embedding"), 4).alias("before"), F.round(norm("u"), 4).alias("after"))


@query("knn_03", "SELECT DISTINCT sha256('m1' || chr(0) || text) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def embed_cache(spark, d):
    """Texts whose vectors are missing."""
    docs = table(spark, d, "documents")
    cache = docs.filter("doc_id % 2 = 0").select(F.sha2(F.concat(F.lit("m1\x00"), "text"), 256).alias("key")).distinct()
    return K.missing_vectors(docs.select("text"), cache, "m1").select("key")


@query("knn_04", f"WITH {NEAR} SELECT q_id, fl AS core_subject, count(*) AS votes, round(max(score), 4) AS best FROM near GROUP BY ALL")
def label_vote(spark, d):
    """Votes of the neighbours' labels."""
    v = v_vectors(spark, d)
    return K.label_vote(K.exact_knn(v.select("f_id", "embedding"), v.select("f_id", "embedding"), 5), v, "core_subject")


@query("agg_24", f"WITH {NEAR}, q AS (SELECT q_id, max(CAST(ql = fl AS INTEGER)) AS s, max(CAST(ql // 4 = fl // 4 AS INTEGER)) AS t FROM near GROUP BY q_id) SELECT count(*) AS queries, round(avg(s), 6) AS core_subject, round(avg(t), 6) AS theme FROM q")
def recall_at_k(spark, d):
    """How often the right label is among five neighbours."""
    v = v_vectors(spark, d)
    return K.recall_at_k(K.exact_knn(v.select("f_id", "embedding"), v.select("f_id", "embedding"), 5), v, ["core_subject", "theme"])
