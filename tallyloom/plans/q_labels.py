"""Label runs, agreement, gold scores, decisions, vocabulary upkeep, and batch plumbing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import agreement as A, dedup as D, chunks as K, joins as J, labels as L
from tallyloom.plans.base import query, v_identity, v_runs, v_vectors, v_vocab
from tallyloom.sources.tables import table


def merged(spark, d):
    """Runs a, b and gold as answers of each id."""
    r = v_runs(spark, d)
    rows = r.select("id", F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("run", "value"), F.lit(1).alias("pos"))
    return J.merge_runs(rows)


def gold(spark, d):
    return v_runs(spark, d).select("id", "gold")


@query("agg_10", "SELECT count(*) AS shared, count(*) FILTER (a = b) AS agreed, count(*) FILTER (a <> b) AS disagreed, round(count(*) FILTER (a = b) / count(*), 4) AS rate FROM v_runs", "v_runs")
def agreement(spark, d):
    """How often two runs agree."""
    return A.agreement(merged(spark, d), 2)


@query("agg_11", """WITH p AS (SELECT least(a, b) || ' | ' || greatest(a, b) AS pair, count(*) AS n FROM v_runs WHERE a <> b GROUP BY ALL)
    SELECT pair, n, round(sum(n) OVER (ORDER BY n DESC, pair) / sum(n) OVER (), 6) AS cumulative FROM p""", "v_runs")
def label_pairs(spark, d):
    """What is confused with what."""
    return A.label_pairs(merged(spark, d), 2)


@query("agg_12", """WITH x AS (SELECT a AS label, 2 AS total, 0 AS disputed FROM v_runs WHERE a = b UNION ALL SELECT unnest([a, b]), 1, 1 FROM v_runs WHERE a <> b)
    SELECT label, CAST(sum(disputed) AS BIGINT) AS disputed, CAST(sum(total) AS BIGINT) AS total, round(sum(disputed) / sum(total), 6) AS rate FROM x GROUP BY label""", "v_runs")
def contest_rate(spark, d):
    """How disputed each label is."""
    return A.contest_rate(merged(spark, d), 2)


@query("agg_13", """SELECT CASE WHEN a = b THEN 'agreed' ELSE 'disagreed' END AS what, CAST(count(*) FILTER (a = gold OR b = gold) AS BIGINT) AS right, count(*) AS total FROM v_runs GROUP BY ALL UNION ALL
    SELECT 'run a', count(*) FILTER (a = gold), count(*) FROM v_runs UNION ALL SELECT 'run b', count(*) FILTER (b = gold), count(*) FROM v_runs""", "v_runs")
def gold_scores(spark, d):
    """Accuracy of agreed, disputed and single answers."""
    return A.gold_scores(merged(spark, d), gold(spark, d), 2)


@query("agg_14", "SELECT gold, a AS said, count(*) AS n FROM v_runs WHERE a = b AND a <> gold GROUP BY ALL", "v_runs")
def blind_spots(spark, d):
    """Wrong answers that all runs share."""
    return A.blind_spots(merged(spark, d), gold(spark, d), 2)


@query("agg_15", """WITH f AS (SELECT unnest([0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95]) AS floor), r AS (SELECT gold, confidence, CASE WHEN id % 9 = 0 THEN NULL ELSE a END AS value FROM v_runs)
    SELECT CAST(floor AS DOUBLE) AS floor, count(*) AS kept, round(count(*) / (SELECT count(*) FROM r), 6) AS coverage, round(count(*) FILTER (value = gold) / count(*), 6) AS accuracy FROM f JOIN r ON value IS NOT NULL AND confidence >= floor GROUP BY floor""", "v_runs")
def confidence_curve(spark, d):
    """Coverage and accuracy at confidence floors."""
    return A.confidence_curve(v_runs(spark, d).select("gold", "confidence", F.when(F.col("id") % 9 != 0, F.col("a")).alias("value")))


@query("agg_16", "SELECT theme AS gold, count(*) AS n FROM v_runs WHERE theme NOT IN (SELECT source FROM documents WHERE doc_id < 5) GROUP BY theme", "v_runs")
def option_coverage(spark, d):
    """Gold values that weren't offered."""
    offered = table(spark, d, "documents").filter("doc_id < 5").select(F.col("source").alias("gold"))
    return A.option_coverage(v_runs(spark, d).select(F.col("theme").alias("gold")), offered)


AGENT = """agent AS (SELECT id, gold, a AS blind, b AS bank, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 4 = 0 THEN b ELSE a END AS agent, CASE WHEN id % 12 = 0 THEN NULL ELSE 'label' END AS action,
    id % 7 = 0 AS is_new, id % 9 = 0 AS theme_wrong, 100 + id % 50 AS tokens, [id % 10, id % 13] AS evidence_ids, list_distinct([id % 10, id % 11, id % 13 - id % 2]) AS retrieved FROM v_runs)"""


def agent(spark, d):
    """Agent reports made of the runs."""
    r, i = v_runs(spark, d), F.col("id")
    return r.select(
        "id", "gold", F.col("a").alias("blind"), F.col("b").alias("bank"), F.when(i % 6 == 0, None).when(i % 4 == 0, F.col("b")).otherwise(F.col("a")).alias("agent"), F.when(i % 12 != 0, "label").alias("action"),
        (i % 7 == 0).alias("is_new"), (i % 9 == 0).alias("theme_wrong"), (100 + i % 50).alias("tokens"), F.array(i % 10, i % 13).alias("evidence_ids"), F.array_distinct(F.array(i % 10, i % 11, i % 13 - i % 2)).alias("retrieved"),
    )


@query("agg_17", f"""WITH {AGENT} SELECT count(*) AS n, count(*) FILTER (agent = bank) AS agreed, count(*) FILTER (agent <> blind) AS revised, count(*) FILTER (is_new) AS new, count(*) FILTER (theme_wrong) AS theme_wrong, count(*) FILTER (agent IS NULL AND action IS NOT NULL) AS deferred,
    count(*) FILTER (action IS NULL) AS capped, count(*) FILTER (len(list_filter(evidence_ids, lambda x: NOT list_contains(retrieved, x))) > 0) AS fabricated, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS max_tokens,
    count(*) FILTER (agent = gold AND blind <> gold) AS fixed, count(*) FILTER (blind = gold AND agent <> gold) AS broke, count(*) FILTER (agent = gold AND agent = bank) AS both_right,
    list_sort(list(tokens))[count(*) // 2 + 1] AS median_tokens FROM agent""", "v_runs")
def agent_report(spark, d):
    """What the agent did, as one row."""
    return A.agent_report(agent(spark, d))


@query("agg_18", f"WITH {AGENT} SELECT id, len(list_filter(list_distinct(evidence_ids), lambda x: NOT list_contains(retrieved, x))) = 0 AS evidence_ok FROM agent", "v_runs")
def evidence_check(spark, d):
    """Whether the cited ids were retrieved."""
    return A.evidence(agent(spark, d)).select("id", "evidence_ok")


@query("agg_19", """WITH ans AS (SELECT p_brand AS theme, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN p_type ELSE 'other ' || p_type END AS value FROM part WHERE p_partkey % 8 <> 0)
    SELECT a.theme, a.value, count(*) AS n, v.core_subject IS NOT NULL AS case_only FROM ans a LEFT JOIN v_vocab v ON v.theme = a.theme AND lower(v.core_subject) = lower(a.value) WHERE v.core_subject IS NULL OR v.core_subject <> a.value GROUP BY ALL""", "v_vocab")
def new_labels(spark, d):
    """Answers outside the vocabulary."""
    k = F.col("p_partkey") % 3
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 8 != 0, F.col("p_brand")).alias("theme"), F.when(k == 0, F.lower("p_type")).when(k == 1, F.col("p_type")).otherwise(F.concat(F.lit("other "), "p_type")).alias("value"))
    return A.new_labels(rows, v_vocab(spark, d).select("theme", F.col("core_subject").alias("name")), T.answer_key)


@query("agg_21", """WITH c AS (SELECT tache, ceil(rn / 20.0) AS chunk, sum(length(text) // 3 + 8) AS tokens FROM (SELECT tache, text, row_number() OVER (PARTITION BY tache ORDER BY id) AS rn FROM v_runs) GROUP BY ALL)
    SELECT count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS input_tokens, round(sum(tokens) * 2.5 / 1e6 * 0.5, 6) AS cost FROM c""", "v_runs")
def cost_estimate(spark, d):
    """What labelling the pending rows would cost."""
    chunks = K.grouped_chunks(v_runs(spark, d), 20, ["tache"], ["id"])
    return K.cost(chunks, price_per_million=2.5, discount=0.5)


@query("agg_22", "SELECT id % 5 AS batch, count(*) AS items, count(*) FILTER (id % 3 <> 0) AS decided FROM v_runs GROUP BY ALL", "v_runs")
def batch_progress(spark, d):
    """Items and decisions of each batch."""
    items = v_runs(spark, d).select((F.col("id") % 5).alias("batch"), F.when(F.col("id") % 3 != 0, F.col("a")).alias("decision"))
    return items.groupBy("batch").agg(F.count("*").alias("items"), F.count("decision").alias("decided"))


@query("top_03", """WITH p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
    SELECT a_id, b_id, score FROM p WHERE score >= 0.2 ORDER BY score DESC, a_id, b_id LIMIT 100""")
def top_pairs(spark, d):
    """The hundred strongest of all pairs."""
    return D.top_pairs(v_vectors(spark, d), 100, 0.2)


@query("top_04", "SELECT id, a AS said, gold FROM v_runs WHERE a <> gold ORDER BY confidence DESC, id LIMIT 10", "v_runs")
def most_confident_wrong(spark, d):
    """The ten most confident mistakes."""
    return v_runs(spark, d).filter("a <> gold").orderBy(F.desc("confidence"), "id").limit(10).select("id", F.col("a").alias("said"), "gold")


@query("lab_01", """WITH p AS (SELECT id // 2 AS f_id, CASE WHEN id % 10 = 0 THEN ' ' ELSE theme END AS value, id AS pos FROM v_runs), one AS (SELECT f_id, arg_min(value, pos) FILTER (trim(value) <> '') AS new FROM p GROUP BY f_id),
    bank AS (SELECT DISTINCT id // 2 AS f_id, CASE WHEN (id // 2) % 3 = 0 THEN 'src1' END AS label FROM v_runs WHERE (id // 2) % 7 <> 0)
    SELECT f_id, label AS old, new, CASE WHEN b.f_id IS NULL THEN 'unmatched' WHEN new IS NULL THEN 'blank' WHEN new IS NOT DISTINCT FROM label THEN 'same' WHEN label IS NOT NULL THEN 'skipped' ELSE 'changed' END AS action FROM one LEFT JOIN bank b USING (f_id)""", "v_runs")
def load_labels(spark, d):
    """A label file loaded without overwriting."""
    r = v_runs(spark, d)
    half = F.floor(F.col("id") / 2)
    rows = r.select(half.alias("f_id"), F.when(F.col("id") % 10 == 0, " ").otherwise(F.col("theme")).alias("value"), F.col("id").alias("pos"))
    bank = r.select(half.alias("f_id")).distinct().filter("f_id % 7 <> 0").select("f_id", F.when(F.col("f_id") % 3 == 0, "src1").alias("label"))
    return L.load_labels(rows, bank)


@query("lab_02", """WITH i AS (SELECT id AS f_id, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'nothing' WHEN 2 THEN NULL ELSE upper(theme) END AS decision, theme AS label FROM v_runs)
    SELECT f_id, CASE WHEN f_id % 5 >= 3 AND f_id % 4 <> 0 THEN label WHEN f_id % 4 = 0 THEN NULL ELSE 'src0' END AS label,
      CASE WHEN f_id % 4 = 0 OR f_id % 5 IN (0, 2) THEN 'skipped' WHEN f_id % 5 = 1 THEN 'unresolved' WHEN label = 'src0' THEN 'unchanged' ELSE 'applied' END AS action FROM i""", "v_runs")
def apply_decisions(spark, d):
    """Review decisions applied to the bank."""
    r, k = v_runs(spark, d), F.col("id") % 5
    items = r.select(F.col("id").alias("f_id"), F.when(k == 0, "").when(k == 1, "nothing").when(k == 2, None).otherwise(F.upper("theme")).alias("decision"))
    bank = r.filter("id % 4 <> 0").select(F.col("id").alias("f_id"), F.lit("src0").alias("label"))
    return L.apply_decisions(items, bank, r.select(F.col("theme").alias("name")).distinct(), T.label_key)


def items(spark, d):
    """Review items with one or two candidates, some decided."""
    r = v_runs(spark, d)
    c = F.when(F.col("id") % 6 == 0, F.create_map(F.lit("a"), "a")).otherwise(F.create_map(F.lit("a"), "a", F.lit("b"), "b"))
    return r.select("id", c.alias("candidates"), F.when(F.col("id") % 8 == 1, "human").alias("decision"))


@query("lab_03", "SELECT id, CASE WHEN id % 8 = 1 THEN 'human' WHEN id % 6 = 0 THEN a ELSE b END AS decision FROM v_runs", "v_runs")
def decide_all(spark, d):
    """All undecided items by one run."""
    return L.decide_all(items(spark, d), "b").select("id", "decision")


@query("lab_04", """SELECT id, CASE WHEN id % 8 = 1 THEN 'human' WHEN id % 6 <> 0 AND a = b THEN a END AS decision, CASE WHEN id % 8 = 1 THEN 'kept' WHEN id % 6 = 0 THEN 'single' WHEN a = b THEN 'agreed' ELSE 'split' END AS how FROM v_runs""", "v_runs")
def decide_agreed(spark, d):
    """Items decided where candidates agree."""
    return L.decide_agreed(items(spark, d), T.label_key).select("id", "decision", "how")


@query("lab_05", "SELECT DISTINCT x.v AS value, CASE WHEN x.v = '1' THEN (SELECT count(*) FROM v_runs WHERE gold = '1') END AS uses FROM (SELECT unnest(CASE WHEN id % 6 = 0 THEN [a] ELSE [a, b] END) AS v FROM v_runs) x", "v_runs")
def candidate_usage(spark, d):
    """How much used each candidate value is."""
    usage = v_runs(spark, d).groupBy(F.col("gold").alias("name")).agg(F.count("*").alias("uses")).filter("name = '1'")
    return L.candidate_usage(items(spark, d), usage, usage.select("name"), T.label_key)


PATCH = "CASE WHEN f_id % 4 = 0 THEN 'NEW' WHEN f_id % 4 = 1 THEN NULL ELSE theme END"


@query("lab_06", f"SELECT f_id, {PATCH} AS theme, CASE WHEN f_id % 6 = 0 THEN 'S' WHEN f_id % 4 <= 1 THEN NULL ELSE core_subject END AS core_subject FROM v_identity", "v_identity")
def set_labels(spark, d):
    """A patch in which absent and null differ."""
    bank = v_identity(spark, d).select("f_id", "theme", "core_subject")
    i = F.col("f_id")
    patch = bank.select("f_id", (i % 4 <= 1).alias("has_theme"), F.when(i % 4 == 0, "NEW").alias("new_theme"), (i % 6 == 0).alias("has_subject"), F.lit("S").alias("new_subject"))
    return L.set_labels(bank, patch)


@query("lab_07", """SELECT f_id, theme, CASE WHEN f_id % 3 = 0 AND theme = 'Brand#5' THEN 'S' ELSE core_subject END AS core_subject,
    CASE WHEN f_id % 3 <> 0 THEN 'untouched' WHEN theme = 'Brand#5' THEN 'applied' ELSE 'wrong theme' END AS action FROM v_identity""", "v_identity")
def bulk_label(spark, d):
    """One subject set on many; rows of other themes are skipped."""
    bank = v_identity(spark, d).select("f_id", "theme", "core_subject")
    return L.bulk_label(bank, bank.filter("f_id % 3 = 0").select("f_id"), "Brand#5", "S")


@query("lab_08", "SELECT f_id, CASE WHEN p_size IN (4, 7, 9) THEN 4 WHEN p_size IN (20, 30) THEN 20 ELSE p_size END AS subject_id FROM (SELECT p_partkey AS f_id, p_size FROM part)")
def merge_labels(spark, d):
    """Merged subjects repointed, chains included."""
    merges = table(spark, d, "part").select(F.lit(1)).limit(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in ((9, 7), (7, 4), (30, 20))])).alias("m")).select("m.*")
    return L.merge_labels(table(spark, d, "part").select(F.col("p_partkey").alias("f_id"), F.col("p_size").alias("subject_id")), merges)


@query("lab_09", "SELECT f_id, CASE WHEN core_subject LIKE 'S%' THEN 'MOVED' ELSE theme END AS theme, core_subject FROM v_identity", "v_identity")
def move_subject(spark, d):
    """Subjects moved to another theme take their questions along."""
    bank = v_identity(spark, d).select("f_id", "theme", "core_subject")
    moves = v_vocab(spark, d).select("core_subject").distinct().filter("core_subject like 'S%'").withColumn("to_theme", F.lit("MOVED"))
    return L.move_subject(bank, moves)


@query("lab_10", "SELECT theme, core_subject, count(p_partkey) AS uses, count(p_partkey) = 0 AS deletable FROM v_vocab LEFT JOIN (SELECT * FROM part WHERE p_size > 44) ON p_brand = theme AND p_type = core_subject GROUP BY ALL", "v_vocab")
def delete_guard(spark, d):
    """Deletions refused while a label is used."""
    used = table(spark, d, "part").filter("p_size > 44").select(F.col("p_brand").alias("theme"), F.col("p_type").alias("core_subject"))
    return L.delete_guard(v_vocab(spark, d), used, ["theme", "core_subject"])


@query("lab_11", "SELECT p_brand AS theme, lower(p_type) AS key, CAST(2 AS BIGINT) AS n FROM part WHERE p_size > 30 GROUP BY ALL")
def colliding_names(spark, d):
    """Sibling names that look alike."""
    rows = table(spark, d, "part").filter("p_size > 30").select(F.col("p_brand").alias("theme"), F.explode(F.array(F.col("p_type"), F.concat(F.lit(" "), F.lower("p_type")))).alias("name"))
    return L.colliding_names(rows, "theme", T.label_key(F.col("name")))


@query("lab_12", "SELECT id, 'theme' AS field, 'human' AS value, 'human' AS model FROM v_runs WHERE id % 8 = 1", "v_runs")
def human_gold(spark, d):
    """Decided rows as gold."""
    return L.human_gold(items(spark, d), "theme")


@query("chk_01", "SELECT id, tache, CAST(ceil(row_number() OVER (PARTITION BY tache ORDER BY id) / 20.0) AS INTEGER) AS chunk, CAST((row_number() OVER (PARTITION BY tache ORDER BY id) - 1) % 20 + 1 AS INTEGER) AS n FROM v_runs", "v_runs")
def grouped_chunks(spark, d):
    """Chunks that never mix tasks."""
    return K.grouped_chunks(v_runs(spark, d), 20, ["tache"], ["id"]).select("id", "tache", "chunk", "n")


@query("chk_02", """WITH RECURSIVE r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos, length(text) // 3 + 8 AS t FROM documents), c AS (SELECT *, sum(t) OVER (ORDER BY pos) AS upto FROM r),
    s AS (SELECT CAST(1 AS BIGINT) AS pos UNION ALL SELECT min(n.pos) FROM s JOIN c f ON f.pos = s.pos JOIN c n ON n.pos > s.pos AND (n.pos - s.pos >= 100 OR n.upto - f.upto + f.t > 20000) GROUP BY s.pos),
    b AS (SELECT c.*, (SELECT max(s.pos) FROM s WHERE s.pos <= c.pos) AS head FROM c)
    SELECT CAST(dense_rank() OVER (ORDER BY head) - 1 AS BIGINT) AS batch, min(doc_id) AS first_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM b GROUP BY head""")
def budgeted_batches(spark, d):
    """Greedy batches under both limits, in one order over all documents."""
    docs = table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    out = K.budgeted_batches(docs, ["doc_id"], "tokens", max_rows=100, max_tokens=20_000)
    return out.groupBy("batch").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


REPLY = """c AS (SELECT id, tache, gold, CAST(ceil(row_number() OVER (PARTITION BY tache ORDER BY id) / 20.0) AS INTEGER) AS chunk, CAST((row_number() OVER (PARTITION BY tache ORDER BY id) - 1) % 20 + 1 AS INTEGER) AS n FROM v_runs),
    bad AS (SELECT tache, chunk FROM c WHERE id % 37 = 5)"""


def replies(spark, d):
    """One JSON reply for each chunk; chunks with certain ids lack an answer, every answer comes twice."""
    rows = K.grouped_chunks(v_runs(spark, d), 20, ["tache"], ["id"])
    item = lambda answer: F.struct("n", answer.alias("answer"))
    kept = rows.filter("id % 37 <> 5")
    doubled = kept.select("tache", "chunk", "n", F.lit(0).alias("k"), item(F.lit("old")).alias("x")).unionByName(kept.select("tache", "chunk", "n", F.lit(1).alias("k"), item(F.col("gold")).alias("x")))
    reply = doubled.groupBy("tache", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "n", "x"))).alias("xs"))
    return rows, reply.select("tache", "chunk", F.to_json(F.struct(F.transform("xs", lambda e: e["x"]).alias("items"))).alias("reply"))


@query("chk_03", f"WITH {REPLY} SELECT id, gold AS answer FROM c ANTI JOIN bad USING (tache, chunk)", "v_runs")
def reply_align(spark, d):
    """Replies laid onto the rows that were asked; one missing answer voids the chunk, of doubled ones the last counts."""
    rows, reply = replies(spark, d)
    return K.align_replies(rows, reply, ["tache", "chunk"]).select("id", "answer")


@query("chk_04", "SELECT tache, chunk, string_agg(n || '. ' || theme, chr(10) ORDER BY n) AS body FROM (SELECT tache, theme, CAST(ceil(row_number() OVER (PARTITION BY tache ORDER BY id) / 20.0) AS INTEGER) AS chunk, (row_number() OVER (PARTITION BY tache ORDER BY id) - 1) % 20 + 1 AS n FROM v_runs) GROUP BY ALL", "v_runs")
def numbered_body(spark, d):
    """The numbered text of each chunk."""
    return K.numbered_body(K.grouped_chunks(v_runs(spark, d), 20, ["tache"], ["id"]), ["tache", "chunk"], "theme")


@query("chk_05", f"WITH {REPLY} SELECT id FROM c SEMI JOIN bad USING (tache, chunk)", "v_runs")
def failed_rows(spark, d):
    """Rows to ask again."""
    rows, reply = replies(spark, d)
    return rows.join(K.align_replies(rows, reply, ["tache", "chunk"]).select("id"), "id", "left_anti").select("id")
