"""Sources and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.plans.base import _WS, query, sql_flatten, sql_key, sql_normalize, v_bank, v_identity, v_runs, v_sightings
from tallyloom.operators.materialize import scratch_path
from tallyloom.sources import jsonl
from tallyloom.sources.tables import table

TOK = f"regexp_extract_all({sql_flatten('text')}, '[a-z0-9]+')"


@query("src_01", "SELECT id, text, tache, period, source FROM v_sightings", "v_sightings")
def scan_jsonl(spark, d):
    """Sightings written as JSON lines and scanned back."""
    path = scratch_path(spark, "jsonl")
    v_sightings(spark, d).select("id", "text", "tache", "period", "source").write.json(path)
    return jsonl.scan_jsonl(spark, path).filter("_corrupt is null").select("id", "text", F.col("tache").cast("int").alias("tache"), "period", "source")


@query("src_02", """SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'T' || tache WHEN doc_id % 3 = 1 THEN CAST(tache AS VARCHAR) ELSE 'unknown' END AS task,
    CASE WHEN doc_id % 4 = 0 THEN '2024-' || lpad(CAST(doc_id % 6 + 1 AS VARCHAR), 2, '0') WHEN doc_id % 4 = 1 THEN 'slug-' || period WHEN doc_id % 4 = 2 THEN period ELSE '' END AS month FROM v_sightings""", "v_sightings")
def harmonise(spark, d):
    """Four file layouts brought to one task and one month column."""
    k, at = F.col("doc_id") % 3, F.col("doc_id") % 4
    raw = v_sightings(spark, d).select(
        "id",
        F.when(k == 0, F.concat(F.lit("T"), F.col("tache").cast("string"))).alias("task"),
        F.when(k == 1, F.col("tache").cast("string")).alias("tache"),
        F.when(at == 0, 2024).alias("year"),
        F.when(at == 0, (F.col("doc_id") % 6 + 1).cast("string")).when(at == 2, F.col("period")).alias("month"),
        F.when(at == 1, F.concat(F.lit("slug-"), F.col("period"))).alias("month_slug"),
    )
    return jsonl.harmonise(raw).select("id", "task", "month")


@query("src_03", "SELECT id, 'data/tache' || tache || '.jsonl' AS file FROM v_sightings WHERE tache IN (2) OR doc_id % 2 = 0 AND tache = 3 ", "v_sightings")
def select_sources(spark, d):
    """Only the files of the two tasks; derived files are left out."""
    f = F.when((F.col("tache") == 2) | (F.col("doc_id") % 2 == 0), F.concat(F.lit("data/tache"), F.col("tache").cast("string"), F.lit(".jsonl"))).otherwise(F.lit("data/tache3.canonical.jsonl"))
    return jsonl.select_sources(v_sightings(spark, d).withColumn("file", f), ["tache2", "tache3"], "file").select("id", "file")


@query("src_04", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN 'no id' WHEN length(trim(text)) < 40 THEN 'short text' WHEN doc_id % 11 = 0 THEN 'other task' ELSE 'valid' END AS reason FROM v_sightings) GROUP BY reason""", "v_sightings")
def validity(spark, d):
    """Valid rows and dropped rows counted by reason."""
    rows = v_sightings(spark, d)
    valid, dropped = jsonl.validity_split(rows, {"no id": F.col("doc_id") % 17 == 0, "short text": F.length(F.trim("text")) < 40, "other task": F.col("doc_id") % 11 == 0})
    return dropped.unionByName(valid.agg(F.count("*").alias("n")).select(F.lit("valid").alias("reason"), "n").filter("n > 0"))


@query("src_05", """WITH f AS (SELECT lpad(CAST(doc_id // 2 AS VARCHAR), 13, '0') AS id, doc_id AS pos, doc_id % 2 AS file, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source FROM v_sightings)
    SELECT * FROM (SELECT id, arg_max(text, pos) FILTER (text <> '') AS text, arg_max(source, pos) FILTER (source IS NOT NULL) AS source FROM f GROUP BY id) WHERE text IS NOT NULL""", "v_sightings")
def merge_by_id(spark, d):
    """Two files merged on id; the later value of each field wins where it isn't empty."""
    at = F.col("doc_id")
    rows = v_sightings(spark, d).select(
        F.lpad(F.floor(at / 2).cast("string"), 13, "0").alias("id"), (at % 2).alias("file"), at.alias("pos"), F.when(at % 5 == 0, "").otherwise(F.col("text")).alias("text"), F.when(at % 3 != 0, F.col("source")).alias("source")
    )
    return jsonl.merge_by_id(rows, "id", ["text", "source"], ["file", "pos"]).filter("text is not null").select("id", "text", "source")


@query("src_06", "SELECT run, id, field, value FROM (SELECT 'a' AS run, CAST(id AS VARCHAR) AS id, 'theme' AS field, a AS value FROM v_runs UNION ALL SELECT 'b', CAST(id AS VARCHAR), 'core_subject', b FROM v_runs)", "v_runs")
def pivot_labels(spark, d):
    """Label files whose answer column is inferred, as one long table."""
    runs = v_runs(spark, d)
    a = runs.select("id", F.col("a").alias("theme"), F.lit("m1").alias("model"))
    b = runs.select("id", "text", F.col("b").alias("core_subject"), F.lit("m2").alias("model"))
    return jsonl.long_labels(a, "a").unionByName(jsonl.long_labels(b, "b"))


@query("src_07", "SELECT f_id, tache, period, month_sightings FROM v_list", "v_bank v_list")
def sink_jsonl(spark, d):
    """Rows through JSON lines in key order."""
    from tallyloom.plans.base import v_list

    rows = v_list(spark, d).select("f_id", "tache", "period", "month_sightings")
    path = scratch_path(spark, "jsonl")
    jsonl.write_jsonl(rows, path, [F.col("f_id"), F.col("period")])
    return spark.read.schema(rows.schema).json(path)


@query("src_08", "SELECT f_id, substr(sha256(text || f_id), 1, 12) AS fingerprint, theme AS theme_name, months_seen FROM v_identity WHERE tache = 2", "v_identity")
def export_view(spark, d):
    """A filtered view flattened for export."""
    view = v_identity(spark, d).filter("tache = 2").select("f_id", F.sha2(F.concat("text", F.col("f_id").cast("string")), 256).alias("fingerprint"), "theme", "months_seen")
    return jsonl.export_view(view, {"theme": "theme_name"})


@query("src_08_csv", "SELECT f_id, substr(sha256(text || f_id), 1, 12) AS fingerprint, theme AS theme_name, text, months_seen FROM v_identity", "v_identity")
def export_flat_files(spark, d):
    """The whole view as CSV files with a header, read back."""
    view = v_identity(spark, d).select("f_id", F.sha2(F.concat("text", F.col("f_id").cast("string")), 256).alias("fingerprint"), "theme", "text", "months_seen")
    out = jsonl.export_view(view, {"theme": "theme_name"})
    path = scratch_path(spark, "export")
    jsonl.write_flat(out, path)
    return jsonl.read_flat(spark, path, out.schema)


@query("src_09", """SELECT i.f_id, i.text FROM v_identity i WHERE tache = 3 AND EXISTS (SELECT 1 FROM v_bank b WHERE b.f_id = i.f_id AND b.source % 10 = 3) AND theme IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')
    ORDER BY last_seen DESC, i.f_id DESC LIMIT 25""", "v_identity")
def export_for_labelling(spark, d):
    """Identities of some themes seen at a source, newest first, as many as asked for."""
    seen = v_bank(spark, d).filter("source % 10 = 3").select("f_id")
    rows = v_identity(spark, d).filter(F.col("tache") == 3).filter(F.col("theme").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
    return rows.join(seen, "f_id", "left_semi").orderBy(F.desc("last_seen"), F.desc("f_id")).limit(25).select("f_id", "text")


@query("src_10", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lpad(CAST(doc_id AS VARCHAR), 13, '0') END AS id FROM documents")
def numeric_ids(spark, d):
    """Ids damaged by a spreadsheet, repaired to thirteen digits."""
    at = F.col("doc_id")
    raw = F.when(at % 7 == 0, "nan").when(at % 2 == 0, F.concat(at.cast("string"), F.lit(".0"))).otherwise(at.cast("string"))
    return table(spark, d, "documents").select("doc_id", F.lpad(jsonl.numeric_id(raw), 13, "0").alias("id"))


@query("txt_01", f"SELECT doc_id, {sql_normalize('text')} AS normal FROM documents")
def normalize(spark, d):
    """The normal form of every text."""
    return T.composed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query("txt_02", f"SELECT doc_id, {sql_flatten('text')} AS flat FROM documents")
def flatten(spark, d):
    """Lower case without accents."""
    return table(spark, d, "documents").select("doc_id", T.flatten_accents(F.col("text")).alias("flat"))


@query("txt_03", "SELECT doc_id, fp FROM v_sightings", "v_sightings")
def fingerprints(spark, d):
    """The exact-duplicate key."""
    return v_sightings(spark, d).select("doc_id", "fp")


@query("txt_04", f"SELECT doc_id, len({TOK}) AS n, array_to_string({TOK}, ' ') AS words FROM documents")
def word_tokens(spark, d):
    """Accent-free words."""
    w = T.word_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


@query("txt_05", f"""WITH t AS (SELECT doc_id, {TOK} AS w FROM documents)
    SELECT doc_id, array_to_string(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), '|') AS grams FROM t""")
def ngrams(spark, d):
    """Words and word pairs of every text."""
    rows = table(spark, d, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.array_join(T.ngrams(F.col("w"), 2), "|").alias("grams"))


@query("txt_06", f"SELECT p_partkey, {sql_key('p_name')} AS k1, {sql_key(chr(39) + '  L’ß ' + chr(39) + ' || p_brand')} AS k2, replace(lower(trim(' ' || p_type || ' ')), 'ß', 'ss') AS k3 FROM part")
def label_keys(spark, d):
    """Both lookup forms of label names."""
    return table(spark, d, "part").select(
        "p_partkey", T.label_key(F.col("p_name")).alias("k1"), T.label_key(F.concat(F.lit("  L’ß "), "p_brand")).alias("k2"), T.answer_key(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("k3")
    )


@query("txt_07", """SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'), ' ') AS slug,
    CAST(CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 1 END AS INTEGER) AS month FROM documents""")
def slugs(spark, d):
    """Slugs of texts, and month numbers from spelled months."""
    k = F.col("doc_id") % 5
    month = F.when(k == 0, "Février").when(k == 1, "août").when(k == 2, "DÉC.").when(k == 3, "junvier").otherwise("someday")
    return table(spark, d, "documents").select("doc_id", T.deaccent_slug(F.col("text")).alias("slug"), T.month_number(month).alias("month"))


@query("txt_08", """SELECT doc_id, '03' || replace(period, '-', '') || tache || lpad(CAST(partie AS VARCHAR), 2, '0') || lpad(CAST(sujet AS VARCHAR), 2, '0') AS qid, period, tache, partie, sujet FROM v_sightings""", "v_sightings")
def ids(spark, d):
    """Ids composed and parsed back."""
    rows = v_sightings(spark, d)
    qid = T.compose_id(F.lit(3), F.col("period"), F.col("tache"), F.col("partie"), F.col("sujet"))
    return rows.select("doc_id", qid.alias("qid")).select("doc_id", "qid", T.parse_id(F.col("qid")).alias("p")).select("doc_id", "qid", "p.period", "p.tache", "p.partie", "p.sujet")


@query("txt_09", rf"SELECT doc_id, trim(regexp_replace('Thème : ' || replace(text, '→', ' : '), '{_WS}', ' ', 'g'), ' ') AS clean FROM documents")
def decoration(spark, d):
    """Leading marks and arrows removed."""
    return table(spark, d, "documents").select("doc_id", T.clean_decoration(F.concat(F.lit("→ • ★ Thème →"), F.col("text"))).alias("clean"))


@query("txt_10", """SELECT doc_id, 'Je suis ' || source AS role, CASE WHEN doc_id % 2 = 0 THEN 'Vous me demandez ' || lang || ' (prix, ' || source || ')' ELSE 'Vous voulez partir' END AS task,
    CASE WHEN doc_id % 2 = 0 THEN 'prix|' || source ELSE '' END AS hints, CASE WHEN doc_id % 3 = 0 THEN 'Il fait beau.' END AS situation FROM documents""")
def slots(spark, d):
    """Role, task, hints and situation of a prompt made of the row's fields."""
    at = F.col("doc_id")
    text = F.concat(F.lit("Je suis "), "source", F.lit(". "), F.when(at % 3 == 0, "Il fait beau. ").otherwise(""), F.when(at % 2 == 0, F.concat(F.lit("Vous me demandez "), "lang", F.lit(" (prix, "), "source", F.lit(")."))).otherwise("Vous voulez partir."))
    s = table(spark, d, "documents").select("doc_id", T.breakdown_slots(text).alias("s"))
    return s.select("doc_id", "s.role", "s.task", F.array_join("s.hints", "|").alias("hints"), "s.situation")


@query("txt_11")
def word_diffs(spark, d):
    """Word diffs between the texts of neighbouring turns; dynamic programming, tested against a plain one and by rebuilding both sides."""
    turns = table(spark, d, "conversations")
    rows = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    out = T.word_diff(rows.select("conv_id", "turn", "text", "next"), "text", "next")
    side = lambda op: F.array_join(F.transform(F.filter("diff", lambda x: x["op"].isin("=", op)), lambda x: x["tok"]), "")
    return out.select("conv_id", "turn", F.size(F.filter("diff", lambda x: x["op"] == "=")).alias("kept"), (side("-") == F.col("text")).alias("left_ok"), (side("+") == F.col("next")).alias("right_ok"))


@query("txt_12", "SELECT id, CAST(substr(period, 1, 4) AS INTEGER) AS year, CAST(substr(period, 6, 2) AS INTEGER) AS month FROM v_sightings WHERE starts_with(period, '2024-0')", "v_sightings")
def period_parts(spark, d):
    """Year and month of periods with a prefix."""
    return v_sightings(spark, d).filter(F.col("period").startswith("2024-0")).select("id", T.period_year(F.col("period")).alias("year"), T.period_month(F.col("period")).alias("month"))


@query("txt_13", "SELECT doc_id, substr(text, 1, 160) AS head, nullif(substr(trim(source), 1, 200), '') AS label FROM documents")
def snippets(spark, d):
    """Heads of texts and clipped labels."""
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), 160).alias("head"), T.clipped_label(F.col("source")).alias("label"))


@query("txt_14", "SELECT source, CAST(sum(length(text) // 3 + 8) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_estimates(spark, d):
    """Estimated tokens of each source."""
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
