"""Where plan modules put their queries, and the views that queries and SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import text as T
from tallyloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a query; `views` names the SQL views its SQL reads, in order."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql_with(views, sql)
        return f

    return put


def _accents() -> str:
    a, b = T.accent_table()
    return f"'{a}', '{b}'"


def _marks() -> str:
    """The combining marks as a class of a regular expression."""
    points = [ord(c) for c in T.combining_marks()]
    heads = [n for i, n in enumerate(points) if not i or points[i - 1] != n - 1]
    ends = [n for i, n in enumerate(points) if i + 1 == len(points) or points[i + 1] != n + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(heads, ends)) + "]"


_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def sql_normalize(x: str) -> str:
    x = f"regexp_replace(translate({x}, '’ʼ`«»“”–—', '''''''\"\"\"\"--'), '…', '...', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '{_WS}', ' ', 'g'), ' +([?!:;])', '\1', 'g')"
    x = rf"trim(regexp_replace({x}, '^\s*(question|sujet)\s*[0-9]*\s*[:.\-]\s*', '', 'i'), ' ')"
    return f"trim(trim({x}, '\"'''), ' ')"


def sql_flatten(x: str) -> str:
    return rf"regexp_replace(translate(lower({sql_normalize(x)}), {_accents()}), '{_marks()}', '', 'g')"


def sql_fingerprint(x: str) -> str:
    return f"sha256(regexp_replace({sql_flatten(x)}, '[^a-z0-9 ]', '', 'g'))"


def sql_key(x: str) -> str:
    return f"replace(lower(trim(regexp_replace(replace({x}, '’', ''''), '{_WS}', ' ', 'g'), ' ')), 'ß', 'ss')"


VIEWS = {
    "v_sightings": f"""SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 13, '0') AS id, CASE WHEN lang = 'en' THEN 2 ELSE 3 END AS tache,
      '2024-' || lpad(CAST(doc_id % 6 + 1 AS VARCHAR), 2, '0') AS period, CAST(doc_id % 9 + 1 AS INTEGER) AS partie, CAST(doc_id % 5 + 1 AS INTEGER) AS sujet,
      source, text, {sql_fingerprint('text')} AS fp FROM documents""",
    "v_bank": """SELECT l_partkey AS f_id, l_orderkey || '-' || l_linenumber AS raw_id, strftime(l_shipdate, '%Y-%m') AS period, CAST(2 + l_partkey % 2 AS INTEGER) AS tache,
      p_brand AS theme, p_type AS core_subject, p_name AS text, l_suppkey AS source FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "v_identity": """SELECT f_id, tache, theme, core_subject, text, min(period) AS first_seen, max(period) AS last_seen, count(*) AS total_sightings, count(DISTINCT period) AS months_seen
      FROM v_bank GROUP BY f_id, tache, theme, core_subject, text""",
    "v_list": "SELECT tache, period, f_id, count(*) AS month_sightings, max(raw_id) AS representative_raw_id FROM v_bank GROUP BY tache, period, f_id",
    "v_runs": """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 2 ELSE 3 END AS tache, source AS theme, text, CAST(quality AS VARCHAR) AS gold, CAST(1 - toxic AS VARCHAR) AS a,
      CASE WHEN n_chars >= 2000 THEN '1' ELSE '0' END AS b, (doc_id % 100) / 100.0 AS confidence FROM labels JOIN documents USING (doc_id)""",
    "v_vectors": "SELECT vec_id AS f_id, label AS core_subject, label // 4 AS theme, embedding FROM embeddings",
    "v_flags": """SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS f_id,
      CASE WHEN event_type IN ('view', 'error') THEN 'practiced' ELSE 'bookmarked' END AS flag, event_type IN ('view', 'click') AS is_on FROM events WHERE event_type <> 'purchase'""",
    "v_vocab": "SELECT DISTINCT p_brand AS theme, p_type AS core_subject FROM part",
}


def sql_with(views: str, body: str) -> str:
    """`body` with the views it names as leading WITH terms."""
    names = views.split()
    if "v_identity" in names or "v_list" in names:
        names = [*dict.fromkeys(["v_bank", *names])]
    terms = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{terms}{', ' if terms else ''}{body[len(head):]}"
    return f"WITH {terms} {body}" if terms else body


def v_sightings(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        F.lpad(at.cast("string"), 13, "0").alias("id"),
        F.when(F.col("lang") == "en", 2).otherwise(3).alias("tache"),
        F.concat(F.lit("2024-"), F.lpad((at % 6 + 1).cast("string"), 2, "0")).alias("period"),
        (at % 9 + 1).cast("int").alias("partie"),
        (at % 5 + 1).cast("int").alias("sujet"),
        "source",
        "text",
        T.fingerprint(F.col("text")).alias("fp"),
    )


def v_bank(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_partkey").alias("f_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("raw_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period"),
        (2 + F.col("l_partkey") % 2).cast("int").alias("tache"),
        F.col("p_brand").alias("theme"),
        F.col("p_type").alias("core_subject"),
        F.col("p_name").alias("text"),
        F.col("l_suppkey").alias("source"),
    )


BANK_ROWS = 250_000  #: rows of a part of spread_bank


def spread_bank(spark: SparkSession, d: str) -> DataFrame:
    """v_bank in parts by f_id whose number grows with the rows: small keys, as bytes, would let a few tasks group them all."""
    n = table(spark, d, "lineitem").count()
    return v_bank(spark, d).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BANK_ROWS)), "f_id")


def v_identity(spark: SparkSession, d: str, bank: DataFrame | None = None) -> DataFrame:
    return (v_bank(spark, d) if bank is None else bank).groupBy("f_id", "tache", "theme", "core_subject", "text").agg(
        F.min("period").alias("first_seen"), F.max("period").alias("last_seen"), F.count("*").alias("total_sightings"), F.countDistinct("period").alias("months_seen")
    )


def v_list(spark: SparkSession, d: str, bank: DataFrame | None = None) -> DataFrame:
    return (v_bank(spark, d) if bank is None else bank).groupBy("tache", "period", "f_id").agg(F.count("*").alias("month_sightings"), F.max("raw_id").alias("representative_raw_id"))


def v_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "en", 2).otherwise(3).alias("tache"),
        F.col("source").alias("theme"),
        "text",
        F.col("quality").cast("string").alias("gold"),
        (1 - F.col("toxic")).cast("string").alias("a"),
        F.when(F.col("n_chars") >= 2000, "1").otherwise("0").alias("b"),
        ((F.col("doc_id") % 100) / 100.0).alias("confidence"),
    )


def v_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("f_id"), F.col("label").alias("core_subject"), F.floor(F.col("label") / 4).cast("int").alias("theme"), "embedding")


def v_flags(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").filter(kind != "purchase").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("f_id"),
        F.when(kind.isin("view", "error"), "practiced").otherwise("bookmarked").alias("flag"), kind.isin("view", "click").alias("is_on"),
    )


def v_vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("theme"), F.col("p_type").alias("core_subject")).distinct()
