"""Reading, harmonising and writing JSON lines and flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.materialize import materialize

# Fields that any of the file layouts may have; those absent are null.
SIGHTING = "id string, text string, task string, tache string, year int, month string, month_slug string, period string, partie int, sujet int, source string, source_url string, theme string, abstract string"


def scan_jsonl(spark: SparkSession, paths: str | list[str], schema: str = SIGHTING, strict: bool = False) -> DataFrame:
    """Rows of JSON-lines files. Blank lines are skipped. A bad line becomes a row with `_corrupt`, or with strict an error."""
    kind = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    schema = schema if strict else f"{schema}, _corrupt string"
    return spark.read.schema(schema).options(**kind).json(paths).withColumn("_file", F.col("_metadata.file_path"))


def harmonise(df: DataFrame) -> DataFrame:
    """task from task, tache or `unknown`; month `YYYY-MM` from year and month, else slug, else month, else empty."""
    number = F.col("month").try_cast("int")
    month = F.when(F.col("year").isNotNull() & number.isNotNull(), F.format_string("%04d-%02d", F.col("year"), number))
    return df.withColumns({"task": F.coalesce("task", "tache", F.lit("unknown")), "month": F.coalesce(month, "month_slug", "month", F.lit(""))})


def select_sources(df: DataFrame, stems: list[str], file_col: str = "_file") -> DataFrame:
    """Rows of files whose name without folder and ending is one of `stems`."""
    return df.filter(F.regexp_extract(file_col, r"([^/]+?)(\.[^./]*)?$", 1).isin(stems))


def with_reason(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """`df` with `reason`: the first of `reasons` whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(reasons.items()):
        out = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def validity_split(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and how many were dropped for each reason."""
    told = with_reason(df, reasons)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def merge_by_id(df: DataFrame, id_col: str, fields: list[str], order: list[str]) -> DataFrame:
    """One row for each id; of every field the last value in `order` that isn't null or empty."""
    at = F.struct(*order)
    pick = [F.max_by(f, F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", at)).alias(f) for f in fields]
    return df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*pick, F.min(at).alias("_first"))


def answer_column(columns: list[str]) -> str:
    """The one column of a label file that holds the answer; an error if it isn't clear."""
    left = [c for c in columns if c not in ("id", "model")]
    if len(left) > 1:
        left = [c for c in left if c not in ("text", "note", "confidence")]
    if len(left) != 1:
        raise ValueError(f"one answer column expected, found {left}")
    return left[0]


def long_labels(df: DataFrame, run: str) -> DataFrame:
    """`(run, id, field, value)` of a wide label file."""
    field = answer_column(df.columns)
    return df.select(F.lit(run).alias("run"), F.col("id").cast("string").alias("id"), F.lit(field).alias("field"), F.col(field).cast("string").alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """Write JSON lines; with `order`, files and the rows in them follow it."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.json(path)


def jsonl_round_trip(df: DataFrame) -> DataFrame:
    """`df` as it comes back from JSON text; used to check that nothing is lost."""
    text = materialize(df.select(F.to_json(F.struct(*df.columns)).alias("line")), "jsonl")
    return text.select(F.from_json("line", df.schema).alias("r")).select("r.*")


def numeric_id(c: Column) -> Column:
    """Ids that went through a spreadsheet: whole floats lose their fraction, NaN is null, text stays."""
    return F.when(c.rlike(r"^[0-9]+\.0+$"), F.regexp_extract(c, r"^([0-9]+)", 1)).when(F.lower(c).isin("nan", ""), None).otherwise(c)


def export_view(view: DataFrame, labels_as: dict[str, str] | None = None) -> DataFrame:
    """A flat, ordered export: hashes cut to twelve characters, most months first, then newest id."""
    out = view.withColumn("fingerprint", F.substring("fingerprint", 1, 12))
    for a, b in (labels_as or {}).items():
        out = out.withColumnRenamed(a, b)
    return out.orderBy(F.col("months_seen").desc(), F.col("f_id").desc())


def write_flat(view: DataFrame, path: str) -> None:
    """An ordered view as CSV files with a header, in its order. Nulls are empty fields, empty strings are quoted, quotes are doubled."""
    view.write.option("header", True).option("escape", '"').option("escapeQuotes", True).csv(path)


def read_flat(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What `write_flat` wrote; fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)
