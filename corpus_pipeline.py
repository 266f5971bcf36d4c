"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

Toxic documents go; recurring lines go; one document of each near-duplicate group stays; personal
data is replaced by its kind; what is left is packed into sequences of token ids.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table
(which gives an empty one); columns beside those of `documents` are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm import line_dedup, near_dedup, packing, pii, toxicity
from tallyloom.llm.common import documents
from tallyloom.operators.materialize import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7  #: score from which a document is rejected


def _same_columns(docs: DataFrame, text: Column, like: DataFrame) -> DataFrame:
    """`docs` with a new text and its length, in the columns of `like`."""
    new = docs.withColumn("text", text)
    if "n_chars" in like.columns:
        new = new.withColumn("n_chars", F.length("text").cast("long"))
    return new.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score TOXIC or more; null and empty texts stay. The model is learned from `documents` and `labels` of `sf_dir`."""
    scored = toxicity.score_toxicity(docs, toxicity.fitted(spark, sf_dir))
    return scored.filter(F.col("toxicity.score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines of recurring templates; every document stays.

    Documents that are copies of one other keep their lines: the next stage removes them whole.
    """
    return _same_columns(line_dedup.dedup_lines(docs, leave_copies=True), F.col("text"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates (five-word shingles, 0.8); texts without words and rows without id stay."""
    groups = near_dedup.near_duplicates(docs, words=5, num=80, den=100)
    gone = materialize(groups.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; null texts stay null."""
    found = pii.find_pii(docs, plain_words=True)
    spans = F.array_sort(F.concat(F.col("pii.base"), F.col("pii.extra")))
    return _same_columns(found, pii.redacted(F.col("text"), spans), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its token ids, and where they lie in which sequence. Null texts count as empty."""
    return packing.pack_pieces(packing.pieces_of(docs, with_ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: The learned grammar, the LSH forest and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
