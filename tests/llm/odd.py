"""Rows that every operator must take: nulls, empty, blank, very long and repeated texts, ties, clashing columns."""

from pyspark.sql import functions as F

LONG = "word another Word 12 " * 20_000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five."), (5, "One two three four five."), (5, "One two three four five."), (None, "no id here"), (None, None),
    (6, LONG), (7, LONG + "end"), (8, "é😀 ñ\nß x\r\n\x0b!"), (9, "a" * 300_000), (10, "Mail me@x.org or +1 (456) 555-2186, 10.0.0.1, 4111 1111 1111 1111"), (11, "7 " * 9_000), (11, "other text of the same id"),
    (12, "<|endoftext|> ​ don't we'll \x00 zero"),
]
EXTRA = ["id", "th", "kept", "score", "shard", "slot", "base", "pos", "line", "value", "start", "_drop", "_bucket", "_base", "component_id", "length", "words", "label"]


def table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(f"own {c}") for i, c in enumerate(EXTRA)})


def nothing(spark):
    return table(spark).filter("doc_id = -1")


def key(row):
    return (row.doc_id is None, row.doc_id or 0, row.text or "")
