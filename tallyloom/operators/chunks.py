"""Chunks of rows for batch inference, and their replies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.operators.materialize import materialize
from tallyloom.operators.numbering import numbered


def grouped_chunks(rows: DataFrame, size: int, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with chunk (from 1 in each group) and n (from 1 in each chunk); chunks never mix groups.

    Rows are numbered within ranges of group and order, which are written, and the ranges' counts
    are added up; so a group of any size is spread over tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))), "ranges")
    counts = placed.groupBy("_part", *group).agg(F.max("_rn").alias("_n"))
    before = counts.select("_part", *group, F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    keys = ["_part", *group]
    before = before.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_before")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rn = F.col("_before") + F.col("_rn")
    numbered = placed.join(before, same).select(*rows.columns, rn.alias("_rn"))
    return numbered.withColumns({"chunk": F.ceil(F.col("_rn") / size).cast("int"), "n": ((F.col("_rn") - 1) % size + 1).cast("int")}).drop("_rn")


BLOCK_ROWS = 50_000
FAN = 256  #: blocks that are walked in one task


def _next_starts(tokens: np.ndarray, max_rows: int, max_tokens: int) -> np.ndarray:
    """For a batch that starts at each row, where the next one starts; the last entry, behind all rows, is its own."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(len(tokens))
    fit = np.searchsorted(sums, sums[:-1] + max_tokens, "right") - 1
    return np.append(np.minimum(np.clip(fit, at + 1, at + max_rows), len(tokens)), len(tokens))


def _ways(max_rows: int, max_tokens: int):
    """For each row of a block at which the first batch may start: where, counted from the block's end, the next block's first one does, and how many start here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        n = int((~pdf["_ahead"]).sum())
        step = _next_starts(pdf["_t"].to_numpy(), max_rows, max_tokens)
        inside = np.arange(len(step)) < n
        to, count = np.where(inside, step, np.arange(len(step))), inside.astype(np.int64)
        while (to < n).any():
            count, to = count + count[to], to[to]
        entries = min(max_rows, n) + 1
        return pd.DataFrame({"block": [pdf["block"].iat[0]], "exits": [(to[:entries] - n).tolist()], "counts": [count[:entries].tolist()]})

    return run


def _entries(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """`(block, entry, before)`: where the first batch of each block starts, and how many do before it.

    `blocks` is `(block, exits, counts)`, numbered from 0. More than `fan` of them are first put
    together by `fan`, so no task walks along all.
    """
    blocks = materialize(blocks, "ways")
    groups = blocks.withColumn("group", F.floor(F.col("block") / fan))
    n = blocks.agg(F.max("block")).first()[0]
    if n is None or n < fan:
        begin = groups.select("group").distinct().select("group", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    else:

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            exits, counts = np.array(pdf["exits"].iat[0]), np.array(pdf["counts"].iat[0])
            for e, c in zip(pdf["exits"].iloc[1:], pdf["counts"].iloc[1:]):
                counts, exits = counts + np.array(c)[exits], np.array(e)[exits]
            return pd.DataFrame({"block": [pdf["group"].iat[0]], "exits": [exits.tolist()], "counts": [counts.tolist()]})

        begin = _entries(groups.groupBy("group").applyInPandas(together, "block long, exits array<int>, counts array<long>"), fan).withColumnRenamed("block", "group")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        entry, before, out = int(pdf["entry"].iat[0]), int(pdf["before"].iat[0]), []
        for block, exits, counts in zip(pdf["block"], pdf["exits"], pdf["counts"]):
            out.append((block, entry, before))
            entry, before = int(exits[entry]), before + int(counts[entry])
        return pd.DataFrame(out, columns=["block", "entry", "before"])

    return groups.join(begin, "group").groupBy("group").applyInPandas(walk, "block long, entry int, before long")


def budgeted_batches(rows: DataFrame, order: list[str], tokens: str, max_rows: int, max_tokens: int, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """`rows` with batch, from 0: greedy runs in `order` that stay under both limits; a row over the limit is alone.

    Where the next batch starts follows from where one starts, by sums of tokens. Rows are numbered
    in the order and cut into blocks that see as many rows ahead as a batch may have. In a block the pointers to the
    next start are doubled until they leave it, which tells for every possible first start how the
    next block is entered; along these the real starts are found, and each block marks its own. Null tokens count as 0.
    """
    size = max(block_rows, max_rows)
    t = F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_t")
    placed = materialize(numbered(rows, order, "_pos").select("*", t), "placed")
    here = F.floor(F.col("_pos") / size)
    homes = F.when((F.col("_pos") % size < max_rows) & (F.col("_pos") >= size), F.array(here, here - 1)).otherwise(F.array(here))
    spread = placed.withColumn("block", F.explode(homes)).withColumn("_ahead", F.col("block") < here)
    ways = spread.select("block", "_pos", "_ahead", "_t").groupBy("block").applyInPandas(_ways(max_rows, max_tokens), "block long, exits array<int>, counts array<long>")
    entries = materialize(_entries(ways, fan), "entries")
    columns = rows.columns

    def mark(block: pa.Table) -> pa.Table:
        block = block.sort_by("_pos")
        n = block.num_rows - int(np.asarray(block["_ahead"]).sum())
        step = _next_starts(np.asarray(block["_t"]), max_rows, max_tokens).tolist()
        at, starts = block["entry"][0].as_py(), np.zeros(n, np.int64)
        while at < n:
            starts[at] = 1
            at = step[at]
        batch = block["before"][0].as_py() - 1 + np.cumsum(starts)
        return block.slice(0, n).select(columns).append_column("batch", pa.array(batch, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return spread.join(entries, "block").groupBy("block").applyInArrow(mark, f"{fields}, batch long")


def numbered_body(rows: DataFrame, chunk: list[str], text_col: str) -> DataFrame:
    """The lines `n. text` of each chunk, in order."""
    lines = F.array_sort(F.collect_list(F.struct("n", F.col(text_col).alias("t"))))
    return rows.groupBy(*chunk).agg(lines.alias("ls")).select(*chunk, F.array_join(F.transform("ls", lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["t"])), "\n").alias("body"))


def align_replies(rows: DataFrame, replies: DataFrame, chunk: list[str], answer: str = "answer") -> DataFrame:
    """`rows` with the answers of accepted chunks.

    A reply is JSON `{"items": [{"n": .., answer: ..}]}`. It counts only if its numbers are exactly
    1 to the chunk's size; a number given twice is accepted and its last answer holds. Refused,
    malformed and misnumbered replies leave the chunk out.
    """
    parsed = replies.withColumn("_r", F.from_json("reply", f"items array<struct<n:int,{answer}:string>>"))
    items = parsed.select(*chunk, F.posexplode("_r.items").alias("_pos", "_x"))
    ok = items.groupBy(*chunk).agg(F.array_sort(F.collect_set("_x.n")).alias("_got"), F.count(F.when(F.col("_x.n").isNull() | F.col(f"_x.{answer}").isNull(), 1)).alias("_holes"))
    sizes = rows.groupBy(*chunk).agg(F.count("*").cast("int").alias("_k"))
    good = ok.join(sizes, chunk).filter((F.col("_holes") == 0) & (F.col("_got") == F.sequence(F.lit(1), F.col("_k")))).select(*chunk)
    last = items.groupBy(*chunk, F.col("_x.n").alias("n")).agg(F.max_by(f"_x.{answer}", "_pos").alias(answer))
    return rows.join(good, chunk, "left_semi").join(last, [*chunk, "n"])


def cost(chunks: DataFrame, price_per_million: float, discount: float = 1.0, text_col: str = "text") -> DataFrame:
    """One row: chunks, estimated input tokens, price."""
    from tallyloom.functions.text import token_estimate

    per = chunks.groupBy("tache", "chunk").agg(F.sum(token_estimate(F.col(text_col))).alias("t"))
    return per.agg(F.count("*").alias("chunks"), F.sum("t").alias("input_tokens"), F.round(F.sum("t") * price_per_million / 1e6 * discount, 6).alias("cost"))
