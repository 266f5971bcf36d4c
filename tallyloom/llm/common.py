"""What the numbered operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.operators.batches import bounded_batches  # noqa: F401
from tallyloom.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def training_rows(docs: DataFrame, marks: DataFrame, label: str, in_fold: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(text, label)` of at most `bound` labelled documents, chosen by a hash of the id.

    `marks` has `id_col` and `label`; only ids for which `in_fold` holds are used. A document that
    is labelled twice counts once, with its larger label. The ids are the broadcast side: there are
    at most `bound` of them, whatever the size of `marks`.
    """
    marks = marks.select(id_col, F.col(label).cast("int").alias("label")).dropna().filter(in_fold)
    marks = marks.groupBy(id_col).agg(F.max("label").alias("label"))
    share = min(1.0, 0.9 * bound / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else marks
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(marks.limit(bound)), id_col).select(F.coalesce("text", F.lit("")).alias("text"), "label")


def join_hot_keys_apart(rows: DataFrame, known: DataFrame, on: list[str], n_rows: int) -> DataFrame:
    """`rows` inner-joined with `known`, which has each key once and `_n`, the number of its rows in `rows`.

    Keys of more than a thousandth of all `n_rows` rows are at most a thousand: they are broadcast,
    and their rows don't move. The rest is joined by shuffle, in which no key is large.
    """
    hot = F.col("_n") * 1000 > n_rows
    large = F.broadcast(known.filter(hot).drop("_n"))
    small = known.filter(~hot).drop("_n")
    return rows.join(large, on).unionByName(rows.join(large.select(*on), on, "left_anti").join(small, on))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often a lambda in the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(numbers: Column, start: Column) -> Column:
    """Sums before each number, from `start` on; the array grows by copying, so it must be short."""
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(numbers, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]


def sums_before(numbers: Column, levels: int = 3, width: int = 32) -> Column:
    """For an array of ints, the sum of all before each, in time that grows with its length.

    The array is cut into pieces of `width`, whose sums are summed up in the same way first.
    """
    if not levels:
        return _running(numbers, F.lit(0))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / width).cast("int")), lambda i: F.slice(xs, i * width + 1, width))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    whole = lambda xs: let(cut(xs), lambda pieces: F.flatten(F.zip_with(pieces, sums_before(F.transform(pieces, total), levels - 1, width), _running)))
    return let(numbers, lambda xs: F.when(F.size(xs) <= width, _running(xs, F.lit(0))).otherwise(whole(xs)))


def small_or_shuffled(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table as the broadcast side of a join if it has at most `rows` rows, else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """`rows` without most of those whose `key`, a hash, isn't among `keys`; a few of them stay, none of the others goes.

    A bitmap of fixed size says which remainders of keys exist; it has `bits` / 64 rows at most,
    whatever the number of keys, so it is broadcast and only rows that may match move to a join.
    """
    slot = F.pmod(F.xxhash64(F.lit(99), key), F.lit(bits))
    word, bit = F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(63).cast("int")
    marks = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    held = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(marks), "_word")
    return held.filter(F.expr("shiftright(_bits, _bit) & 1L") == 1).select(*rows.columns)
