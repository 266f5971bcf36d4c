"""Operator 7 against the tokenizer as it is, plain recounts and bounds."""

import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from odd import ROWS
from pyspark.sql import functions as F
from tests_data import SF, SF01
from tokenizers import Tokenizer

from tallyloom.llm import packing as K


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def plain_pieces(ids):
    ids = [*ids, 0]
    first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
    cuts = [0, *range(first, len(ids) + 1, 2048)]
    return [(k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]


def laid_out(got):
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["length"].sum() <= 2048 and part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]]


def test_the_special_string(plain):
    texts = ["end<|endoftext|>start", "<|endoftext|><|endoftext|> x", "<|endoftext|", "", "".join(map(chr, [*range(1, 0x3000, 3), 0x85, 0x1C, 0x2028, 0x1F600]))]
    found = [np.frombuffer(raw, "<u4").tolist() for raw in K._Encoder()(texts)]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts] and found[0] == [437, 50256, 9688]


def test_pieces_and_sequences(spark, plain):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rows = [*texts.items(), *[(10**6 + n, t) for n, (_, t) in enumerate(ROWS) if t and len(t) < 100_000]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = K.pack_pieces(K.pieces_of(docs, with_ids=True)).toPandas()
    for doc, part in got.sort_values("piece").groupby("doc_id"):
        want = plain.encode(dict(rows)[doc], add_special_tokens=False).ids
        assert list(zip(part["piece"], part["start"], part["length"], part["ids_crc32"])) == plain_pieces(want)
        assert [i for x in part["ids"] for i in x] == [*want, 0]
    laid_out(got)
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 2


def test_query(spark, plain):
    got = K.op7_packing(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = [(d, *p) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall() for p in plain_pieces(plain.encode(t or "", add_special_tokens=False).ids)]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    laid_out(got)


def test_repeated_rows_part(spark):
    docs = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a few words of text").alias("text"))
    got = K.pack_pieces(K.pieces_of(docs), group_pieces=500).toPandas()
    groups = (got["sequence_id"] // 2**32).value_counts()
    assert len(got) == 3_000 and len(groups) == 6 and groups.max() < 650
    laid_out(got)


def test_columns_of_pack_pieces(spark):
    """Columns that clash with its own go or are replaced, others stay; null ids stay null, an empty table stays empty."""
    pieces = spark.range(40).selectExpr("if(id = 7, null, id) AS doc_id", "0 AS piece", "0L AS start", "100 + id * 10 AS length", "id AS ids_crc32")
    more = pieces.selectExpr("*", "'x' AS _deal", "'y' AS _group", "'z' AS _bin", "'a' AS sequence_id", "'b' AS offset", "concat('own', ids_crc32) AS mine")
    out = K.pack_pieces(more)
    assert out.columns == [*pieces.columns, "mine", "sequence_id", "offset"]
    got = out.toPandas()
    laid_out(got)
    assert sorted(got["ids_crc32"]) == list(range(40)) and got.loc[got["doc_id"].isna(), "ids_crc32"].tolist() == [7]
    assert all(m == f"own{c}" for m, c in zip(got["mine"], got["ids_crc32"]))
    assert K.pack_pieces(more.filter("piece = 1")).collect() == []


def test_search_packs_real_groups(spark):
    """From a deal as rows come, the search reaches the least number of bins or one more, by all three steps."""
    lengths = [r.length for r in K.pieces_of(spark.read.parquet(f"{SF01}/documents.parquet")).collect()]
    bins, steps = K.packed(lengths)
    dealt = len(K.first_deal([x for x in lengths if x < 2048], 2048)) + sum(x >= 2048 for x in lengths)
    assert all(steps.values()) and dealt > max(bins) + 1
    assert max(bins) + 1 <= -(-sum(lengths) // 2048) + 1


def plain_best_pair(search, s, home):
    best = 0
    for k, b in enumerate(search.bins):
        room = search.capacity - search.fill[k]
        if k != home and search.fill[k] >= search.fill[home] and room > 0:
            for p in b:
                for q in b:
                    more = s - search.size[p] - search.size[q]
                    if p < q and best < more <= room:
                        best = more
    return best


def test_search_on_small_bins():
    rng = np.random.default_rng(8)
    pairs = 0
    for _ in range(60):
        sizes = rng.integers(1, 60, 80).tolist()
        search = K._Search(sizes, K.first_deal(sizes, 100), 100)
        home = int(search.fill.argmin())
        for p in search.bins[home]:
            s = int(search.size[p])
            room = np.where(search.fill >= search.fill[home], 100 - search.fill, 0)
            room[home] = 0
            at = np.flatnonzero(room[search.bin] > 0)
            pair = search.best_pair(s, at, room[search.bin[at]])
            assert (s - search.size[pair[0]] - search.size[pair[1]] if pair else 0) == plain_best_pair(search, s, home)
            pairs += pair is not None
        squares = (search.fill**2).sum()
        search.run()
        assert (search.fill == np.bincount(search.bin, search.size, len(search.fill))).all() and search.fill.max() <= 100 and (search.fill**2).sum() >= squares
        assert (search.fill > 0).sum() <= -(-sum(sizes) // 100) + 1
    assert pairs


def test_pieces_that_never_share_a_bin():
    assert sorted(K.pack([60] * 500, 100)) == list(range(500)) and sorted(K.pack([100] * 5, 100)) == list(range(5)) and K.pack([], 100) == []


def test_pieces_are_written_small(spark):
    """Token ids are most of what the pipeline writes here, and plain numbers of four bytes under the session's compression."""
    from tallyloom.llm import packing

    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    out = packing.pack_pieces(packing.pieces_of(docs, with_ids=True))
    assert out.count() == 2
    assert out.inputFiles() and all(".zstd." in f for f in out.inputFiles())
