"""Byte-level BPE encoding and decoding by a global distinct-word shuffle (operator 9).

1. Texts are cut into pre-tokens, in blocks of some megabytes of text. Exploded, every pre-token
   would be a row of its own, several times as large as the text; so a block is packed: every
   distinct pre-token has a code there, common ones the small codes, and the positions of all
   pre-tokens are the sequence of their codes, which waits at its block.
2. The distinct pre-tokens of all blocks are shuffled together by a hash, packed in one row for
   each block and hash bucket, and each is encoded once. What is shuffled grows with distinct
   words; a word of every second position is one word like any other. The number of buckets grows
   with the bytes of the input, so that each fits in memory.
3. The ids are joined back to their blocks and each block is reassembled by position.
4. Decoding joins the distinct ids of each batch with the token-byte table, which has the size of
   the vocabulary, and puts the bytes back by position.

Blocks are cut twice, once for their words and once for their positions, which costs less disk
than keeping one of them. A block is named by a hash of its contents; if a second reading gave
other blocks, names and counts wouldn't match and the job would fail.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyloom.llm.common import bounded_batches, documents
from tallyloom.operators.materialize import materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 32 << 20  #: of text, whose distinct words are a part of it
_BREAK = b"\xff"  #: between packed words; no UTF-8 text has this byte
ROW = "_block long, _bucket int, _codes binary, _words binary, _ids binary"


@lru_cache(2)
def encoding(path: str = RANKS):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low first, the high bit set on all but a number's last; and each number's length."""
    size = np.ones(len(x), np.int64)
    for bits in (7, 14, 21, 28):
        size += x >= (1 << bits)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[start[has] + k] = ((x[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def _from_varints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and at which byte each ends (exclusive)."""
    last = raw < 128
    end = np.flatnonzero(last) + 1
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    out = np.zeros(len(end), np.int64)
    size = end - start
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (raw[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out, end


class _Block:
    """Documents of one block: their ids, and their pre-tokens as codes, common ones small."""

    def __init__(self, ids: list, texts: list[str]):
        named = hashlib.blake2b(digest_size=8)
        for i, t in zip(ids, texts):
            named.update(f"{i}:{len(t)}:".encode() + t.encode("utf-8", "surrogatepass"))
        found: dict[str, int] = defaultdict()
        found.default_factory = found.__len__
        cut = _pattern().findall
        parts = [np.fromiter(map(found.__getitem__, p), np.int64, len(p)) for p in map(cut, texts)]
        self.number = int.from_bytes(named.digest(), "little", signed=True)
        self.ids, self.lengths = ids, np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        order = np.argsort(-np.bincount(flat, minlength=len(found)), kind="stable")
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        self.codes = rank[flat]
        spelled = list(found)
        self.words = [spelled[k].encode("utf-8", "surrogatepass") for k in order.tolist()]

    def word_rows(self, buckets: int) -> pa.RecordBatch:
        """A row for each bucket: the codes, delta-coded, and the words."""
        home = np.array([zlib.crc32(w) % buckets for w in self.words], np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        groups = np.split(order, cuts[1:]) if len(order) else []
        codes = [_varints(np.diff(g, prepend=0))[0].tobytes() for g in groups]
        words = [_BREAK.join([self.words[k] for k in g.tolist()]) for g in groups]
        n = len(groups)
        return pa.record_batch([pa.array([self.number] * n, pa.int64()), pa.array([int(home[g[0]]) for g in groups], pa.int32()), pa.array(codes, pa.binary()), pa.array(words, pa.binary()), pa.nulls(n, pa.binary())], _NAMES)

    def position_row(self, _: int) -> pa.RecordBatch:
        """One row, without bucket: ids and lengths of the documents behind the number of distinct words, and all codes in order."""
        head = np.stack([np.array([i is None for i in self.ids], np.int64), np.array([i or 0 for i in self.ids], np.int64), self.lengths])
        return pa.record_batch([pa.array([self.number], pa.int64()), pa.nulls(1, pa.int32()), pa.array([_varints(self.codes)[0].tobytes()]), pa.array([np.int64(len(self.words)).tobytes() + head.tobytes()]), pa.nulls(1, pa.binary())], _NAMES)


_NAMES = ["_block", "_bucket", "_codes", "_words", "_ids"]


def _cut(rows_of, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1]) + 64
                if size >= BLOCK_BYTES:
                    yield rows_of(_Block(ids, texts), buckets)
                    ids, texts, size = [], [], 0
        if ids:
            yield rows_of(_Block(ids, texts), buckets)
        pa.default_memory_pool().release_unused()  # the worker lives on and does other work

    return run


def _encode_bucket(table: pa.Table) -> pa.Table:
    """Encodes the distinct words of one bucket, each once, and gives every block's row its ids: sizes, then ids."""
    one, known, out = encoding()._encode_single_piece, {}, []
    for packed in table.column("_words").to_pylist():
        sizes, ids = [], []
        for w in packed.split(_BREAK):
            v = known.get(w)
            if v is None:
                v = known[w] = array("I", one(w)).tobytes()
            sizes.append(len(v) // 4)
            ids.append(v)
        raw, _ = _varints(np.array(sizes, np.int64))
        out.append(np.uint32(len(raw)).tobytes() + raw.tobytes() + _varints(np.frombuffer(b"".join(ids), "u4").astype(np.int64))[0].tobytes())
    n = len(out)
    pa.default_memory_pool().release_unused()
    return pa.table([table.column("_block"), table.column("_bucket"), table.column("_codes"), pa.nulls(n, pa.binary()), pa.array(out, pa.binary())], _NAMES)


def _reassemble(table: pa.Table) -> pa.Table:
    """The ids of one block's documents, by position; blocks of equal contents come together and are told apart by their rows."""
    codes, sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    heads, seen = [], set()
    for bucket, c, w, packed in zip(*(table.column(k).to_pylist() for k in _NAMES[1:])):
        numbers, _ = _from_varints(np.frombuffer(c, np.uint8))
        if bucket is None:
            heads.append((numbers, int(np.frombuffer(w[:8], np.int64)[0]), np.frombuffer(w[8:], np.int64).reshape(3, -1)))
        elif bucket not in seen:
            seen.add(bucket)
            at = 4 + int(np.frombuffer(packed[:4], np.uint32)[0])
            codes.append(np.cumsum(numbers))
            sizes.append(_from_varints(np.frombuffer(packed[4:at], np.uint8))[0])
            ids.append(_from_varints(np.frombuffer(packed[at:], np.uint8))[0])
    codes, sizes, ids = map(np.concatenate, (codes, sizes, ids))
    if not heads or any(n != len(codes) for _, n, _ in heads):
        raise ValueError("the input came in other partitions when it was read again; write it first")
    begin = np.empty(len(codes), np.int64)
    begin[codes] = np.cumsum(sizes) - sizes
    count = np.empty(len(codes), np.int64)
    count[codes] = sizes
    out = []
    for seq, _, (null, doc_ids, lengths) in heads:
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        per = count[seq]
        ends = np.concatenate([[0], np.cumsum(per)])
        place = np.repeat(begin[seq] - ends[:-1], per)
        place += np.arange(ends[-1])
        flat = ids[place].astype(np.int32)
        del place
        doc = pa.array(doc_ids, pa.int64(), mask=null.astype(bool))
        out.append(pa.table([doc, pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(flat))], ["doc_id", "ids"]))
    return pa.concat_tables(out)


@lru_cache(1)
def token_bytes(path: str = RANKS) -> list[bytes]:
    """The token-byte table: bytes by id."""
    with open(path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    out = [b""] * (max(i for i, _ in pairs) + 1)
    for i, t in pairs:
        out[i] = t
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """`(doc_id, ids)`: each text's token ids.

    `docs` is read several times and must come in the same partitions each time. A table of files
    does; say so by `written`, or else it is written first. A null text counts as empty: no ids.
    Null ids stay null; repeated rows each give a row; an empty table gives none. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows if written else materialize(rows, "texts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    words = rows.mapInArrow(_cut(_Block.word_rows, buckets), ROW).groupBy("_bucket").applyInArrow(_encode_bucket, ROW)
    positions = rows.mapInArrow(_cut(_Block.position_row, buckets), ROW)
    return words.unionByName(positions).groupBy("_block").applyInArrow(_reassemble, "doc_id long, ids array<int>")


def token_table(spark: SparkSession, path: str = RANKS) -> DataFrame:
    """The token-byte table `(_token, _bytes)`: a row for each id of the vocabulary, whatever the size of the corpus."""
    spelled = token_bytes(path)
    return spark.createDataFrame(pa.table({"_token": pa.array(np.arange(len(spelled), dtype=np.int32)), "_bytes": pa.array(spelled, pa.binary())}))


ASKED = ["_block", "_distinct", "_id", "_rows"]


def _ask(at: int):
    """For each batch a row with the batch itself and the number of its distinct ids, then a row for each of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(at).flatten()
            if flat.null_count:
                raise ValueError("a token id is null")
            distinct = np.flatnonzero(np.bincount(flat.to_numpy(zero_copy_only=False)))
            n, name = len(distinct), int.from_bytes(os.urandom(8), "little", signed=True)
            whole = pa.BufferOutputStream()
            with pa.ipc.new_stream(whole, b.schema) as out:
                out.write_batch(b)
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([n], pa.int32()), pa.nulls(1, pa.int32()), pa.array([whole.getvalue().to_pybytes()], pa.binary())], ASKED)
            yield pa.record_batch([pa.array(np.full(n, name, np.int64)), pa.nulls(n, pa.int32()), pa.array(distinct.astype(np.int32)), pa.nulls(n, pa.binary())], ASKED)

    return run


def _spelled(ids: pa.ListArray, known: np.ndarray, spelled: pa.Array) -> pa.Array:
    """The bytes of each list of ids, by the joined rows `(known, spelled)`: the bytes of all ids lie in order, cut where lists end."""
    place = np.zeros(int(known.max(initial=-1)) + 1, np.int64)
    place[known] = np.arange(len(known))
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    found = spelled.cast(pa.large_binary()).take(pa.array(place[flat] if len(flat) else np.empty(0, np.int64)))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False))]).astype(np.int64)
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    cuts = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), found.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _answer(at: int):
    """Batches put together again once all their ids have come back with bytes, in whatever order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for b in batches:
            names = b.column(0).to_numpy()
            heads = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(names, prepend=names[:1]) | heads | np.append(False, heads[:-1]))
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                if i == j:
                    continue
                rows, held = b.slice(i, j - i), waiting.setdefault(int(names[i]), [None, b"", 0, [], []])
                if heads[i]:
                    held[0], held[1] = rows.column(1)[0].as_py(), rows.column(3)[0].as_py()
                else:
                    if rows.column(4).null_count:
                        raise ValueError("a token id is out of bounds of the token-byte table")
                    held[2] += len(rows)
                    held[3].append(rows.column(2).to_numpy())
                    held[4].append(rows.column(4))
                if held[0] != held[2]:
                    continue
                del waiting[int(names[i])]
                whole = pa.ipc.open_stream(held[1]).read_next_batch()
                known = np.concatenate([np.empty(0, np.int32), *held[3]])
                spelled = pa.concat_arrays(held[4]) if held[4] else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([*whole.columns, _spelled(whole.column(at), known, spelled)], [*whole.schema.names, "decoded"])
        if waiting:
            raise ValueError("token ids of a batch were moved to another partition")

    return run


def decode(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded`: the bytes of its token ids, null for null; ids outside the table are an error.

    A batch asks for each of its distinct ids once; these rows are joined with the token-byte table,
    which has the size of the vocabulary and so is the broadcast side, and put back by position. The
    batch travels beside its ids in the same partition: nothing is shuffled. A very long list is one
    row of a batch like any other, an empty one gives no bytes. Other columns stay; `decoded` is replaced.
    """
    encoded = encoded.drop("decoded")
    spark, at = encoded.sparkSession, encoded.columns.index(ids_col)
    bounded_batches(spark)
    asked = encoded.mapInArrow(_ask(at), "_block long, _distinct int, _id int, _rows binary")
    joined = asked.join(F.broadcast(token_table(spark)), F.col("_id") == F.col("_token"), "left").select(*ASKED, "_bytes")
    return joined.mapInArrow(_answer(at), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """`(doc_id, ids, decoded)`: encode(), and what decode() makes of it."""
    return decode(encode(docs, id_col, text_col, written))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 9."""
    out = round_trip(documents(spark, sf_dir), written=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
