"""Best-fit packing of documents into sequences by swap-based local search (operator 7).

Documents are encoded and cut into pieces where they are. Pieces are dealt at random into groups of
bounded size, so any number of them packs in parallel; a group wastes one sequence at most. In a
group, pieces are first laid into bins as they come, each into the first bin of the last few that
has room. Local search does the packing: it takes the emptiest bin and moves its pieces into free
room elsewhere, best fit first, or exchanges them for one or two smaller pieces of a fuller bin.
Every such step makes the sum of squared fills larger, so the search ends: when no fewer bins are
possible, or when every underfull bin has had its turn and none was emptied.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.common import bounded_batches, documents
from tallyloom.operators.materialize import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END = 0  #: the id that ends every document
GROUP_PIECES = 4_000
OPEN_BINS = 50  #: of the first deal
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BATCH_CHARS = 2_000_000  #: encoded at once
REMEMBERED = 800_000  #: distinct pre-tokens


@lru_cache(2)
def tokenizer(path: str = TOKENIZER):
    """The tokenizer of a json file, as it is; one thread, since Spark has a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Encoder:
    """The tokenizer's ids of texts, as bytes of little-endian 32-bit numbers.

    Texts are cut at the file's special strings, then into pre-tokens; the tokenizer encodes each
    distinct one once, as long as it is remembered.
    """

    def __init__(self, path: str = TOKENIZER):
        import regex

        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        whole = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
        self.cut = regex.compile(f"{whole}|(?:(?!{whole}).)+" if special else ".+", regex.DOTALL)
        self.special = set(special)
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.encode = tokenizer(path).encode_batch_fast
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not any(x in text for x in self.special):
            return self.words(text)
        return [w for part in self.cut.findall(text) for w in ([part] if part in self.special else self.words(part))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, [self.pieces(t) for t in texts]
        new = list(set().union(*found).difference(known))
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, self.encode(new, add_special_tokens=False)))
        return [b"".join([known[w] for w in f]) for f in found]


@lru_cache(1)
def encoder(path: str = TOKENIZER) -> _Encoder:
    """One for all tasks of a worker process, so that they share what it remembers."""
    return _Encoder(path)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32[, ids])`: the documents' token ids, cut to the capacity.

    A document is its text's ids and then END; a null text counts as empty. Only documents longer
    than the capacity are cut; their first piece takes what is left over, all others are full. Null
    ids stay null, repeated rows each give their pieces, an empty table gives none, and other
    columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            out, blobs = [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // BATCH_CHARS, prepend=0)).tolist()
            found = [raw for x, y in zip([0, *cuts], [*cuts, len(texts)]) if x < y for raw in encode(texts[x:y])]
            for i, whole in zip(b.column(0).to_pylist(), found):
                whole += END.to_bytes(4, "little")
                n = len(whole) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                ends = [0, *range(first, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(ends, ends[1:])):
                    raw = whole[4 * x : 4 * y]
                    out.append((i, k, x, y - x, zlib.crc32(raw)))
                    if with_ids:
                        blobs.append(raw)
            cols = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *map(len, blobs)]) // 4
                ids = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))
                arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)], [*names, "ids"]
            yield pa.record_batch(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def first_deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece indexes: pieces as they come, each into the oldest of the last OPEN_BINS bins that has room."""
    bins: list[list[int]] = []
    open_: list[list[int]] = []  # room and bin
    for i, s in enumerate(sizes):
        for x in open_:
            if x[0] >= s:
                x[0] -= s
                bins[x[1]].append(i)
                break
        else:
            bins.append([i])
            open_.append([capacity - s, len(bins) - 1])
            if len(open_) > OPEN_BINS:
                open_.pop(0)
    return bins


class _Search:
    """Local search on bins: empties the emptiest one again and again. Pieces are numbered by size here, smallest first."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.order = np.argsort(np.array(sizes, np.int64), kind="stable")
        self.size = np.array(sizes, np.int64)[self.order]
        self.capacity = capacity
        given = np.empty(len(sizes), np.int64)
        for k, b in enumerate(bins):
            given[b] = k
        self.bin = given[self.order]
        self.bins: list[set[int]] = [set() for _ in bins]
        for p, k in enumerate(self.bin.tolist()):
            self.bins[k].add(p)
        self.narrow = np.int16 if len(bins) < 2**15 else np.int64  #: numpy sorts short numbers without comparing
        self.fill = np.bincount(self.bin, self.size, len(bins)).astype(np.int64)
        self.steps = {"move": 0, "one": 0, "two": 0}

    def put(self, piece: int, to: int) -> None:
        home = self.bin[piece]
        self.bins[home].discard(piece)
        self.bins[to].add(piece)
        self.fill[home] -= self.size[piece]
        self.fill[to] += self.size[piece]
        self.bin[piece] = to

    def improve(self, piece: int, home: int) -> bool:
        """One step that takes `piece` out of `home`; what comes back is smaller. False if there is none.

        Only bins at least as full take part, so whatever one of them gains makes the squares larger.
        No bin gains more than its room, so only the pieces of bins with room can be exchanged.
        """
        s = int(self.size[piece])
        room = np.where(self.fill >= self.fill[home], self.capacity - self.fill, 0)
        room[home] = 0
        fits = np.flatnonzero(room >= s)
        if len(fits):
            self.put(piece, int(fits[np.argmin(room[fits])]))
            self.steps["move"] += 1
            return True
        at = np.flatnonzero(room[self.bin] > 0)
        if not len(at):
            return False
        free = room[self.bin[at]]
        gain = s - self.size[at]
        gain[(gain > free) | (gain < 0)] = 0
        best = int(gain.argmax())
        if gain[best] > 0:
            other = int(at[best])
            to = int(self.bin[other])
            self.put(other, home)
            self.put(piece, to)
            self.steps["one"] += 1
            return True
        pair = self.best_pair(s, at, free)
        if pair is None:
            return False
        to = int(self.bin[pair[0]])
        for p in pair:
            self.put(p, home)
        self.put(piece, to)
        self.steps["two"] += 1
        return True

    def best_pair(self, s: int, at: np.ndarray, free: np.ndarray) -> tuple[int, int] | None:
        """Two pieces of one bin, among those `at`, whose exchange for one of size `s` gains most.

        To each piece belongs the smallest partner in its bin that leaves room enough if both go.
        """
        wide = 2 * self.capacity
        smaller = int(np.searchsorted(self.size[at], s))  # both must be smaller; pieces come by size
        at, free = at[:smaller], free[:smaller]
        if smaller < 2:
            return None
        order = np.argsort(self.bin[at].astype(self.narrow), kind="stable")
        at, free = at[order], free[order]
        size, bin_ = self.size[at], self.bin[at]
        key = bin_ * wide + size
        partner = np.searchsorted(key, bin_ * wide + np.maximum(s - free - size, 0))
        partner += partner == np.arange(len(at))
        found = partner < len(at)
        partner[~found] = 0
        gain = np.where(found & (bin_[partner] == bin_), s - size - size[partner], 0)
        best = int(gain.argmax())
        return (int(at[best]), int(at[partner[best]])) if gain[best] > 0 else None

    def run(self) -> None:
        """Until the number of bins can't be less, or a round in which each underfull bin had its turn has emptied none."""
        least = -(-int(self.size.sum()) // self.capacity)
        used, before = len(self.bins), len(self.bins) + 1
        while least < used < before:
            before, tried = used, np.zeros(len(self.bins), bool)
            while used > least:
                under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~tried)
                if not len(under):
                    break
                home, moved = int(under[np.argmin(self.fill[under])]), True
                tried[home] = True
                while moved and self.fill[home] > 0:
                    moved = any(self.improve(p, home) for p in sorted(self.bins[home], key=lambda p: (-self.size[p], p)))
                used -= self.fill[home] == 0


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each piece, numbered from 0 without gaps. Sizes lie in 1 to capacity."""
    return packed(sizes, capacity)[0]


def packed(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], dict[str, int]]:
    """pack(), and how many moves and exchanges the search made."""
    open_ = [i for i, s in enumerate(sizes) if s < capacity]
    part = [sizes[i] for i in open_]
    search = _Search(part, first_deal(part, capacity), capacity)
    search.run()
    names: dict[int, int] = {}
    out = [-1] * len(sizes)
    for i, b in zip(np.array(open_, np.int64)[search.order].tolist(), search.bin.tolist()):
        out[i] = names.setdefault(b, len(names))
    for i, s in enumerate(sizes):
        if s >= capacity:
            out[i] = len(names)
            names[-1 - i] = out[i]
    return out, search.steps


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset: which sequence each lies in and where, gapless from 0.

    `pieces` are those of pieces_of(); they are written once (by zstd, since token ids are most of them), with a random number by which they are
    dealt into groups, so repeated rows part and a repeated task reads the same numbers. Each group
    is packed by itself. Null ids stay null; an empty table gives no rows. Other columns stay, but
    sequence_id and offset are replaced, and columns named `_deal`, `_group` or `_bin` go.
    """
    pieces = pieces.drop("sequence_id", "offset", "_deal", "_group", "_bin")
    names = pieces.columns
    dealt = materialize(pieces.withColumn("_deal", F.xxhash64(F.lit(5), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces", compression="zstd")
    groups = max(1, -(-dealt.count() // group_pieces))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_deal", kind="stable").reset_index(drop=True)
        part["_bin"] = pack(part["length"].tolist(), capacity)
        part = part.sort_values("_bin", kind="stable")
        part["sequence_id"] = (int(key[0]) << 32) + part["_bin"]
        part["offset"] = part.groupby("_bin")["length"].cumsum() - part["length"]
        return part[[*names, "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    grouped = dealt.withColumn("_group", F.pmod("_deal", F.lit(groups))).groupBy("_group")
    return grouped.applyInPandas(lambda k, p: run(k, p.drop(columns="_group")), f"{schema}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 7: a row for each piece."""
    return pack_pieces(pieces_of(documents(spark, sf_dir)))
