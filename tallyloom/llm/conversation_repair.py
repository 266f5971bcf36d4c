"""Conversations repaired by the cheapest edits, least audit first (operator 12).

A conversation's rows, in order, are letters of an automaton that takes `(s?(ua)+)?`. Keeping,
rerolling, deleting and inserting rows are arcs between nodes (rows consumed, automaton state); a
dynamic programme from the end gives every node its cost to go, and the arcs that lie on cheapest
paths stay. Prefix doubling ranks the nodes: by their first edit, then by their first 2, 4, 8, ...
edits, as pairs of the ranks of half as many; with the ranks pointers double, and they read off
the least of the cheapest paths.

Rows are dealt by ranges of conversation and order, so one conversation may cover many tasks. What
lies whole within a task is repaired there. The rest is cut into blocks of bounded size. A block
sums up as a 4 x 4 matrix of costs from state to state, a chain of such matrices gives each block
the costs at its end, the ranked paths through a block sum up as a map of states, and the chain of
maps gives each block the state in which it begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.common import bounded_batches
from tallyloom.operators.materialize import materialize
from tallyloom.sources.tables import table

BLOCK_ROWS = 4096  #: rows of a block, at most
BLOCK_BYTES = 8_000_000  #: of text in a block, beyond which it ends
FAN = 512  #: blocks of a chain that are walked in one task; longer chains are summed up first

# Fixed values of the contract.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = ["", "system", "user", "assistant"]
LABELS = "DIKR"  #: in ASCII order

START, S, U, A = range(4)
NEXT = np.array([U, U, A, U])  #: the state behind an inserted or rerolled row
KEPT = np.array([[-1, S, U, -1], [-1, -1, U, -1], [-1, -1, -1, A], [-1, -1, U, -1]])  #: by state and letter
FAR = 1 << 60  #: no way
FINAL = np.array([0, 2 * INSERT, INSERT, 0])  #: costs behind the last row


def damage(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` after the damage that the crc32 of `conv_id:turn` decides; nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return rows.drop("_copy")


def _costs(first: np.ndarray, letter: np.ndarray, must: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The cost to go from every (row, state), and behind the last row of each sequence.

    Sequence c has rows first[c] to first[c + 1]; its costs lie from first[c] + c on and end with end[c].
    """
    n = np.diff(first)
    v = np.empty((first[-1] + len(n), 4), np.int64)
    by_length = np.argsort(-n, kind="stable")
    last = (first[1:] + np.arange(len(n)))[by_length]
    v[last] = end[by_length]
    lengths = -n[by_length]
    for back in range(1, int(n.max(initial=0)) + 1):
        at = last[: np.searchsorted(lengths, -back, "right")] - back
        row = at - by_length[: len(at)]
        v[at] = _step(v[at + 1], letter[row], must[row], cut[row]).min(axis=0)
        _insert(v, at)
    return v


def _step(after: np.ndarray, letter: np.ndarray, must: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Costs of delete, keep and rerole in every state, if `after` are the costs behind the row."""
    extra = np.where(must, FAR, TRUNCATED * cut)[:, None]
    to = KEPT.T[letter]
    keep = np.where(to < 0, FAR, extra + np.take_along_axis(after, np.maximum(to, 0), 1))
    return np.minimum(np.stack([DELETE + after, keep, REROLE + extra + after[:, NEXT]]), FAR)


def _insert(v: np.ndarray, at: np.ndarray) -> None:
    u, a = v[at, U], v[at, A]
    v[at, U], v[at, A] = np.minimum(u, INSERT + a), np.minimum(a, INSERT + u)
    for state in (START, S):
        v[at, state] = np.minimum(v[at, state], INSERT + v[at, U])


def _optimal_arcs(v: np.ndarray, first: np.ndarray, letter: np.ndarray, must: np.ndarray, cut: np.ndarray, ends_here: np.ndarray) -> np.ndarray:
    """For each label and node the node behind its arc if that lies on a cheapest path, else -1. Node 4 * layer + state."""
    layers = len(v)
    final = first[1:] + np.arange(len(first) - 1)
    inner = np.setdiff1d(np.arange(layers), final, assume_unique=True)
    to = np.full((4, layers, 4), -1)
    states = np.arange(4)
    step = _step(v[inner + 1], letter, must, cut)
    kept = KEPT.T[letter]
    for label, cost, state in ((0, step[0], np.broadcast_to(states, kept.shape)), (2, step[1], kept), (3, step[2], np.broadcast_to(NEXT, kept.shape))):
        to[label, inner] = np.where((cost == v[inner]) & (cost < FAR), 4 * (inner + 1)[:, None] + state, -1)
    open_end = np.concatenate([inner, final[ends_here]])
    inserts = INSERT + v[open_end][:, NEXT]
    to[1, open_end] = np.where((inserts == v[open_end]) & (inserts < FAR), 4 * open_end[:, None] + NEXT, -1)
    return to.reshape(4, -1)


def _ranked(to: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The label of each node's least arc (4 at the end of a path), and the pointers over 1, 2, 4, ... edits.

    A node's rank among all nodes is that of its least audit, cut to the length reached; the empty
    audit is the least. The arcs of a node have different labels, so its first rank tells its arc.
    Ranks and pointers double together until every pointer is at an end: then equal ranks mean equal
    audits, and no longer length can tell more nodes apart.
    """
    node = np.arange(to.shape[1])
    ends = (to < 0).all(axis=0)
    rank = np.where(ends, 0, 1 + (to >= 0).argmax(axis=0))
    label = np.where(ends, 4, rank - 1)
    pointers = [np.where(ends, node, to[np.minimum(label, 3), node])]
    while not ends[pointers[-1]].all():
        p = pointers[-1]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[p], return_inverse=True)[1]
        pointers.append(p[p])
    return label, pointers


def _paths(begin: np.ndarray, label: np.ndarray, pointers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the paths from `begin`, in order: path number, place in it, node; ends are left out."""
    path = np.flatnonzero(label[begin] < 4)
    node, place = begin[path], np.zeros(len(path), np.int64)
    for k in range(len(pointers) - 1, -1, -1):
        ahead = pointers[k][node]
        live = label[ahead] < 4
        path, node, place = np.concatenate([path, path[live]]), np.concatenate([node, ahead[live]]), np.concatenate([place, place[live] + (1 << k)])
    order = np.lexsort((place, path))
    return path[order], place[order], node[order]


ROW = ["turn", "role", "text"]


def _edits(rows: pa.Table, first: np.ndarray, dup: np.ndarray, end: np.ndarray, begin: np.ndarray, ends_here: np.ndarray, blk: int) -> pa.Table:
    """The edits of the sequences of `rows` from their first states, to costs `end` behind them."""
    letter, blank, cut = (np.asarray(rows[c]) for c in ("letter", "blank", "cut"))
    dup = dup & ~blank
    cut = cut & ~blank & ~dup
    must = blank | dup
    v = _costs(first, letter, must, cut, end)
    to = _optimal_arcs(v, first, letter, must, cut, ends_here)
    label, pointers = _ranked(to)
    layer = first[:-1] + np.arange(len(first) - 1)
    path, place, node = _paths(4 * layer + begin, label, pointers)
    what = label[node]
    row = np.where(what == 1, -1, node // 4 - path)
    own = pa.array(row, pa.int64(), mask=row < 0)
    new = to[what, node] % 4
    fault = np.where(blank, "blank", np.where(dup, "duplicate", np.where(cut, "truncated", "")))
    made = pa.array(np.array(ROLES)[new]).cast(pa.string())
    old = rows["role"].take(own)
    role = pc.if_else(pa.array((what == 0) | (what == 2)), old, made)
    head = first[:-1][path]
    return pa.table({
        "conv_id": rows["conv_id"].take(pa.array(head)), "blk": pa.array(np.full(len(row), blk), pa.int64()), "place": pa.array(place, pa.int32()),
        "edit": pa.array(np.array(list(LABELS))[what]), "fault": pc.if_else(pa.array(row < 0), "", pa.array(fault[row]) if len(fault) else pa.array([], pa.string())),
        "turn": rows["turn"].take(own), "old_role": old, "role": role, "text": pc.fill_null(rows["text"].take(own), ""),
    })


def _ids(*columns: pa.ChunkedArray) -> np.ndarray:
    """A number for each row that is equal where all columns are equal, nulls included."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        codes = np.asarray(c.combine_chunks().dictionary_encode("encode").indices)
        out = np.unique(out * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return out


def _repeats(rows: pa.Table, home: np.ndarray) -> np.ndarray:
    """Which rows have an equal role and text earlier in their home."""
    codes = _ids(pa.chunked_array([pa.array(home)]), rows["role"], rows["text"])
    dup = np.ones(len(codes), bool)
    dup[np.unique(codes, return_index=True)[1]] = False
    return dup


def _as(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for name in schema.names:
        if name not in rows.column_names:
            rows = rows.append_column(name, pa.nulls(len(rows), schema.field(name).type))
    yield from rows.select(schema.names).cast(schema).to_batches(max_chunksize=10_000)


def _whole_or_open(schema_of: str, block_rows: int, block_bytes: int):
    """Repairs the conversations that lie within a task; rows of the others pass as blocks, without an edit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None
        going_on = True  # the conversation held may have begun elsewhere
        out: pa.Schema | None = None

        def block(rows: pa.Table) -> pa.Table:
            nonlocal blk
            blk += 1
            return rows.append_column("blk", pa.array(np.full(len(rows), blk), pa.int64())).append_column("place", pa.array(np.arange(len(rows)), pa.int32()))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if out is None:
                out = _schema(rows.schema)
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            conv = _ids(rows["conv_id"])
            first = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1, [len(rows)]])
            if len(first) > 2 and going_on:  # it ends here
                yield from _as(block(rows.slice(0, first[1])), out)
                rows, first, going_on = rows.slice(first[1]), first[1:] - first[1], False
            if len(first) > 2:
                done = rows.slice(0, first[-2])
                mine = first[:-1]
                blk += 1
                dup = _repeats(done, np.repeat(np.arange(len(mine) - 1), np.diff(mine)))
                c = len(mine) - 1
                yield from _as(_edits(done, mine, dup, np.tile(FINAL, (c, 1)), np.zeros(c, np.int64), np.ones(c, bool), blk), out)
            held = rows.slice(first[-2]).combine_chunks()
            while len(held) >= block_rows or held.nbytes >= block_bytes:
                yield from _as(block(held.slice(0, block_rows)), out)
                held, going_on = held.slice(block_rows), True
        if held is not None and len(held):
            yield from _as(block(held), out)

    return run


def _schema(rows: pa.Schema) -> pa.Schema:
    text = pa.string()
    return pa.schema([
        rows.field("conv_id"), ("blk", pa.int64()), ("place", pa.int32()), ("edit", text), ("fault", text), rows.field("turn"), ("old_role", text), ("role", text), ("text", text),
        ("letter", pa.int32()), ("blank", pa.bool_()), ("cut", pa.bool_()),
    ])


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    """Costs of a block from state to state."""
    n = len(rows)
    seq = lambda c: np.tile(rows[c].to_numpy(), 4)
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    return _costs(np.arange(5) * n, seq("letter"), seq("must"), seq("cut"), unit)[np.arange(4) * (n + 1)].T


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def chain(links: DataFrame, start: list[int], fan: int = FAN) -> DataFrame:
    """`(c, rank, v)`: for each link the vector that reaches it, when `start` goes through all links of larger rank.

    `links` is `(c, rank, m)`, with ranks from 0 in each chain c and m a 4 x 4 matrix of costs, by
    rows; a vector goes through a matrix by the least sums. Chains of more than `fan` links are
    summed up by `fan` links first, so no task sees a whole long chain.
    """
    links = materialize(links, "links")
    longest = links.agg(F.max("rank")).first()[0]
    if longest is None or longest < fan:
        begin = links.groupBy("c").agg(F.lit(0).cast("long").alias("group")).select("c", "group", F.array(*map(F.lit, start)).cast("array<long>").alias("v"))
        parts = links.withColumn("group", F.lit(0).cast("long"))
    else:
        parts = links.withColumn("group", F.floor(F.col("rank") / fan))

        def product(pdf: pd.DataFrame) -> pd.DataFrame:
            ms = [np.array(m).reshape(4, 4) for m in pdf.sort_values("rank")["m"]]
            whole = ms[0]
            for m in ms[1:]:
                whole = _compose(whole, m)
            return pd.DataFrame({"c": [pdf["c"].iat[0]], "rank": [pdf["group"].iat[0]], "m": [whole.ravel().tolist()]})

        sums = parts.groupBy("c", "group").applyInPandas(product, "c long, rank long, m array<long>")
        begin = chain(sums, start, fan).withColumnRenamed("rank", "group")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ascending=False)
        v, out = np.array(pdf["v"].iat[0]), []
        for m in pdf["m"]:
            out.append(v.tolist())
            v = np.minimum((np.array(m).reshape(4, 4) + v).min(axis=1), FAR)
        return pd.DataFrame({"c": pdf["c"], "rank": pdf["rank"], "v": out})

    return parts.join(begin, ["c", "group"]).groupBy("c", "group").applyInPandas(walk, "c long, rank long, v array<long>")


def _repair_open(rows: DataFrame, conv_type: str, turn_type: str, fan: int) -> DataFrame:
    """The edits of conversations that lie in several blocks or tasks."""
    # A repeat is a row whose role and text stand earlier in its conversation; the hash holds all three.
    rows = rows.withColumn("_h", F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256))
    heads = materialize(rows.groupBy("_h").agg(F.min(F.struct("blk", "place")).alias("_at")).select(F.col("_at.blk").alias("blk"), F.col("_at.place").alias("place"), F.lit(False).alias("dup")), "heads")
    rows = rows.drop("_h").join(heads, ["blk", "place"], "left").withColumn("dup", F.coalesce("dup", F.lit(True)))
    rows = materialize(rows.withColumn("must", F.col("blank") | F.col("dup")).withColumn("cut", F.col("cut") & ~F.col("must")), "open")

    codes = rows.select("conv_id", "blk", "place", "letter", "must", "cut")

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blk": [pdf["blk"].iat[0]], "m": [_matrix(pdf.sort_values("place")).ravel().tolist()]})

    blocks = codes.groupBy("blk").applyInPandas(matrix, "blk long, m array<long>")
    by_order = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_end = Window.partitionBy("conv_id").orderBy(F.desc("blk"))
    homes = rows.select("conv_id", "blk").distinct()
    homes = homes.select("blk", F.min("blk").over(by_order).alias("c"), (F.row_number().over(by_order) - 1).cast("long").alias("rank"), (F.row_number().over(by_end) - 1).cast("long").alias("back"))
    homes = materialize(homes, "homes")
    ahead = chain(homes.join(blocks, "blk").select("c", "rank", "m"), FINAL.tolist(), fan)
    homes = materialize(homes.join(ahead, ["c", "rank"]), "ahead")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where the least path from each state leaves the block, as a matrix; transposed, since the chain runs forwards."""
        pdf = pdf.sort_values("place")
        n = len(pdf)
        first = np.array([0, n])
        letter, must, cut = (pdf[c].to_numpy() for c in ("letter", "must", "cut"))
        v = _costs(first, letter, must, cut, np.array([pdf["v"].iat[0]]))
        _, pointers = _ranked(_optimal_arcs(v, first, letter, must, cut, np.array([False])))
        m = np.full((4, 4), FAR)
        m[pointers[-1][np.arange(4)] % 4, np.arange(4)] = 0
        return pd.DataFrame({"blk": [pdf["blk"].iat[0]], "m": [m.ravel().tolist()]})

    maps = codes.join(homes.select("blk", "v"), "blk").groupBy("blk").applyInPandas(states, "blk long, m array<long>")
    reached = chain(homes.join(maps, "blk").select("c", F.col("back").alias("rank"), "m"), [0, FAR, FAR, FAR], fan)
    begun = reached.select("c", F.col("rank").alias("back"), F.col("v").alias("reach"))
    homes = materialize(homes.join(begun, ["c", "back"]).select("blk", "v", (F.array_position("reach", F.lit(0).cast("long")) - 1).cast("long").alias("begin"), (F.col("back") == 0).alias("last")), "begun")

    def edits(block: pa.Table) -> pa.Table:
        block = block.sort_by("place").combine_chunks()
        end, begin, last = np.array([block["v"][0].as_py()]), np.array([block["begin"][0].as_py()]), np.array([block["last"][0].as_py()])
        out = _edits(block, np.array([0, len(block)]), np.asarray(block["dup"]), end, begin, last, block["blk"][0].as_py())
        return out.cast(pa.schema([_schema(block.schema).field(c) for c in out.column_names]))

    out = f"conv_id {conv_type}, blk long, place int, edit string, fault string, turn {turn_type}, old_role string, role string, text string"
    return rows.join(homes, "blk").groupBy("blk").applyInArrow(edits, out)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """The cheapest edits of each conversation of `(conv_id, turn, role, text)`, the least audit of all such.

    A row for each edit: conv_id, its place (blk, place), edit (D, I, K or R), fault of the row
    (blank, duplicate, truncated or empty), turn, old_role, role, text. Inserted rows have no turn and
    no old_role; deleted rows still have their text.

    Rows are in the order of turn, nulls first, then role and text; equal rows count as often as they
    occur. Null roles and texts count as one space; a null conv_id is a conversation of its own. Other columns
    are left out. Conversations of any length and texts of any length are taken, with blocks of
    bounded size; a conversation without rows has no edits, and an empty table gives an empty one.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", word("role"), word("text"))
    bare = F.rtrim("text", F.lit(BLANKS))
    head = F.left("role", F.lit(1))
    letter = F.when(head == "s", S).when(head == "u", U).when(head == "a", A).otherwise(0)
    rows = rows.select("*", letter.cast("int").alias("letter"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    # The last key lets equal rows lie in several tasks.
    order = ["conv_id", "turn", "role", "text", "_tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    conv_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    edits = f"conv_id {conv_type}, blk long, place int, edit string, fault string, turn {turn_type}, old_role string, role string, text string"
    made = materialize(dealt.mapInArrow(_whole_or_open(edits, block_rows, block_bytes), f"{edits}, letter int, blank boolean, cut boolean"), "repaired")
    columns = [c.split()[0] for c in edits.split(", ")]
    whole = made.filter("edit IS NOT NULL").select(*columns)
    left = made.filter("edit IS NULL").select("conv_id", "blk", "place", "turn", "role", "text", "letter", "blank", "cut")
    return whole.unionByName(_repair_open(left, conv_type, turn_type, fan))


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COSTS = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
LEGAL = {"su", "ua", "au"}


class _Sum:
    """What the digest knows of a conversation while its edits pass."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit = conv, hashlib.sha256(), []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.turns, self.low, self.high = 0, None, None
        self.illegal, self.cost, self.head, self.lines = 0, 0, None, 0

    def take(self, edit: str, fault: str, turn: int | None, old: str | None, role: str, text: str) -> None:
        self.audit.append(edit)
        self.cost += COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.high:
                self.turns, self.high = self.turns + 1, turn
                self.low = turn if self.low is None else self.low
            if self.head is not None and self.head + old[:1] not in LEGAL:
                self.illegal += 1
            self.head = old[:1]
        if edit != "D":
            self.hash.update(("\n" * bool(self.lines) + f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> list:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def digest(edits: DataFrame) -> DataFrame:
    """A row for each conversation with edits: counts of faults, cost, audit, and the hash of the repaired rows.

    A hash is one pass over its conversation, so a conversation's edits pass through one task, in
    order and batch by batch; only the audit, which is part of the row, grows with them.
    """
    types = {f.name: f.dataType.simpleString() for f in edits.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Sum | None = None
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("conv_id"), *[(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in DIGEST.split(", ")]])
            done = []
            for conv, *edit in zip(*[b[c].to_pylist() for c in ("conv_id", "edit", "fault", "turn", "old_role", "role", "text")]):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Sum(conv)
                now.take(*edit)
            if done:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema)
        if now is not None:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(now.row(), schema)], schema)

    order = edits.repartition("conv_id").sortWithinPartitions("conv_id", "blk", "place")
    return order.mapInArrow(run, f"conv_id {types['conv_id']}, {DIGEST}")


def repair_report(conversations: DataFrame, rows: DataFrame, **how) -> DataFrame:
    """The digest of the repaired `rows` for every conv_id of `conversations`; one without rows has zeros, an empty audit and the empty string's hash."""
    found = digest(repair(rows, **how)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    empty = hashlib.sha256().hexdigest()
    filled = [F.coalesce(c.split()[0], F.lit("" if c.startswith("audit") else empty if "string" in c else 0)).alias(c.split()[0]) for c in DIGEST.split(", ")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *filled)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 12 over all conversations, damaged as the contract says."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(conversations, damage(conversations))
