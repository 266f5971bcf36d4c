"""The numbered operators against plain versions, round trips and held-out labels."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from odd import ROWS, table
from oracle import connect, same
from pyspark.sql import functions as F
from tests_data import SF, SF01

from tallyloom.llm.common import sums_before
from tallyloom.llm import bpe, edit_fingerprint as E, line_dedup, pii, quality_cnn, quality_rules, registry


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql_twins(spark, name):
    same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE[name])


def accuracy(rows, label):
    marks = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF01}/labels.parquet'").fetchall())
    held = [(r.predicted, marks[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in marks]
    return sum(p == m for p, m, _ in held) / len(held), held


def test_quality_cnn_held_out(spark):
    """Against the labels that weren't learned from, and against always answering `good`."""
    sf = "/root/testdata/sf0.1"
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = quality_cnn.op10_quality_classifier(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    right = sum(p == m for p, m in held) / len(held)
    assert right > 0.97 > sum(m for _, m in held) / len(held) + 0.08
    assert sum(p for p, m in held if m) / sum(m for _, m in held) > 0.985  # good ones pass


def test_chunks_cover_the_whole_text():
    text = "".join(chr(97 + i % 26) for i in range(5_000))
    c, n = quality_cnn.chunked(text)
    assert bytes(c[0]) + b"".join(bytes(x[quality_cnn.CHUNK - quality_cnn.STEP :]) for x in c[1:]) == text.encode().ljust(quality_cnn.CHUNK + quality_cnn.STEP * (len(c) - 1), b"\0")
    assert n.tolist() == [1024] * (len(c) - 1) + [5_000 - quality_cnn.STEP * (len(c) - 1)]


def test_padding_is_not_pooled():
    net = quality_cnn.ByteCNN.new()
    c, n = quality_cnn.chunked("x" * 21)
    windows = net.windows(c)[0][:6] @ net.filters  # six windows begin within 21 bytes
    assert np.allclose(net.pooled(c, n)[0], np.maximum(windows.max(axis=0), 0), atol=1e-5)
    assert net.pooled(*quality_cnn.chunked("")).shape == (1, quality_cnn.FILTERS)


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A plain sentence, of some length, that ends as it should.", False), ("Really? Yes!", False), ("Wow!!! Buy!!!", True), ("home", True), ("Über uns", True), ("three short words", True), ("three short words.", False),
        ("Copyright 2020, all rights reserved.", True), ("The phrase all rights reserved " + "stands in a long sentence of many words " * 8 + "here.", False), ("all rights reserved, " * 30 + "end.", True),
        ("Tous droits réservés par la société.", True), ("THIS LINE IS SHOUTED FROM ITS FIRST WORD TO THE LAST.", True), ("### $$$ %%%.", True), ("Home | News | Sports | Contact | About.", True), ("1234567890 1234567890.", True),
    ],
)
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(quality_rules.line_fails(F.col("x")).alias("f")).first().f == fails


def lean(spark, docs, **how):
    return {r.doc_id: (r.text, r.line_dedup.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()}


def test_line_templates(spark):
    docs = [(i, f"{chr(97 + i) * 9} {chr(98 + i) * 5} {chr(99 + i) * 7} is a body.\nCall us now at {i * 37} today") for i in range(8)]
    docs += [(100, "Call us now at nine today maybe\nunique words of this one")]
    got = lean(spark, docs)
    assert got[0] == (docs[0][1], 0) and all(got[i] == (docs[i][1].split("\n")[0], 1) for i in range(1, 8)) and got[100][1] == 0


def test_mostly_boilerplate_and_short_templates(spark):
    docs = [(i, f"Contact page {i}\nAll the news of the day, every day, for all of you\nown{i} x{i}y") for i in range(9)] + [(20 + i, f"12 34 {i}{i}") for i in range(9)] + [(40 + i, f"7 7\nq{chr(97 + i)}") for i in range(9)]
    got = lean(spark, docs)
    assert got[0][1] == 0 and all(got[i] == (f"own{i} x{i}y", 2) for i in range(1, 9))
    assert all(got[20 + i][1] == 0 for i in range(9))  # digits alone make no template
    assert all(got[40 + i] == (f"q{chr(97 + i)}", 1) for i in range(1, 9))  # but a line that recurs as it stands does


def test_long_passages_of_two_documents(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    assert lean(spark, [(1, f"one own line\n{passage}"), (2, f"{passage}\nand another"), (3, "third")]) == {1: (f"one own line\n{passage}", 0), 2: ("and another", 1), 3: ("third", 0)}


def test_copies(spark):
    text = "One line of the copy.\nAnother line of the copy, somewhat longer than that."
    docs = [(i, text) for i in range(9)]
    assert set(lean(spark, docs).values()) == {(text, 0)}  # a text doesn't recur by being copied
    near = [(i, f"{text}\nx{chr(97 + i)}") for i in range(9)]
    assert [lean(spark, near)[i][1] for i in range(9)] == [0] + [2] * 8
    assert {n for _, n in lean(spark, near, leave_copies=True).values()} == {0}


KINDS = {k: re.compile(p) for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    out = []
    for rank, (k, p) in enumerate(KINDS.items()):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "email") or (k == "ip" and all(int(x) < 256 for x in m[0].split("."))) or (k == "card" and 12 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), rank, k, m.end()))
    return [f"{k}:{a}:{z}" for a, _, k, z in sorted(out)]


TRICKY = ["a.b@c.d@e.f x@y-z.co. 1.2.3.4.5 300.1.1.1 000.01.1.255", "4111-1111 1111 1111 4111111111111111  4111111111111112 4111 1111 11111111 1", "+12(34).56-78 9 +1 +123456789012345678 é+33 1 23 45 67 89", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "x" * 5000 + "@a.b", "5500 0000-0000 0004, 99999999999999999999"]


def test_base_entities(spark, texts):
    rows = [*texts.items(), *[(10**6 + i, t) for i, t in enumerate(TRICKY)]]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii._listed(F.col("pii.base")).alias("s")).collect()
    want = dict(rows)
    assert all(r.s == ",".join(plain_spans(want[r.doc_id])) for r in got)


def test_discovery_and_redaction(spark):
    docs = [(i, f"write to mailbox u{i}@mail.org please") for i in range(8)] + [(50, "write to mailbox AB-99-4411-X now"), (51, "chapter 123456 of the book")]
    out = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"))
    spans = F.array_sort(F.concat("pii.base", "pii.extra"))
    got = {r.doc_id: r.t for r in out.select("doc_id", pii.redacted(F.col("text"), spans).alias("t")).collect()}
    assert got[3] == "write to mailbox [EMAIL] please" and got[50] == "write to mailbox [ID] now" and got[51] == docs[-1][1]


def test_discovery_finds_planted_identifiers(spark):
    """Seeds, planted identifiers of shapes that no base kind has, dates and ordinary words, in running text; precision and recall."""
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    shapes = (lambda: f"KX-{rng.integers(10, 99)}-{rng.integers(10_000, 99_999)}", lambda: f"ab{rng.integers(10**6, 10**7)}z", lambda: "".join(rng.choice(list("QWZXJ"), 8)), lambda: f"{rng.integers(10**6, 10**7)}/{rng.integers(10, 99)}", lambda: "".join(rng.choice(list("qwzxjkv"), 9)))
    contexts = (("contact login {} today", 0), ("his account {}, says the file", 1), ("(user name: {})", 2))
    docs, planted = [], {}
    for i in range(900):
        about, k = contexts[i % 3]
        kind = rng.random()
        if kind < 0.5:
            what = f"u{i}@mail{k}.example.org"
        elif kind < 0.65:
            what = str(shapes[rng.integers(0, 5)]())
            planted[i] = what
        elif kind < 0.7:
            what = f"{rng.integers(1990, 2024)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}"
        else:
            about, what = "{} " + prose(1) + " {}", f"{''.join(rng.choice(list('abcdefgh'), 9))}{rng.integers(0, 99)}"  # rare words elsewhere
        docs.append((i, f"{prose(rng.integers(5, 60))} {about.format(what, what)} {prose(rng.integers(5, 60))}."))
    out = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"), plain_words=True).collect()
    found = [(r.doc_id, s.value) for r in out for s in r.pii.extra]
    right = sum(planted.get(i) == v for i, v in found)
    assert all(dict(docs)[r.doc_id][s.start : s.end] == s.value for r in out for s in r.pii.extra)
    assert right / len(found) >= 0.9 and right / len(planted) >= 0.9, (right, len(found), len(planted))


def test_many_hits_take_time_in_proportion(spark):
    import time

    took = []
    for n in (1_000, 16_000, 64_000):
        df = spark.createDataFrame([(1, "7123456 " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.find_pii(df).count() == 1
        took.append(time.time() - began)
    assert took[2] < 5 * took[1]


def test_sums_before(spark):
    for n in (0, 1, 31, 32, 33, 1_000, 40_000):
        xs = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(xs,)], "xs array<int>").select(sums_before(F.col("xs")).alias("s")).first().s
        assert got == [0, *np.cumsum(xs).tolist()][:n]


def plain_walk(text):
    """The embedding step by step, for one text."""
    codes = [((ord(ch) * 0x9E3779B1) >> 13) & (E.CLASSES - 1) for ch in text] + [E.CLASSES]
    level = E._level(np.arange(E.STEPS_PER_CHAR * len(text) + 1))
    out, at = [], 0
    for j in range(E.STEPS_PER_CHAR * len(text)):
        if level[j] >= E.thinning(len(text)):
            out.append(int(E._NIBBLE[codes[at]]))
        at += int(E._MOVES[j % E.PERIOD][codes[at]])
    return out


def test_walk_equals_the_plain_one():
    texts = ["", "a", "ab", "some longer text, é😀", "x" * 400, "".join(chr(97 + i * i % 26) for i in range(1500))]
    assert [w.tolist() for w in E.walk(texts)] == [plain_walk(t) for t in texts]
    assert [E._walk_alone(t).tolist() for t in texts if t] == [plain_walk(t) for t in texts if t]
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(20_000))
    assert E.walk([long, "ab"])[0].tolist() == plain_walk(long)


def test_edited_texts_and_likeness(spark):
    rows = E.op6_fingerprint(spark, SF01).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF01}/documents.parquet'").fetchall())
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    by_text = {}
    for r in rows:
        t = texts[r.doc_id]
        k = len(t) // 3
        edited = t[: len(t) - k] + texts[after[r.doc_id]][:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
    assert len(rows) == len(texts) and np.mean([r.near_edited > r.near_next for r in rows]) > 0.97


def test_few_edits_keep_the_fingerprint_alike():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghij "), 3000))
    near = text[:1000] + "XYZ" + text[1001:2000] + text[2003:]
    other = "".join(rng.choice(list("abcdefghij "), 3000))
    a, b, c = ((len(t), n) for t, n in zip((text, near, other), E.walk([text, near, other])))
    assert E.likeness(a, b) > 0.8 > 0.3 > E.likeness(a, c) and E.likeness(a, a) == 1


def test_alike_groups(spark, texts):
    docs = [(1, "the same words again and again " * 20), (2, "the same words again and again " * 20), (3, "the same words again and again " * 19 + "the same words again and agaim "), (4, "quite other content here, nothing shared " * 15)]
    prints = E.edit_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "fingerprint")
    got = {r.doc_id: r.near_id for r in prints.join(E.alike_groups(prints), "fingerprint").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_groups_against_brute_force(spark):
    """Texts edited at the head, in the middle, at the tail and all over: nine tenths of all links are found, whatever lies between."""
    rng = np.random.default_rng(12)
    alphabet = list("abcdefghijklmnop  ")
    texts = []
    for n in [24, 60, 150, 400, 900, 2_000, 5_000, 9_000] * 6:
        base = rng.choice(alphabet, n)
        texts.append("".join(base))
        for where in ("head", "middle", "tail", "all over"):
            k, t = max(1, n // 12), base.copy()
            at = {"head": 0, "middle": n // 2, "tail": n - k}.get(where)
            at = rng.choice(n, max(1, n // 40), replace=False) if at is None else np.arange(at, at + k)
            t[at] = rng.choice(alphabet, len(at))
            texts.append("".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = E.edit_fingerprints(docs).select("doc_id", "fingerprint")
    got = {r.doc_id: r.near_id for r in prints.join(E.alike_groups(prints), "fingerprint").collect()}
    parsed = {r.doc_id: E.parsed(r.fingerprint) for r in prints.collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if abs(i - j) < 5 and E.likeness(parsed[i], parsed[j]) >= E.ALIKE]
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 150 and found / len(links) > 0.9
    assert all(i // 5 == j // 5 for i, j in got.items())


def test_groups_in_one_template(spark):
    """600 texts with one head of 700 characters in common, so that all meet in most bands; each has one partner, with an id far off."""
    rng = np.random.default_rng(21)
    alphabet = list("abcdefghijklmnop  ")
    head = rng.choice(alphabet, 700)
    texts = []
    for _ in range(300):
        own = rng.choice(alphabet, 300)
        edited = own.copy()
        edited[rng.choice(300, 60, replace=False)] = rng.choice(alphabet, 60)
        texts += ["".join([*head, *own]), "".join([*head, *edited])]
    ids = rng.permutation(len(texts)).tolist()
    prints = E.edit_fingerprints(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).select("doc_id", "fingerprint")
    got = {r.doc_id: r.near_id for r in prints.join(E.alike_groups(prints), "fingerprint").collect()}
    parsed = {r.doc_id: E.parsed(r.fingerprint) for r in prints.collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if E.likeness(parsed[i], parsed[j]) >= E.ALIKE]
    assert len(links) > 50 and sum(got[i] == got[j] for i, j in links) / len(links) > 0.9
    reach = {i: {i} for i in got}
    for i, j in links:
        if reach[i] is not reach[j]:
            reach[i] |= reach[j]
            reach.update(dict.fromkeys(reach[j], reach[i]))
    assert all(g in reach[i] for i, g in got.items())


def test_packed_nibbles():
    for digits in ("", "7", "0f", "abc", "00012"):
        packed = bytes.fromhex("0" * (len(digits) % 2) + digits)
        assert E._unpacked(packed, len(digits)).tolist() == [int(d, 16) for d in digits]


def test_alike_groups_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "only without an id"), (None, None), (3, "ab"), (4, "ab"), (5, "abc")]
    prints = E.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fingerprint")
    got = {r.doc_id: r.near_id for r in prints.filter("doc_id is not null").join(E.alike_groups(prints), "fingerprint").collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == 3
    assert E.alike_groups(prints.filter("doc_id = 99")).collect() == []


@pytest.fixture(scope="module")
def plain_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, texts, plain_encoding):
    rows = [*texts.items(), *[(10**6 + n, t) for n, (_, t) in enumerate(ROWS) if t and len(t) < 100_000], (10**7, "".join(map(chr, [*range(1, 0x3000, 3), 0x85, 0x1C, 0x2028, 0x1F600])))]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == plain_encoding.encode_ordinary(want[r.doc_id]) and bytes(r.decoded) == want[r.doc_id].encode()


def test_decode(spark):
    df = spark.createDataFrame([([0, 1, 2], "x"), ([], "y"), (None, "z")], "ids array<int>, decoded string")
    t = bpe.token_bytes()
    assert [None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(df).collect()] == [t[0] + t[1] + t[2], b"", None]
    with pytest.raises(Exception, match="out of bounds"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>")).collect()


def test_bpe_decoding_joins_rows(spark):
    """Batches of any size and kind come back whole, their columns too, and the plan has one join and no shuffle."""
    table = bpe.token_bytes()
    rows = [(i, [(i * 7 + k * k) % len(table) for k in range(i % 50 * (i % 3))], f"t{i}") for i in range(400)] + [(400, None, "none"), (401, [5] * 300_000, "long")]
    df = spark.createDataFrame(rows, "own long, ids array<int>, decoded string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = bpe.decode(df)
        found = {r.own: (r.ids, None if r.decoded is None else bytes(r.decoded)) for r in got.collect()}
        assert found == {i: (ids, None if ids is None else b"".join(table[k] for k in ids)) for i, ids, _ in rows}
        plan = bpe.decode(spark.createDataFrame(rows, "own long, ids array<int>, decoded string"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan
        assert bpe.decode(df.filter("own < 0")).collect() == []
        with pytest.raises(Exception, match="token id is null"):
            bpe.decode(spark.createDataFrame([([1, None],)], "ids array<int>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bpe_query(spark, texts, plain_encoding):
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    rows = bpe.op9_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain_encoding.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((texts[r.doc_id] or "").encode()))


def test_blocks_that_changed_are_noticed():
    import pyarrow as pa

    one, other = bpe._Block([1], ["some words here"]), bpe._Block([1], ["some other words here"])
    with pytest.raises(ValueError, match="write it first"):
        bpe._reassemble(pa.Table.from_batches([other.position_row(4)]))
    rows = bpe._encode_bucket(pa.Table.from_batches([one.word_rows(1)]))
    got = bpe._reassemble(pa.concat_tables([rows, pa.Table.from_batches([one.position_row(1)])])).to_pylist()
    assert got == [{"doc_id": 1, "ids": bpe.encoding().encode_ordinary("some words here")}] and one.number != other.number


def test_repeated_words(spark):
    rng = np.random.default_rng(6)
    rows = [" ".join(rng.choice(list("abcd"), n)) for n in (0, 1, 2, 3, 4, 10, 60, 400)] + ["x y z q x y z", "a a a a"]

    def plain(t):
        w = t.split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({p for i, g in enumerate(tri) if tri.count(g) > 1 for p in (i, i + 1, i + 2)})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", quality_rules.words_of(F.col("t")).alias("w")).select("i", quality_rules.repeated_words(F.col("w")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: plain(t) for i, t in enumerate(rows)}


def test_pii_does_not_move_texts_to_their_spans(spark):
    """Only the columns that are read meet the spans; names like its own don't clash."""
    df = spark.createDataFrame([(1, "mail a@b.co", 5, 6)], "doc_id long, text string, _own_id int, _th int")

    def nodes(p):
        yield p
        for k in range(p.children().size()):
            yield from nodes(p.children().apply(k))

    plan = pii.find_pii(df).select("doc_id", "_own_id", "pii")._jdf.queryExecution().optimizedPlan()
    join = next(n for n in nodes(plan) if n.nodeName() == "Join")
    moved = join.children().apply(0).output()
    types = [moved.apply(k).dataType().simpleString() for k in range(moved.size())]
    assert sorted(types) == ["bigint", "bigint", "bigint", "int"] or sorted(types) == ["bigint", "bigint", "int"]
    row = pii.find_pii(df).first()
    assert (row["_own_id"], row["_th"], [s.kind for s in row.pii.base]) == (5, 6, ["email"])



def test_registered_queries_have_their_columns(spark):
    assert table(spark).count() == len(ROWS)
    names = {q.split("_")[0] for q in registry.QUERIES}
    assert names == {f"op{n}" for n in range(1, 11)}


def test_op4_finds_plain_words(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), n))
    names = [word(8) for _ in range(12)]
    docs = [(i, f"Some {word(4)} text. The login handle u{i}@mail.example.org was {word(5)} seen.") for i in range(200)]
    docs += [(200 + i, f"Other {word(4)} text. The login handle {n} was {word(5)} seen.") for i, n in enumerate(names)]
    home = str(tmp_path / "in")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{home}/documents.parquet")
    found = {r.doc_id: r.spans for r in pii.op4_pii(spark, home).filter("n_id > 0").collect()}
    right = {i: f"id:{t.index(n)}:{t.index(n) + 8}" for (i, t), n in zip(docs[200:], names)}
    assert found == right


def test_crowded_patterns_are_ruled_out_by_a_part_of_the_texts(spark, monkeypatch):
    """A pattern that all sorts of words fill is not looked at in all texts; what is found is the same by parts and at once."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), n))
    names = [word(8) for _ in range(12)]
    docs = [(i, f"{word(5)} mail u{i}@mail.example.org {word(4)} now {word(5)}. The login handle u{i}@mail.example.org was {word(5)} seen.") for i in range(20)]
    docs += [(100 + i, f"Other {word(4)} text. The login handle {names[i]} was {word(5)} seen." if i < 12 else f"They mail {word(7)} {word(6)} each day") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    looked, words = [], pii._words
    monkeypatch.setattr(pii, "_words", lambda docs, patterns: (looked.append((docs.count(), {r.pattern for r in patterns.collect()})), words(docs, patterns))[1])

    def found():
        looked.clear()
        return sorted((r.doc_id, s.value) for r in pii.find_pii(df, plain_words=True).collect() for s in r.pii.extra)

    at_once = found()
    assert {v for _, v in at_once} >= set(names)
    monkeypatch.setattr(pii, "PART_BYTES", 4 << 10)
    assert found() == at_once
    assert looked[0][0] < len(docs) / 2 and "mail _" in looked[0][1]
    assert looked[-1][0] == len(docs) and "mail _" not in looked[-1][1] and "handle _" in looked[-1][1]
