import hashlib
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.sources.jsonl import answer_column

import pytest


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", expr(F.col("c")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


NORMAL = [
    ("", ""),
    ("   \t ", ""),
    ("one  two\tthree", "one two three"),
    ("l’été ʼ`", "l'été"),
    ("« Bonjour » ?", "Bonjour \"?"),
    ("wait… now", "wait... now"),
    ("a – b — c", "a - b - c"),
    ("Vraiment ? Oui ! Bon ; voilà : fin", "Vraiment? Oui! Bon; voilà: fin"),
    ("Question 12 : Que faire", "Que faire"),
    ("sujet - le temps", "le temps"),
    ("  SUJET3. le vent  ", "le vent"),
    ("Questions ouvertes", "Questions ouvertes"),
    ("\"'quoted'\"", "quoted"),
    ("\u00a0narrow\u2009spaces\u3000here", "narrow spaces here"),
]


def test_normal_forms(spark):
    assert column(spark, [t for t, _ in NORMAL], T.normalize_text) == [n for _, n in NORMAL]


def plain_distance(p, q):
    """Length of the longest common subsequence, by the definition."""
    if not p or not q:
        return 0
    return 1 + plain_distance(p[1:], q[1:]) if p[0] == q[0] else max(plain_distance(p[1:], q), plain_distance(p, q[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), max_size=8))
def test_diff_is_longest(p, q):
    steps = list(T._common_steps(np.array(p, np.int64), np.array(q, np.int64)))
    assert steps.count("=") == plain_distance(p, q) and steps.count("=") + steps.count("-") == len(p) and steps.count("=") + steps.count("+") == len(q)


def test_diff_of_long_texts(spark):
    x = " ".join(f"w{i % 97}" for i in range(3_000))
    y = x.replace("w5 ", "").replace("w9 ", "w9 new ")
    ops = T.word_diff(spark.createDataFrame([(x, y), (None, "a b"), ("same", "same")], "x string, y string"), "x", "y").collect()
    side = lambda r, op: "".join(o.tok for o in r["diff"] if o.op in ("=", op))
    assert all((side(r, "-"), side(r, "+")) == (r.x or "", r.y or "") for r in ops)
    assert sum(o.op != "=" for o in ops[0]["diff"]) == 2 * (x.count("w5 ") + x.count("w9 "))


def test_fingerprint_ignores_case_accents_and_marks(spark):
    a, b, c = column(spark, ["Été à Paris !", "ete a paris", "hiver a Paris"], T.fingerprint)
    assert a != c and b == hashlib.sha256(b"ete a paris").hexdigest()
    assert column(spark, ["Été à Paris!"], T.fingerprint) == [b]


def test_composed_marks(spark):
    df = spark.createDataFrame([("éte",), ("plain",), (None,)], "text string")
    assert sorted(str(r.text) for r in T.composed(df).collect()) == ["None", "plain", "éte"]


def test_slots_of_a_prompt(spark):
    s = column(spark, ["Je suis votre voisin. Il pleut. Vous me demandez des conseils (prix, dates, etc.)."], T.breakdown_slots)[0]
    assert (s.role, s.task, s.hints) == ("Je suis votre voisin", "Vous me demandez des conseils (prix, dates, etc", ["prix", "dates", "etc."]) and s.situation == "Il pleut."


def test_decoration(spark):
    assert column(spark, ["• → Agence → Vous louez", " plain  text"], T.clean_decoration) == ["Agence : Vous louez", "plain text"]


def test_answer_column():
    assert answer_column(["id", "theme", "model"]) == "theme" and answer_column(["id", "text", "theme"]) == "theme"
    with pytest.raises(ValueError):
        answer_column(["id", "a", "b"])


def test_word_diff(spark):
    df = spark.createDataFrame([("a b c", "a x c")], "p string, q string")
    ops = [(o.op, o.tok) for o in T.word_diff(df, "p", "q").first()["diff"]]
    assert ops == [("=", "a"), ("=", " "), ("-", "b"), ("+", "x"), ("=", " "), ("=", "c")]


def test_marks_of_every_script_go(spark):
    import unicodedata

    texts = ["été", "a⃗b", "д҃x", "אַ", "n᪰o", "x\U0001d165y", "︠k"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.without_accents(F.col("t")).alias("t")).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts]


def test_diffs_and_nodes_leave_in_small_batches(spark, monkeypatch):
    """Neither a batch of long rows nor what comes of it is held whole."""
    from tallyloom.operators import batches, html

    df = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("one two <b>x</b> "), 4000).alias("a"))
    sizes = html.html_nodes(df, "id", "a").groupBy("page_id").count()
    assert {r["count"] for r in sizes.collect()} == {8001}
    seen = df.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long").agg(F.max("n")).first()[0]
    assert seen * 17 * 4000 <= 2 * batches.BATCH_BYTES
    pairs = spark.createDataFrame([(i, "a b c " * 900, "a c " * 900) for i in range(30)], "id long, a string, b string").coalesce(1)
    got = T.word_diff(pairs, "a", "b")
    assert got.count() == 30
    assert {(r.id, "".join(x.tok for x in r.diff if x.op in "=-") == r.a, "".join(x.tok for x in r.diff if x.op in "=+") == r.b) for r in got.collect()} == {(i, True, True) for i in range(30)}


def test_word_hashes_tell_the_words_of_word_tokens_apart(spark):
    """Equal hashes for equal words only, the same words in the same order, whatever the script, marks, blanks or lead of a text."""
    import random

    import numpy as np

    dice = random.Random(3)
    parts = ["a", "B", "é", "é", "K", "İ", "ß", "ﬁ", "9", "٣", " ", " ", " ", "\x1c", "\x85", "'", "’", "ʼ", "…", "–", "Question 3 :", "sujet -", "sujet ", "queſtion:", "中", "𝒜", "\U0001d165", "Ǻ", "Ａ", "\n", ".", "x", "\0", "ã", "ạ̈", "Ö"]
    texts = ["", None, " SUJET 12 – go", "Question …x", "sujet 1 2: a", "question:question:a", "x" * 70 + " b"] + ["".join(dice.choices(parts, k=dice.randint(1, 30))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(1)
    rows = {r.k: r for r in df.select("k", T.word_tokens(F.col("text")).alias("w")).withColumn("g", T.ngrams(F.col("w"), 3)).collect()}
    for upto, col in ((1, "w"), (3, "g")):
        h, doc = T.ngram_hashes(*T.word_hashes(texts), upto)
        of = {}
        for k in rows:
            mine, said = h[doc == k].tolist(), rows[k][col] or []
            assert len(mine) == len(said), texts[k]
            if upto == 1:
                for x, w in zip(mine, said):
                    assert of.setdefault(w, x) == x, (texts[k], w)
            else:
                assert len(set(mine)) == len(set(said))
        assert len(set(of.values())) == len(of)
    assert [len(x) for x in T.word_hashes([])] == [0, 0] and (np.bincount(T.word_hashes(["a b"] * 9)[1]) == 2).all()
