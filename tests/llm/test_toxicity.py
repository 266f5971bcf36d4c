"""Operator 1: the composed grammar against all paths written out, plain sentences, held-out labels."""

import itertools
import random
import zlib

import duckdb
import pytest

from tallyloom.llm import toxicity as T

SF1 = "/root/testdata/sf0.1"
NAMES = {"i": T.INSULT, "t": T.TARGET, "n": T.NEGATOR, "r": T.REPORTER, "m": T.MODAL, "k": T.THREAT, ".": T.OTHER, "p": T.PERSON, "o": T.OBJECT}


def plain_weight(clause):
    """The best match of a clause such as `t.ni`, every pair of tokens tried."""
    factor = []
    for j, c in enumerate(clause):
        back = clause[max(0, j - 3) : j]
        # A negator's scope is three tokens, counted from the last negator.
        factor.append((0.15 if c in "ik" and "n" in back else 1.0) * (0.3 if c in "ik" and "r" in clause[:j] else 1.0))
    best = 0.0
    for a, b in itertools.combinations(range(len(clause)), 2):
        x, y, gap = clause[a], clause[b], b - a
        if x in "tpo" and y == "i" and gap <= 5:
            best = max(best, factor[b] * (1 - 0.04 * (gap - 1)))
        if x == "i" and y in "tpo" and gap <= 5:
            best = max(best, factor[a] * (0.9 - 0.05 * (gap - 1)))
        if x == y == "i" and gap <= 8:
            best = max(best, factor[a] * factor[b] * 0.9)
        if x == "o" and y == "k" and gap <= 3:
            best = max(best, factor[b] * (0.9 - 0.1 * (gap - 1)))
        if x == "k" and y in "po" and gap <= 3:
            best = max(best, factor[a] * (0.85 - 0.1 * (gap - 1)))
            for m in range(max(0, a - 5), a):
                if clause[m] == "m":
                    best = max(best, factor[a] * (1 - 0.05 * (a - m - 1)) * (0.95 - 0.1 * (gap - 1)))
    return best


def test_composed_grammar_equals_all_paths():
    rng = random.Random(1)
    clauses = ["".join(c) for n in range(4) for c in itertools.product("itnrmk.po", repeat=n)]
    clauses += ["".join(rng.choices("itnrmk.po", [2, 2, 1, 1, 1, 2, 8, 1, 1], k=rng.randrange(5, 16))) for _ in range(1_500)]
    for c in clauses:
        weight, path = T.best_path([NAMES[x] for x in c])
        assert weight == pytest.approx(plain_weight(c)) and bool(path) == (weight > 0), c


@pytest.fixture(scope="module")
def hand():
    return T.ToxicityModel(words={"idiot": 0.95, "moron": 0.95}, stems={"schwach": 0.9}, base=0.001)


def test_clauses(hand):
    scan = T.scanner(hand)
    paths = lambda t: [p for p, _ in scan(t)]
    assert paths("You are an idiot. All is well.") == ["target>insult"]
    assert paths("He is not an idiot") == ["target>insult-negated"]
    assert paths("She said: fine. They said idiot") == ["target>insult-reported"]
    assert paths("idiot, you!") == ["insult>target"] and paths("idiot or moron") == ["insult>insult"]
    assert paths("I will kill you") == ["modal>threat>target"] and paths("I kill you") == ["threat>target"]
    assert paths("Kill the process") == [] and paths("") == []
    assert paths("Schwachkopf") == ["insult"]


def test_scores(hand):
    scan = T.scanner(hand)
    score = lambda t: T.combine(hand, scan(t))
    assert score("You are an idiot") > 0.85 and score("I will kill you") > 0.7 and score("I kill you") > 0.7
    assert 0.2 < score("what an idiot") < 0.7 < score("idiot. moron. idiot.")
    for mild in ("He is not an idiot", "They said idiot", "She wrote that he is an idiot", "I will not kill you"):
        assert score(mild) < 0.35
    assert score("idiot. " + "So it goes on and on. " * 20 + "moron. " + "So it goes on and on. " * 20 + "idiot.") < 0.7
    for thing in ("We will burn calories.", "You shall hang your coat.", "He should burn the letter.", "She will shoot the film.", "I want to kill time."):
        assert score(thing) < 0.1, thing
    assert score("Je vais te tuer") > 0.7 and score("Ich werde dich töten") > 0.7 and score("Wir erschlagen euch") > 0.7
    assert score("You, who came here on foot from far away, met an idiot") < 0.7 < score("You idiot")


@pytest.fixture(scope="module")
def learned(spark):
    return T.fitted(spark, SF1)


def test_ordinary_words_are_no_insults(learned):
    scan = T.scanner(learned)
    for t in (
        "We discussed the plan at a closed meeting.", "The cloud is closer today.", "He was disappointed by the distance.", "The losers of the match shook hands.",
        "You close the door and trace the path of the morning train.", "They lower the price of the lost stuff.", "She is worth it.", "You distribute the clothes.",
    ):
        assert T.combine(learned, scan(t)) < 0.1, t


def test_held_out(spark, learned):
    """Against the labels that weren't learned from, and against always answering `clean`."""
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF1}/labels.parquet'").fetchall())
    rows = T.op1_toxicity(spark, SF1).collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    right = sum(p == m for p, m in held) / len(held)
    caught = sum(p for p, m in held if m) / sum(m for _, m in held)
    precise = sum(m for p, m in held if p) / sum(p for p, _ in held)
    majority = sum(not m for _, m in held) / len(held)
    assert precise > 0.95 and caught > 0.85 and right > majority + 0.08


def test_near_copies_with_other_labels_both_count(spark):
    rows = [(f"{w} one two three you idiot number{w}", 1) for w in "abcdefghij"] + [(f"{w} some clean text of number{w}", 0) for w in "abcdefghijklmnop"]
    rows += [("the same long text again and again idiot", 1), ("the same long text again and again friend", 0)]
    model = T.learn(spark.createDataFrame(rows * 3, "text string, label int"))
    assert model.weight("friend") is None
    assert T.learn(spark.createDataFrame([], "text string, label int")).words == {}
