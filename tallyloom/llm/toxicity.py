"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Tokens get classes (insult, target, person as an object, negator, reporting verb, modal, threat verb). Two transducers
read the classes of one clause and rewrite them: negation marks insults and threat verbs within its
scope, reported speech those after a reporting verb. Two acceptors read what they write: abuse
takes an insult near a target or near another insult, threat a threat verb and a person near it as its
object, more surely behind a modal; a thing that is burnt or killed is no threat. Arcs have weights, so distance and order count, and negated or reported
words weigh little. The four are composed into one weighted machine; a clause scores the best path
that the machine accepts. An insult alone accepts nothing: it counts as half of a match, and of all that stand alone in a text
only the strongest counts, unless another clause's match is within REACH tokens: insults that follow each
other so speak together. A document's score is the noisy-or of what counts.

The insult lexicon is learned: Spark counts, over a bounded sample of labelled documents, in how
many toxic and clean documents each word and each word beginning of 5 to 8 letters occurs, and
keeps those whose share of toxic documents can't be chance and holds in both halves of the sample;
the share is their weight.
A beginning must be that of several toxic words, none of which has most of its documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.common import bounded_batches, documents, fold, labels, training_rows
from tallyloom.operators.materialize import materialize

WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;:\n\r…]+")

# Closed word classes of the four languages of the corpus.
TARGETS = frozenset("you your yours yourself he she him her they them u tu toi vous te il elle eux du dich dir ihr euch sie ihn tú usted ustedes él ella ellos vosotros".split())
PERSONS = frozenset("you yourself him her them u toi vous eux sie usted ustedes él ella ellos".split())
OBJECTS = frozenset("te dich dir euch ihn".split())  #: persons that may stand before their verb
NEGATORS = frozenset("not never no none nobody isn aren wasn don doesn didn without pas jamais ne ni aucun nicht kein keine keinen nie niemals nunca jamás ningún sin".split())
REPORTERS = frozenset("said says say saying wrote writes called calls quoted quote according claimed claims reported dit disait écrit selon appelé sagte sagt schrieb nannte laut dijo dice escribió según llamó".split())
MODALS = frozenset("will ll gonna going shall want should vais va allons veux werde wird will werden voy vamos quiero".split())
# Stems of threat verbs and the endings they take.
THREATS = frozenset(
    stem + ending
    for stems, endings in (
        ("kill murder hurt burn shoot hang stab stabb destroy strangl", "|s|e|es|ed|ing|er"),
        ("tu frapp brûl détrui", "e|er|es|ez|ent|rai|ra|re|s"),
        ("töt erschlag verbrenn erwürg vernicht", "e|en|st|t|et|est"),
        ("mat golpe quem destru", "o|a|as|ar|aré|ará|an|ir|yo|iré"),
    )
    for stem in stems.split()
    for ending in endings.split("|")
)

INSULT, TARGET, NEGATOR, REPORTER, MODAL, THREAT, OTHER, PERSON, OBJECT = range(9)
CLASSES = 9
ANYONE = (TARGET, PERSON, OBJECT)
NEGATED, REPORTED = 1, 2  #: what the transducers mark a class with
STEM_LENGTHS = range(5, 9)
SAMPLE_BOUND = 20_000  #: labelled training documents at most
PURITY = 0.35  #: least share of toxic documents among those with a lexicon entry; the share is its weight
STEM_WORDS = 3  #: toxic words that support a beginning at least
STEM_SHARE = 0.7  #: of a beginning's toxic documents that its commonest word may have
NEGATION_SCOPE = 3  #: tokens after a negator that it reaches
NEARBY = 5  #: tokens within which insult and target, or modal and threat verb, belong together
PILED = 8  #: tokens within which a second insult counts as abuse
OBJECT_NEAR = 3  #: tokens within which a threat verb and the person it aims at belong together
LONE = 0.5  #: of an insult that no path accepts
REACH = 100  #: tokens within which matches of several clauses belong together
NEGATION_WEIGHT, REPORT_WEIGHT = 0.15, 0.3

Symbol = tuple[int, int]  #: class and marks


@dataclass(frozen=True)
class Arc:
    to: int
    weight: float = 1.0
    mark: str = ""
    out: Symbol | None = None  #: what a transducer writes; an acceptor writes nothing


@dataclass(frozen=True)
class Machine:
    """States are ints, 0 at a clause's start. `arcs(state, symbol)` are the ways on; `finals` the accepting states."""

    arcs: Callable[[int, Symbol], list[Arc]]
    finals: frozenset[int] = frozenset()


def negation() -> Machine:
    """State: how many tokens ahead are still within a negator's scope."""

    def arcs(state: int, symbol: Symbol) -> list[Arc]:
        if symbol[0] == NEGATOR:
            return [Arc(NEGATION_SCOPE, out=symbol)]
        hit = state > 0 and symbol[0] in (INSULT, THREAT)
        return [Arc(max(0, state - 1), out=(symbol[0], symbol[1] | NEGATED) if hit else symbol)]

    return Machine(arcs)


def reported() -> Machine:
    """State 1 once a reporting verb was read; what follows is someone else's word."""

    def arcs(state: int, symbol: Symbol) -> list[Arc]:
        if symbol[0] == REPORTER:
            return [Arc(1, out=symbol)]
        hit = state and symbol[0] in (INSULT, THREAT)
        return [Arc(state, out=(symbol[0], symbol[1] | REPORTED) if hit else symbol)]

    return Machine(arcs)


def _said(symbol: Symbol) -> float:
    """Weight of reading an insult or threat verb with its marks."""
    return (NEGATION_WEIGHT if symbol[1] & NEGATED else 1.0) * (REPORT_WEIGHT if symbol[1] & REPORTED else 1.0)


def _named(mark: str, symbol: Symbol) -> str:
    return mark + "-negated" * bool(symbol[1] & NEGATED) + "-reported" * bool(symbol[1] & REPORTED)


def abuse() -> Machine:
    """An insult after a target (strong, weaker with distance), before one, or soon after another insult.

    States: 0, DONE, 1 to NEARBY (tokens since a target that is waiting for its insult), and behind
    them tokens since an insult that is waiting, up to PILED.
    """
    done, since_insult = 1 + NEARBY + PILED, NEARBY

    def arcs(state: int, symbol: Symbol) -> list[Arc]:
        if state == done:
            return [Arc(done)]
        ways = []
        if state == 0:
            ways.append(Arc(0))
            if symbol[0] in ANYONE:
                ways.append(Arc(1))
            if symbol[0] == INSULT:
                ways.append(Arc(since_insult + 1, _said(symbol), _named("insult", symbol)))
        elif state <= NEARBY:
            if symbol[0] == INSULT:
                ways.append(Arc(done, _said(symbol) * (1.0 - 0.04 * (state - 1)), _named("target>insult", symbol)))
            if state < NEARBY:
                ways.append(Arc(state + 1))
        else:
            gap = state - since_insult
            if symbol[0] in ANYONE and gap <= NEARBY:
                ways.append(Arc(done, 0.9 - 0.05 * (gap - 1), ">target"))
            if symbol[0] == INSULT:
                ways.append(Arc(done, 0.9 * _said(symbol), _named(">insult", symbol)))
            if gap < PILED:
                ways.append(Arc(state + 1))
        return ways

    return Machine(arcs, frozenset([done]))


def threat() -> Machine:
    """A threat verb and then a person, more surely if a modal comes before; or a person as an object and then a threat verb.

    States: 0, DONE, then tokens since a modal, since a verb, since a verb behind a modal, and since an object.
    """
    modal, verb, meant, object_, done = 0, NEARBY, NEARBY + OBJECT_NEAR, NEARBY + 2 * OBJECT_NEAR, NEARBY + 3 * OBJECT_NEAR + 1

    def arcs(state: int, symbol: Symbol) -> list[Arc]:
        if state == done:
            return [Arc(done)]
        ways = []
        if state == 0:
            ways.append(Arc(0))
            if symbol[0] == MODAL:
                ways.append(Arc(modal + 1))
            if symbol[0] == OBJECT:
                ways.append(Arc(object_ + 1))
            if symbol[0] == THREAT:
                ways.append(Arc(verb + 1, _said(symbol), _named("threat", symbol)))
        elif state <= verb:
            if symbol[0] == THREAT:
                ways.append(Arc(meant + 1, _said(symbol) * (1.0 - 0.05 * (state - 1)), _named("modal>threat", symbol)))
            if state < verb:
                ways.append(Arc(state + 1))
        elif state <= object_:
            behind, gap = (meant, state - meant) if state > meant else (verb, state - verb)
            if symbol[0] in (PERSON, OBJECT):
                ways.append(Arc(done, (0.95 if behind == meant else 0.85) - 0.1 * (gap - 1), ">target"))
            if gap < OBJECT_NEAR:
                ways.append(Arc(state + 1))
        else:
            gap = state - object_
            if symbol[0] == THREAT:
                ways.append(Arc(done, _said(symbol) * (0.9 - 0.1 * (gap - 1)), _named("target>threat", symbol)))
            if gap < OBJECT_NEAR:
                ways.append(Arc(state + 1))
        return ways

    return Machine(arcs, frozenset([done]))


def cascade(first: Machine, second: Machine) -> dict[tuple, list[tuple]]:
    """All arcs of `second` reading what `first` writes: (states, symbol) to (states, weight, mark, written)."""
    todo, seen, out = [(0, 0)], {(0, 0)}, {}
    symbols = [(c, 0) for c in range(CLASSES)]
    while todo:
        at = todo.pop()
        for s in symbols:
            ways = [((a.to, b.to), a.weight * b.weight, a.mark + b.mark, b.out) for a in first.arcs(at[0], s) for b in second.arcs(at[1], a.out)]
            out[at, s] = ways
            for to, *_ in ways:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return out


@lru_cache(1)
def grammar() -> tuple[dict[tuple[int, int], list[tuple[int, float, str]]], frozenset[int]]:
    """The composed machine: (state, class) to (state, weight, mark), and its accepting states."""
    rewriting = cascade(negation(), reported())
    number: dict[tuple, int] = {}
    arcs: dict[tuple[int, int], list[tuple[int, float, str]]] = {}
    finals = set()
    todo = []

    def state(key: tuple) -> int:
        if key not in number:
            number[key] = len(number)
            todo.append(key)
        return number[key]

    machines = (abuse(), threat())
    start = state((-1, (0, 0), 0))
    assert start == 0
    while todo:
        key = todo.pop()
        which, at, inner = key
        if which >= 0 and inner in machines[which].finals:
            finals.add(number[key])
        for c in range(CLASSES):
            ways = arcs.setdefault((number[key], c), [])
            for to, w, mark, written in rewriting[at, (c, 0)]:
                for m in range(len(machines)) if which < 0 else [which]:  # the start state belongs to both
                    for arc in machines[m].arcs(inner, written):
                        ways.append((state((m, to, arc.to)), w * arc.weight, mark + arc.mark))
    return arcs, frozenset(finals)


def best_path(classes: list[int]) -> tuple[float, str]:
    """Weight and marks of the best accepted path over a clause's classes; (0, "") if none is accepted."""
    arcs, finals = grammar()
    reach: dict[int, tuple[float, str]] = {0: (1.0, "")}
    for c in classes:
        onward: dict[int, tuple[float, str]] = {}
        for at, (w, marks) in reach.items():
            for to, weight, mark in arcs[at, c]:
                got = (w * weight, marks + mark)
                if to not in onward or got > onward[to]:
                    onward[to] = got
        reach = onward
    return max((v for k, v in reach.items() if k in finals), default=(0.0, ""))


@dataclass
class ToxicityModel:
    """Weights are shares of toxic documents in 0 to 1."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    paths: dict[str, float] = field(default_factory=dict)
    base: float = 0.02

    def weight(self, token: str) -> float | None:
        """Of an insult, by the word itself or else its longest known beginning; None for other words."""
        if (w := self.words.get(token)) is not None:
            return w
        for n in range(min(len(token), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
            if (w := self.stems.get(token[:n])) is not None:
                return w
        return None

    def path_weight(self, path: str) -> float:
        """Of accepted paths that are neither negated nor reported as learned; of others 1, their arcs say enough."""
        return self.paths.get(path, 0.95 if ">" in path and "-" not in path else 1.0)


def scanner(model: ToxicityModel) -> Callable[[str], list[tuple[str, float]]]:
    """A function that gives a text's matched clauses as (path, weight); a lone insult's path is `insult`, or `insults` where another match is near."""
    first = {w[:3] for w in (*model.words, *model.stems, *THREATS)}
    short = {w for w in model.words if len(w) < 3}

    def classed(token: str) -> tuple[int, float]:
        if (w := model.weight(token)) is not None:
            return INSULT, w
        if token in THREATS:
            return THREAT, 1.0
        if token in NEGATORS:
            return NEGATOR, 0.0
        if token in OBJECTS:
            return OBJECT, 0.0
        if token in PERSONS:
            return PERSON, 0.0
        if token in TARGETS:
            return TARGET, 0.0
        if token in REPORTERS:
            return REPORTER, 0.0
        return (MODAL, 0.0) if token in MODALS else (OTHER, 0.0)

    def scan(text: str) -> list[tuple[str, float]]:
        low = text.lower()
        maybe = {t for t in WORD.findall(low) if t[:3] in first or t in short}
        hits = {t for t in maybe if t in THREATS or model.weight(t) is not None}
        if not hits:
            return []
        found: list[tuple[str, float]] = []
        spans: list[tuple[int, int]] = []
        begin = end = 0
        for clause in CLAUSE.split(low):
            tokens = WORD.findall(clause)
            begin, end = end, end + len(tokens)
            if hits.isdisjoint(tokens):
                continue
            read = [classed(t) for t in tokens]
            strongest = max(w for _, w in read)
            weight, path = best_path([c for c, _ in read])
            lone = 0.0
            if any(c == INSULT for c, _ in read):
                said = best_lone([c for c, _ in read])
                lone = LONE * said * strongest
            whole = weight * min(strongest, model.path_weight(path)) if path else 0.0
            if max(whole, lone) > 0:
                found.append((path, whole) if whole >= lone else ("insult", lone))
                said_at = [begin + i for i, (c, _) in enumerate(read) if c in (INSULT, THREAT)]
                spans.append((said_at[0], said_at[-1]))
        for i, (path, weight) in enumerate(found):
            near = (i > 0 and spans[i][0] - spans[i - 1][1] <= REACH) or (i + 1 < len(found) and spans[i + 1][0] - spans[i][1] <= REACH)
            if path == "insult" and near:
                found[i] = "insults", weight
        return found

    return scan


def best_lone(classes: list[int]) -> float:
    """Weight of the insult that is least negated or reported, by the two transducers."""
    rewriting, at, best = _rewriting(), (0, 0), 0.0
    for c in classes:
        at, _, _, written = rewriting[at, (c, 0)][0]
        if written[0] == INSULT:
            best = max(best, _said(written))
    return best


@lru_cache(1)
def _rewriting() -> dict[tuple, list[tuple]]:
    return cascade(negation(), reported())


def combine(model: ToxicityModel, clauses: list[tuple[str, float]]) -> float:
    """Noisy-or of the clauses; of insults that stand alone only the strongest."""
    left = (1.0 - model.base) * (1.0 - max((w for p, w in clauses if p == "insult"), default=0.0))
    for path, weight in clauses:
        if path != "insult":
            left *= 1.0 - min(0.995, weight)
    return 1.0 - left


def _features(text: str) -> set[str]:
    """`word$` and `stem` features of one text."""
    out = set()
    for t in set(WORD.findall(text.lower())):
        if not t.isdigit():
            out.add(t + "$")
            out.update(t[:n] for n in STEM_LENGTHS if n <= len(t))
    return out


def _count_features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each feature: toxic and clean of both halves of the sample."""
    counts = [Counter() for _ in range(4)]
    for b in batches:
        for text, label, half in zip(b["text"], b["label"], b["half"]):
            counts[2 * int(half) + (0 if label else 1)].update(_features(text))
    keys = list(set().union(*counts))
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pd.DataFrame({"feature": part} | {n: [c[k] for k in part] for n, c in zip(("a0", "b0", "a1", "b1"), counts)})


def _sketch(texts: pd.Series) -> pd.Series:
    """One MinHash value of a text's word pairs: near copies mostly share it, so that they don't pass for evidence."""

    def one(text: str) -> int:
        w = WORD.findall(text.lower())
        return min((zlib.crc32(f"{a} {b}".encode()) * 0x9E3779B97F4A7C15 + len(a) >> 8) & 0xFFFFFFFFFFFFFF for a, b in zip(w, w[1:])) if len(w) > 1 else zlib.crc32(text.encode())

    return texts.map(one)


def _supported(counts: DataFrame) -> DataFrame:
    """`(feature, words, most)` of beginnings: how many toxic words have it, and the documents of the commonest of them."""
    words = counts.filter(F.col("feature").endswith("$") & (F.col("a") >= 1) & (F.col("a") > F.col("b"))).select(F.expr("left(feature, length(feature) - 1)").alias("word"), "a")
    lengths = F.sequence(F.lit(STEM_LENGTHS[0]), F.least(F.length("word"), F.lit(STEM_LENGTHS[-1])))
    beginnings = words.filter(F.length("word") >= STEM_LENGTHS[0]).select("a", F.explode(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))).alias("feature"))
    return beginnings.groupBy("feature").agg(F.count("*").alias("words"), F.max("a").alias("most"))


def learn(rows: DataFrame) -> ToxicityModel:
    """A model from `(text, label)` rows, at most SAMPLE_BOUND of them; of near copies with one label one is used.

    Without toxic or without clean rows the model is empty and scores every text alike. Null texts
    must be given as empty ones.
    """
    bounded_batches(rows.sparkSession)
    sketched = rows.select("text", "label", F.pandas_udf(_sketch, "long")("text").alias("sketch"))
    rows = materialize(sketched.groupBy("sketch", "label").agg(F.min("text").alias("text")).select("text", "label", F.pmod("sketch", F.lit(2)).cast("int").alias("half")), "training")
    n_toxic, n_all = rows.agg(F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0)), F.count("*")).first()
    model = ToxicityModel(base=0.5 / (n_all - n_toxic + 1) if n_toxic else 0.02)
    if not n_toxic or n_toxic == n_all:
        return model
    rate = n_toxic / n_all
    halves = rows.mapInPandas(_count_features, "feature string, a0 long, b0 long, a1 long, b1 long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")])
    counts = materialize(halves.withColumn("a", F.col("a0") + F.col("a1")).withColumn("b", F.col("b0") + F.col("b1")), "features")
    # An entry has at least four toxic documents, two in each half, and evidence beyond chance: the log
    # likelihood ratio against the base rate exceeds the log of the features that were tried.
    least = math.log(max(1, counts.filter("a + b >= 3").count())) + 1
    share = F.col("a") / (F.col("a") + F.col("b"))
    gain = F.col("a") * F.log(share / rate) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    pure = lambda a, b: (F.col(a) >= 2) & (F.col(a) >= (PURITY - 0.1) * (F.col(a) + F.col(b)))
    kept = counts.filter((share >= PURITY) & (gain >= least) & pure("a0", "b0") & pure("a1", "b1"))
    several = _supported(counts).filter((F.col("words") >= STEM_WORDS))
    kept = kept.join(several, "feature", "left").filter(F.col("feature").endswith("$") | (F.col("most") <= STEM_SHARE * F.col("a")))
    for feature, a, b in kept.select("feature", "a", "b").collect():  # bounded: made of SAMPLE_BOUND texts
        (model.words if feature.endswith("$") else model.stems)[feature.rstrip("$")] = (a + 1.0) / (a + b + 1.2)
    scan = scanner(model)

    def count_paths(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                seen.update({(p, int(label)) for p, _ in scan(text)})
        yield pd.DataFrame([(p, l, n) for (p, l), n in seen.items()], columns=["path", "label", "n"])

    by_path: dict[str, list[int]] = {}
    for path, label, n in rows.mapInPandas(count_paths, "path string, label int, n long").groupBy("path", "label").agg(F.sum("n")).collect():  # a few paths
        by_path.setdefault(path, [0, 0])[min(1, label)] += n
    model.paths = {p: (a + 2 * model.path_weight(p)) / (a + b + 2) for p, (b, a) in by_path.items() if ">" in p and "-" not in p}
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """`docs` with `toxicity`: struct of score (0 to 1), clauses (how many matched) and path (the strongest clause's).

    A null text is scored as an empty one, which has no clause and so the base score. Every text is
    read whole, every row scored by itself, so repeated rows score alike; an empty table gives an
    empty one. All other columns stay, whatever their names; a column `toxicity` is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("score double, clauses int, path string")
    def scored(texts: pd.Series) -> pd.DataFrame:
        scan, rows = scanner(model), []
        for t in texts:
            found = scan(t) if t else []
            top = max(found, key=lambda x: x[1])[0] if found else None
            rows.append((combine(model, found), len(found), top))
        pa.default_memory_pool().release_unused()  # the worker lives on and does other work
        return pd.DataFrame(rows, columns=["score", "clauses", "path"])

    return docs.withColumn("toxicity", scored(text_col))


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> ToxicityModel:
    """Learned from the labelled rows of `sf_dir` whose crc32 remainder by 3 isn't 1."""
    docs = documents(spark, sf_dir) if docs is None else docs
    return learn(training_rows(docs, labels(spark, sf_dir), "toxic", fold("doc_id", 3) != 1, SAMPLE_BOUND))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 1: doc_id, held_out, score, predicted, clauses, path."""
    scored = score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), fitted(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"),
        F.col("toxicity.clauses").alias("clauses"),
        F.col("toxicity.path").alias("path"),
    )
