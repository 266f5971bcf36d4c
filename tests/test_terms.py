"""Packed terms and their pairs against plain loops."""

import math
import random
from collections import Counter

import pytest

from tallyloom.operators import dedup as D, terms as P


def corpus():
    dice = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    heads = [[dice.choice(words) for _ in range(14)] for _ in range(12)]
    texts = [" ".join(w if dice.random() < 0.85 else dice.choice(words) for w in dice.choice(heads)) for _ in range(90)]
    return [(i, 2 + i % 2, t) for i, t in enumerate([*texts, "", None, "w1", "only here"])]


def plain(rows):
    grams = {i: Counter([*w, *map(" ".join, zip(w, w[1:]))]) for i, _, t in rows if (w := (t or "").split())}
    df = Counter(t for g in grams.values() for t in g)
    out = {}
    for i, g in grams.items():
        w = {t: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, c in g.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / norm for t, x in w.items() if df[t] >= 2}
    return out


@pytest.mark.parametrize("few", [1000, 3])
def test_packed_terms_and_their_pairs(spark, monkeypatch, few):
    """With three documents a place, groups of neighbours are split; tables of one row for each document move, none for each term."""
    monkeypatch.setattr(P, "PLACE_DOCS", few)
    monkeypatch.setattr(P, "COUNTED_TERMS", 40 if few == 3 else 1 << 20)
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, tache int, text string").repartition(3)
    want = plain(rows)
    v = D.packed_weights(docs)
    got = {r.id: r for r in v.collect()}
    assert set(got) == {i for i, w in want.items() if w}
    for i, r in got.items():
        assert sorted(r.ws) == pytest.approx(sorted(want[i].values())) and r.dfs == sorted(r.dfs)
    tache = {i: t for i, t, _ in rows}
    pairs = {}
    for a in want:
        for b in want:
            if a < b and tache[a] == tache[b] and (s := sum(x * want[b].get(t, 0) for t, x in want[a].items())) >= 0.4:
                pairs[a, b] = s
    assert len(pairs) > 100
    for given in (v, D.term_weights(docs)):
        found = {(r.a_id, r.b_id): r.score for r in D.cosine_pairs(given, 0.4).collect()}
        assert found == pytest.approx(pairs)
    assert D.cosine_pairs(v.filter("id < 0"), 0.4).collect() == []


def test_pairs_of_little_but_a_rare_term_are_not_scored_whole(spark, monkeypatch):
    """Documents that share a rare term come together by it; whole vectors move for the near ones only."""
    terms = {i: {min(i, j) * 100 + max(i, j) for k in range(1, 11) for j in ((i + k) % 40, (i - k) % 40)} for i in range(40)}
    terms |= {100 + i: set(terms[i]) for i in range(3)}
    df = Counter(t for x in terms.values() for t in x)
    rows = [(i, 2, t, df[t], len(x) ** -0.5) for i, x in terms.items() for t in x]
    want = {(a, b): s for a, x in terms.items() for b, y in terms.items() if a < b and (s := len(x & y) / math.sqrt(len(x) * len(y))) >= 0.55}
    seen = {}
    scored, bounded = P._scored, P._likely
    monkeypatch.setattr(P, "_likely", lambda met, *a: (seen.update(met=met.count()), bounded(met, *a))[1])
    monkeypatch.setattr(P, "_scored", lambda met, *a: (seen.update(scored=met.count()), scored(met, *a))[1])
    vectors = spark.createDataFrame(rows, "id long, tache int, term long, df long, w double")
    found = {(r.a_id, r.b_id): r.score for r in D.cosine_pairs(vectors, 0.55).collect()}
    assert len(want) == 3 and found == pytest.approx(want)
    assert seen["met"] > 50 and seen["scored"] == 3


@pytest.mark.parametrize("name", ["lay_06", "lay_07"])
def test_fingerprints_of_the_layers_are_computed_once(spark, name):
    """What these queries read several times is a written table, without the text functions behind it."""
    from tallyloom.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan or "Scan parquet" in plan
    assert "sha2(" not in plan


def test_ids_are_assigned_from_written_fingerprints(spark, monkeypatch):
    from tallyloom.plans import q_dedup

    seen, assign = [], q_dedup.L.assign_ids
    monkeypatch.setattr(q_dedup.L, "assign_ids", lambda rows, known: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), assign(rows, known))[1])
    assert q_dedup.stable_ids(spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 2 and not any("sha2(" in plan for plan in seen)


@pytest.mark.parametrize("most", [1000, 2])
def test_pairs_meet_both_documents_without_a_shuffle_of_these(spark, monkeypatch, most):
    """A document with a pair to each other one is read where it lies; broadcast blocks of two documents give the same."""
    import pyarrow as pa

    from tallyloom.operators.materialize import materialize

    rows = materialize(spark.range(12).selectExpr("id", "array(id, id + 100) AS terms"))
    pairs = materialize(spark.createDataFrame([(0, k) for k in range(1, 12)] + [(k, 11) for k in range(1, 6)], "a_id long, b_id long"))

    def told(batches):
        for t in batches:
            yield pa.record_batch([t["a_id"], t["b_id"], pa.array([x[1] * 1000 + y[0] for x, y in zip(t["a_terms"].to_pylist(), t["b_terms"].to_pylist())], pa.int64())], ["a_id", "b_id", "both"])

    plans = []
    write = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a, **k))[1])
    out = P._side_by_side(pairs, rows, P.F.size("terms") * 8, most, told, "a_id long, b_id long, both long", "told").collect()
    want = {(0, k) for k in range(1, 12)} | {(k, 11) for k in range(1, 6)}
    assert sorted((r.a_id, r.b_id, r.both) for r in out) == sorted((a, b, (a + 100) * 1000 + b) for a, b in want)
    assert len(plans) == (3 if most == 2 else 1)
    assert not any(line.strip(" :+-*()0123456789").startswith(("SortMergeJoin", "ShuffledHashJoin")) for p in plans for line in p.splitlines())


def test_second_documents_are_laid_out_once_for_a_run(monkeypatch):
    """With eight slots terms collide: products stay exact, bounds are never too low, and a run's document is laid out once."""
    import numpy as np

    monkeypatch.setattr(P, "SLOTS", 8)
    dice = np.random.default_rng(8)
    docs = [(np.sort(dice.choice(60, n, replace=False)), dice.random(n)) for n in (0, 1, 5, 20, 40, 7)]
    pairs = [(a, b) for b in range(6) for a in range(6)]
    flat = lambda side, k: np.concatenate([docs[p[side]][k] for p in pairs])
    ends = lambda side: np.append(0, np.cumsum([len(docs[p[side]][0]) for p in pairs]))
    run = P._runs(np.array([b for _, b in pairs]))
    assert run == [(6 * k, 6 * k + 6) for k in range(6)]
    want = [sum(dict(zip(*docs[a])).get(t, 0) * w for t, w in zip(*docs[b])) for a, b in pairs]
    given = (run, flat(0, 0), flat(1, 0), flat(0, 1), flat(1, 1), ends(0), ends(1))
    assert P._products(*given).tolist() == pytest.approx(want)
    assert (P._bounds(*given) >= np.array(want) - 1e-5).all()
