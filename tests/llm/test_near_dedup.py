import random
import re
from collections import defaultdict

import pytest

from tallyloom.llm.near_dedup import near_duplicates, op2_near_dedup
from tests_data import SF


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, k, num, den):
    """Every pair that shares a shingle is compared."""
    sets, where, parent = sets_of(texts, k), defaultdict(list), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = defaultdict(int)
    for n, s in enumerate(sets):
        for g in s:
            for m in where[g]:
                common[m, n] += 1
            where[g].append(n)
    for (m, n), c in common.items():
        if den * c >= num * (len(sets[m]) + len(sets[n]) - c):
            x, y = sorted((find(ids[m]), find(ids[n])))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, k, num):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute([r.doc_id for r in rows], [r.text for r in rows], k, num, 100)
    got = near_duplicates(docs, words=k, num=num, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    ids = list(range(300))
    got = near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), words=3, num=85)
    want = brute(ids, texts, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_long_common_passage(spark):
    """Texts that share 87 % with all others, a little below the threshold; some pairs share a little more."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, n = new(435), 2000
    own = [new(65) for _ in range(n)]
    for i in range(60):
        own[n - 1 - 7 * i][-15:] = own[3 * i][-15:]
    texts = [" ".join(passage + w) for w in own]
    want = {i: i for i in range(n)} | {n - 1 - 7 * i: 3 * i for i in range(60)}
    sets = sets_of(texts, 5)
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    some = range(0, n, 40)
    assert all(alike(i, c) for i, c in want.items()) and not any(alike(i, j) for i in some for j in range(n) if want[i] != want[j])
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5, num=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n\t", 9), (4, "One two", 9), (5, "one TWO", 9), (None, "one two", 9), (6, "a b c d", 9), (6, "a b c d", 9), (7, "É b c d", 9), (8, "é b c d", 9), (9, "x " * 200_000, 9)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long"), words=3, num=85).collect()
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True), (7, 2, 7, True), (8, 2, 8, True), (9, 1, 9, True)]


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    assert op2_near_dedup(spark, SF).columns == ["doc_id", "n_shingles", "component_id", "kept"]
