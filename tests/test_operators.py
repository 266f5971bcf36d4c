import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import chunks as K, dedup as D, html as H, knn as N, labels as L, layers as Y
from tallyloom.sources.tables import stamp


def brute_linkage(nodes, edges, cap):
    member = {n: {n} for n in nodes}
    linked = {(a, b) for a, b, _ in edges}
    refused = []
    for s, a, b in sorted((-s, a, b) for a, b, s in edges):
        x, y = member[a], member[b]
        if x is y:
            continue
        if any((min(p, q), max(p, q)) not in linked for p in x for q in y):
            refused.append((a, b, "veto"))
        elif len(x) + len(y) > cap:
            refused.append((a, b, "size_cap"))
        else:
            x |= y
            for m in y:
                member[m] = x
    return {n: min(g) for n, g in member.items()}, sorted(refused)


def test_complete_linkage_equals_the_global_fold(spark):
    rng = random.Random(1)
    edges = []
    for base in range(0, 60, 6):
        for a in range(base, base + 6):
            for b in range(a + 1, base + 8):
                if rng.random() < 0.7:
                    edges.append((a, b, round(rng.random(), 2)))
    nodes = spark.range(70).withColumnRenamed("id", "id")
    clusters, refused = D.complete_linkage(nodes, spark.createDataFrame(edges, "a_id long, b_id long, score double"), 4)
    want, want_refused = brute_linkage(range(70), edges, 4)
    assert {r.id: r.cluster for r in clusters.collect()} == want
    assert sorted((r.a_id, r.b_id, r.reason) for r in refused.collect()) == want_refused
    single = {r.id: r.cluster for r in D.single_linkage(nodes, spark.createDataFrame(edges, "a_id long, b_id long, score double")).collect()}
    assert all(single[n] == single[c] for n, c in want.items())


def test_banding_refuses_crossed_bars(spark):
    with pytest.raises(ValueError):
        D.banded(spark.createDataFrame([(1, 2, 0.5)], "a_id long, b_id long, score double"), 0.9, 0.5)


@pytest.mark.parametrize(("block", "fan", "parts"), [(50_000, 256, 3), (7, 3, 4), (5, 2, 1), (1, 4, 9)])
def test_budgeted_batches_are_greedy_in_one_order(spark, block, fan, parts):
    rng = random.Random(block)
    rows = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 9), 0, 150])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, t int").withColumn("kept", F.lit("own")).repartition(parts)
    got = K.budgeted_batches(df, ["i"], "t", 5, 100, block, fan).collect()
    batches, n, total, want = 0, 0, 0, {}
    for i, t in rows:
        if n and (n >= 5 or total + t > 100):
            batches, n, total = batches + 1, 0, 0
        want[i] = batches
        n, total = n + 1, total + t
    assert {r.i: r.batch for r in got} == want and {r.kept for r in got} == {"own"}
    assert K.budgeted_batches(df.filter("i < 0"), ["i"], "t", 5, 100).collect() == []


@pytest.mark.parametrize(
    ("reply", "answers"),
    [
        ({"items": [{"n": 3, "answer": "c"}, {"n": 1, "answer": "a"}, {"n": 2, "answer": "b"}]}, {10: "a", 11: "b", 12: "c"}),
        ({"items": [{"n": 1, "answer": "a"}, {"n": 2, "answer": "b"}]}, {}),
        ({"items": [{"n": 1, "answer": "a"}, {"n": 1, "answer": "b"}, {"n": 2, "answer": "c"}]}, {}),
        ({"items": [{"n": 0, "answer": "a"}, {"n": 1, "answer": "b"}, {"n": 2, "answer": "c"}]}, {}),
        ({"other": []}, {}),
        ("not json", {}),
        (None, {}),
        ({"items": [{"answer": "a"}, {"n": 2, "answer": "b"}, {"n": 3, "answer": "c"}]}, {}),
        ({"items": [{"n": 1}, {"n": 2, "answer": "b"}, {"n": 3, "answer": "c"}]}, {}),
        ({"items": [{"n": 1, "answer": "a"}, {"n": 2, "answer": "b"}, {"n": 3, "answer": "x"}, {"n": 3, "answer": "c"}]}, {10: "a", 11: "b", 12: "c"}),
    ],
)
def test_reply_alignment(spark, reply, answers):
    rows = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 1, 3)], "id long, chunk int, n int")
    text = reply if reply is None or isinstance(reply, str) else json.dumps(reply)
    replies = spark.createDataFrame([(1, text)], "chunk int, reply string")
    assert {r.id: r.answer for r in K.align_replies(rows, replies, ["chunk"]).collect()} == answers


PAGE = """<html><header>Tâche 9</header><h2>Tâche 2</h2><h3>Partie 4</h3><p>Sujet 1</p><p><b>Je suis votre ami. Posez-moi des questions<br>(prix, horaires, etc.).</b></p>
<p><strong>Another long bold text that must not be read as a question again.</strong></p><p>Sujet 2</p><p><strong>Je suis votre vois</strong><strong>in(e). Vous me demandez des conseils.</strong></p>
<h2>Tâche 3</h2><p><b>No subject is armed here, so this long bold text is no question.</b></p><h3>Partie 1</h3><p>Sujet 1</p><p><b>À votre avis, faut-il voyager pour apprendre une langue ?</b></p>
<script>var x = "<p>Sujet 5</p>";</script><p>Mentions légales</p><p>Sujet 7</p><p><b>After the footer nothing counts, however long the bold text is.</b></p></html>"""


def test_marked_page(spark):
    found = H.questions(H.block_texts(H.html_nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")))).collect()
    assert sorted((r.tache, r.partie, r.sujet, r.text) for r in found) == [
        (2, 4, 1, "Je suis votre ami. Posez-moi des questions (prix, horaires, etc.)."),
        (2, 4, 2, "Je suis votre voisin(e). Vous me demandez des conseils."),
        (3, 1, 1, "À votre avis, faut-il voyager pour apprendre une langue ?"),
    ]


def test_pushed_json_in_two_pieces(spark):
    whole = json.dumps({"x": 1, "parties": [{"partie": 1, "sujets": [{"tache": 2, "text": 'say "]" é'}, {"tache": 9, "text": "no"}, {"tache": 2, "text": "second"}]}, {"partie": 2, "sujets": [{"tache": 3, "text": "third"}]}]}, ensure_ascii=False, separators=(",", ":"))
    calls = "".join(f"<script>self.__next.push([1,{json.dumps(part)}])</script>" for part in (whole[:40], whole[40:]))
    pages = spark.createDataFrame([(1, calls), (2, "<p>none</p>")], "page_id long, html string")
    cut = H.bracket_slice(H.pushed_payload(F.col("html")), F.lit("parties"))
    rows = H.nested_questions(pages.withColumn("p", F.from_json(cut, H.PARTIES)), F.col("p")).collect()
    assert sorted((r.partie, r.tache, r.sujet, r.text) for r in rows) == [(1, 2, 1, 'say "]" é'), (1, 2, 2, "second"), (2, 3, 1, "third")]


def test_knn_rejects_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "f_id long, embedding array<double>")
    assert [(r.q_id, r.f_id) for r in N.exact_knn(v, v, 3).orderBy("q_id").collect()] == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="different length"):
        N.exact_knn(v, v, 3, dim=3).collect()


def test_merge_chains_end_at_one_label(spark):
    bank = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "f_id long, subject_id int")
    merges = spark.createDataFrame([(7, 6), (6, 5)], "src int, dst int")
    assert sorted((r.f_id, r.subject_id) for r in L.merge_labels(bank, merges).collect()) == [(1, 5), (2, 5), (3, 5), (4, 8)]


def test_prune_is_blocked_as_a_whole(spark):
    have, wanted, used = (spark.createDataFrame(x, "name string") for x in ([("a",), ("b",), ("c",)], [("a",), ("d",)], [("c",)]))
    diff = L.vocab_diff(wanted, have, used, ["name"])
    assert sorted((r.name, r.action) for r in diff.collect()) == [("b", "orphaned"), ("c", "blocked"), ("d", "add")]
    assert L.prune_allowed(diff).first().allowed is False


def test_upsert_keeps_labels_and_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (3, 7, None)], "k int, n int, label string")
    new = spark.createDataFrame([(1, 5), (2, 9), (4, 1)], "k int, n int")
    once = Y.apply_upsert(new, old, ["k"], ["n"])
    assert sorted((r.k, r.n, r.label) for r in once.collect()) == [(1, 5, "x"), (2, 9, "y"), (3, 7, None), (4, 1, None)]
    actions = {r.action for r in Y.upsert_actions(new, once, ["k"], ["n"]).collect()}
    assert actions == {"unchanged", "stale"}


def test_score_distribution_counts_unlisted_pairs(spark):
    pairs = spark.createDataFrame([(0.5,), (0.25,), (1.0,)], "score double")
    got = D.score_distribution(pairs, 4).first()
    assert (got.pairs, got.p50, got.min, got.max) == (6, 0.125, 0.0, 1.0)


def test_links_keep_to_the_host(spark):
    html = """<a href="https://ex.com.evil.net/news">x</a><a class='c' href='/tips'>x</a><a href="https://EX.com/news">x</a><a href="about">x</a><a href="//ex.com/help">x</a>
        <a href="mailto:me@ex.com">x</a><a href="#top">x</a><a href="/tips">again</a><a data-href="/hidden">x</a>"""
    pages = spark.createDataFrame([(1, "https://ex.com/a", html), (2, "https://ex.com", '<a href="plan">x</a>')], "page_id long, url string, html string")
    got = sorted((r.page_id, r.slug, r.url) for r in H.links(pages, r"^https?://[^/]+/([a-z]{3,})$").collect())
    assert got == [(1, "about", "https://ex.com/about"), (1, "help", "https://ex.com/help"), (1, "news", "https://EX.com/news"), (1, "tips", "https://ex.com/tips"), (2, "plan", "https://ex.com/plan")]


def test_chunks_of_a_hot_group(spark):
    rows = [(i, "a" if i % 5 else None) for i in range(500)]
    got = K.grouped_chunks(spark.createDataFrame(rows, "id long, g string"), 20, ["g"], ["id"]).collect()
    want, seen = {}, {}
    for i, g in rows:
        k = seen[g] = seen.get(g, -1) + 1
        want[i] = (k // 20 + 1, k % 20 + 1)
    assert {r.id: (r.chunk, r.n) for r in got} == want


def test_members_say_what_the_records_hold(spark):
    """Rows for each member and each near pair are the arrays of the records, exploded; a cluster of one has no others."""
    rows = [("c1", 1, "a", "f1", "One?", "2024-01", "s"), ("c1", 2, "b", "f1", "One?", "2024-02", "t"), ("c1", 3, "c", "f2", "one two", "2024-01", "s"), ("c2", 4, "d", "f3", "Other.", "", "s")]
    df = spark.createDataFrame(rows, "cluster string, doc_id long, id string, fp string, text string, period string, source string")
    members = {(r.canonical_id, r.id, r.kind) for r in D.cluster_members(df).collect()}
    expected = set()
    for r in D.canonical_records(df).collect():
        expected |= {(r.id, r.id, "canonical")} | {(r.id, x, "exact" if x in r.exact_duplicate_ids else "duplicate") for x in r.duplicate_ids}
    assert members == expected and len(members) == 4
    assert {r.id for r in D.cluster_members(df).filter("variant").collect()} == {"c"}
    assert D.cluster_members(df.filter("false")).collect() == []
    review = spark.createDataFrame([("a", "d"), ("c", "d"), ("a", "c")], "a_id string, b_id string")
    near = D.near_duplicate_pairs(review, df.select("cluster", "id"), D.canonical_heads(df)).collect()
    assert sorted((r.id, r.near_id) for r in near) == [("b", "d"), ("d", "b")]


def test_stamp_follows_the_files(spark, tmp_path):
    """The stamp of a table changes with its files, and only with them."""
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    first = stamp(spark, str(tmp_path), "t")
    assert stamp(spark, str(tmp_path), "t") == first
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert stamp(spark, str(tmp_path), "t") != first


def test_bold_runs_without_text_count_as_in_sql(spark, tmp_path):
    """Blank and null texts are blocks too; a page without any text has no length, one whose source is null no id."""
    from oracle import connect, same
    from tallyloom.plans.registry import ORACLE, QUERIES

    texts = ["a  b", "", "  \t", None, "<b>&amp;</b>", None, "x"]
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate(zip(texts, ["s", "s", "t", "u", "u", "v", None]))] + [(600, "y z", "fr", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["htm_03"](spark, str(tmp_path)), connect(tmp_path), ORACLE["htm_03"])
