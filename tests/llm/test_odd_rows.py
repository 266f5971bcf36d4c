"""Every operator and stage on odd rows and on an empty table."""

import corpus_pipeline
import pytest
from odd import EXTRA, ROWS, nothing, table
from pyspark.sql import functions as F
from tests_data import SF

from tallyloom.llm import bpe, edit_fingerprint, line_dedup, near_dedup, packing, pii, quality_cnn, quality_rules, sharding, toxicity

KEEPING = {
    "toxicity": lambda df: toxicity.score_toxicity(df, toxicity.ToxicityModel(words={"one": 0.9})),
    "lines": line_dedup.dedup_lines,
    "pii": pii.find_pii,
    "shards": sharding.shuffle_to_shards,
    "rules": quality_rules.clean_lines,
    "cnn": lambda df: quality_cnn.score_quality(df, quality_cnn.ByteCNN.new()),
}
REDUCING = {
    "near": near_dedup.near_duplicates,
    "fingerprint": edit_fingerprint.edit_fingerprints,
    "bpe": bpe.round_trip,
    "pieces": packing.pieces_of,
    "packed": lambda df: packing.pack_pieces(packing.pieces_of(df)),
}


@pytest.mark.parametrize("name", [*KEEPING, *REDUCING])
def test_every_row_gives_a_row(spark, name):
    got = (KEEPING | REDUCING)[name](table(spark)).collect()
    ids = sorted(str(r.doc_id) for r in got if getattr(r, "piece", 0) == 0)
    assert ids == sorted(str(i) for i, _ in ROWS)
    if name in KEEPING:
        assert all(r[c] == (None if i % 2 else f"own {c}") for r in got for i, c in enumerate(EXTRA))


@pytest.mark.parametrize("name", [*KEEPING, *REDUCING])
def test_no_rows_give_none(spark, name):
    assert (KEEPING | REDUCING)[name](nothing(spark)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = table(spark).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")}).select(*corpus_pipeline.COLUMNS)
    out = run(spark, docs, SF)
    got = out.collect()
    if stage < 4:
        assert out.columns == corpus_pipeline.COLUMNS
        want = sorted(str(i) for i, t in ROWS)
        if name == "near_dedup":
            want = sorted(str(i) for i, t in ROWS if (i, t) not in ((5, ROWS[4][1]), (7, ROWS[9][1])))
        assert sorted(str(r.doc_id) for r in got) == want
        texts = {(r.doc_id, r.text) for r in got}
        if name != "pii":
            assert texts <= {(i, t) for i, t in ROWS} and (1, None) in texts and (2, "") in texts
        else:
            assert (10, "Mail [EMAIL] or [PHONE], [IP], [CARD]") in texts and (1, None) in texts
    else:
        assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(i) for i, _ in ROWS)
        assert all(len(r.ids) == r.length for r in got)
    assert run(spark, docs.filter("doc_id = -1"), SF).count() == 0


def test_models_without_rows(spark):
    rows = spark.createDataFrame([], "text string, label int")
    assert toxicity.learn(rows).words == {}
    assert quality_cnn.learn(rows).probability(quality_cnn.ByteCNN.new().pooled(*quality_cnn.chunked(""))) > 0.5


def test_results_of_odd_rows(spark):
    q = {r.doc_id: r.quality for r in quality_rules.clean_lines(table(spark)).filter("doc_id is not null").collect()}
    assert (q[1].n_words, q[2].n_words, q[3].word_chars, q[6].n_words) == (0, 0, 0, 80_000) and q[6].n_repeat_words == 80_000 and not q[1].kept
    p = {r.doc_id: r.pii for r in pii.find_pii(table(spark)).filter("doc_id = 10").collect()}
    assert [(s.kind, s.start, s.end) for s in p[10].base] == [("email", 5, 13), ("phone", 17, 34), ("ip", 36, 44), ("card", 46, 65)]
