"""The pipeline end to end, held against what each stage has to do."""

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute
from tests_data import SF
from tokenizers import Tokenizer

from tallyloom.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, run) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        run(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_do_their_work(spark, stages):
    first = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    clean, lean, single, plain = map(rows_of, stages[:4])
    model = toxicity.fitted(spark, SF)
    scan = toxicity.scanner(model)
    assert set(clean) == {i for i, r in first.items() if toxicity.combine(model, scan(r.text or "")) < corpus_pipeline.TOXIC}
    assert set(lean) == set(clean) and all(set((r.text or "").split("\n")) <= set((clean[i].text or "").split("\n")) for i, r in lean.items())
    groups = brute(list(lean), [r.text for r in lean.values()], 5, 80, 100)
    assert set(single) == {i for i in lean if groups[i][1] == i}
    assert set(plain) == set(single) and all(r.n_chars == len(r.text) for r in plain.values())
    assert not any("@mail" in r.text for r in plain.values())


def test_packed_ids(stages):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts, packed = rows_of(stages[3]), stages[4].toPandas()
    assert set(packed["doc_id"]) == set(texts)
    for i, part in packed.sort_values("piece").groupby("doc_id"):
        assert [t for x in part["ids"] for t in x] == [*tokenizer.encode(texts[i].text, add_special_tokens=False).ids, 0]
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 2048


def test_run_is_the_stages(spark, stages):
    run = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*cols).collect())) == sorted(map(tuple, stages[4].select(*cols).collect()))
