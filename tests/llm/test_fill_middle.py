"""Fill-in-the-middle against a version with plain strings."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from odd import EXTRA, nothing, table

from tallyloom.llm import fill_middle as M

TOKENS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    toks = TOKENS.findall(text)
    n = len(toks)
    assert "".join(toks) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return "plain", n, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(toks[:a]), "".join(toks[a:b]), "".join(toks[b:])
    if h4 % 100 < 80:
        return "spm", n, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return "psm", n, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(rows, got):
    want = sorted(map(str, ((i, *plainly(i, t), t or "") for i, t in rows)))
    assert sorted(map(str, got)) == want


def test_random_texts(spark):
    dice = random.Random(5)
    bits = [" ", "\n", "\t", "\x0b", "a", "é", "😀", "<", "P>", "<P", ">", "S", "<M>", "word", "\xa0", "<S>", "\x00"]
    rows = [(i, "".join(dice.choices(bits, k=dice.randrange(12)))) for i in range(3000)]
    df = M.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", M.restored("fim.output", "fim.form"))
    got = [(r.doc_id, r.fim.form, r.fim.n, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output, r.back) for r in df.collect()]
    assert {g[1] for g in got} == set(M.FORMS)
    check(rows, got)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in table(spark).collect()]
    out = M.fill_in_middle(table(spark)).withColumn("back", M.restored("fim.output", "fim.form"))
    got = out.collect()
    check(rows, [(r.doc_id, r.fim.form, r.fim.n, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output, r.back) for r in got])
    assert all(r[c] == (None if i % 2 else f"own {c}") for r in got for i, c in enumerate(EXTRA))
    assert M.fill_in_middle(nothing(spark)).collect() == []


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_blocks_of_any_size_lay_out_alike(size):
    dice = np.random.default_rng(3)
    texts = ["x y" * int(k) for k in dice.integers(0, 30, 50)]
    data, at = M._bytes_of(pa.array(texts))
    old, M.BLOCK_BYTES = M.BLOCK_BYTES, size
    try:
        blocks = M._blocks(np.diff(at))
        assert [i for b in blocks for i in range(b.start, b.stop)] == list(range(50))
        assert all(at[b.stop] - at[b.start] <= size or sum(np.diff(at[b.start : b.stop + 1]) > 0) == 1 for b in blocks)
    finally:
        M.BLOCK_BYTES = old
