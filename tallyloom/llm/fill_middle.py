"""Fill-in-the-middle: texts cut into prefix, middle and suffix and laid out anew (operator 13).

A batch of texts is one run of bytes. Its token ends and the hashes of its ids give every text two
cuts. Where a byte goes is its place plus the shift of its part; shifts change at the parts'
borders only, so a difference array of those changes, summed up, gives every byte its shift, and
one scatter builds all outputs of the batch. Restoring finds the marks in an output and gathers
the bytes back through shifts made in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.common import bounded_batches, documents

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3  #: bytes of a mark
FORMS = ["plain", "psm", "spm"]
PLAIN, PSM, SPM = range(3)
BLOCK_BYTES = 4_000_000  #: laid out at once, if no single text is longer
FIM = "struct<form:string,n:bigint,prefix_chars:bigint,middle_chars:bigint,output:string>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.full(256, -1, np.int8)
for _i, _mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
    _LETTER[_mark[1]] = _i


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)).cast(pa.string())


def _blocks(sizes: np.ndarray) -> list[slice]:
    """Runs of rows of BLOCK_BYTES together; a longer text is alone."""
    ends, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK_BYTES:
            ends.append(i)
            held = 0
        held += n
    return [slice(a, b) for a, b in zip(ends, [*ends[1:], len(sizes)])]


def _marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every mark inside a text: its place, its text, and which of the three it is."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    place = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & (_LETTER[data[1:-1]] >= 0))
    text = np.searchsorted(at, place, "right") - 1
    inside = place + MARK <= at[text + 1]
    return place[inside], text[inside], _LETTER[data[place[inside] + 1]]


def _shifts(begins: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """The shift of each of n bytes, from the places where parts begin, in order, and the parts' shifts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, np.diff(shifts, prepend=0))
    return np.cumsum(change[:n])


def _token_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token ends, and for each text how many lie before it and in it. A token is a word with the blanks before it, or the blanks at the end."""
    blank = _SPACE[data]
    stop = np.ones(len(data), bool)
    stop[:-1] = blank[1:]
    last = at[1:][np.diff(at) > 0] - 1
    stop[last] = True
    end = stop & ~blank
    end[last] = True
    ends = np.flatnonzero(end) + 1
    before = np.searchsorted(ends, at, "right")
    return ends, before[:-1], np.diff(before)


def _lay_out(data: np.ndarray, at: np.ndarray, h: np.ndarray, fim_rate: int, spm_rate: int) -> tuple:
    """Forms, token counts, characters of prefix and middle, output bytes and their borders."""
    ends, before, n = _token_ends(data, at)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    begin, end = at[:-1], at[1:]

    def cut(k: np.ndarray) -> np.ndarray:
        return np.where(k == 0, begin, ends[np.maximum(before + k - 1, 0)]) if len(ends) else begin

    b, c = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    form = np.where(h[2] % 100 >= fim_rate, PLAIN, np.where(h[3] % 100 < spm_rate, SPM, PSM))
    form[end == begin] = PLAIN
    form[_marks(data, at)[1]] = PLAIN
    plain, spm = form == PLAIN, form == SPM
    out_at = np.concatenate([[0], np.cumsum(end - begin + np.where(plain, 0, 3 * MARK))])
    home, pre, mid, suf = out_at[:-1], b - begin, c - b, end - c
    # where each part's first byte goes: prefix, middle, suffix
    to = np.stack([
        np.where(plain, home, np.where(spm, home + 2 * MARK + suf, home + MARK)),
        np.where(plain, home + pre, home + 3 * MARK + pre + suf),
        np.where(plain, home + pre + mid, np.where(spm, home + MARK, home + 2 * MARK + pre)),
    ], axis=1)
    begins = np.stack([begin, b, c], axis=1)
    out = np.empty(out_at[-1], np.uint8)
    out[np.arange(len(data)) + _shifts(begins.ravel(), (to - begins).ravel(), len(data))] = data
    for column, mark in enumerate((PREFIX, MIDDLE, SUFFIX)):
        for i, letter in enumerate(mark):
            out[to[~plain, column] - MARK + i] = letter
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return form, n, chars[b] - chars[begin], chars[c] - chars[b], out, out_at


def _put_back(data: np.ndarray, at: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts from which outputs were made. An output that isn't plain has each mark once, and its first bytes are one."""
    place, text, which = _marks(data, at)
    real = ~plain[text]
    mark = np.repeat(at[:-1, None], 3, axis=1)
    mark[text[real], which[real]] = place[real]
    p, s, m = mark.T
    end = at[1:]
    psm = p < s
    pre, mid, suf = np.where(psm, s, m) - p - MARK, end - m - MARK, np.where(psm, m, p) - s - MARK
    pre, mid, suf = np.where(plain, end - at[:-1], pre), np.where(plain, 0, mid), np.where(plain, 0, suf)
    back_at = np.concatenate([[0], np.cumsum(pre + mid + suf)])
    begins = back_at[:-1, None] + np.stack([np.zeros_like(pre), pre, pre + mid], axis=1)
    source = np.stack([np.where(plain, at[:-1], p + MARK), m + MARK, s + MARK], axis=1)
    source = np.where(plain[:, None], source[:, :1] + begins - begins[:, :1], source)
    n = back_at[-1]
    return data[np.arange(n) + _shifts(begins.ravel(), (source - begins).ravel(), n)], back_at


def cut_hashes(doc_id: str, seed: str = "42") -> Column:
    """The first four 8-digit groups of the sha256 of `seed:doc_id`, as an array of numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: str = "42", fim_rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `fim`: form, n tokens, prefix_chars, middle_chars, output.

    The cuts follow from seed, id and text alone, so repeated rows give equal outputs, whatever the
    partitioning. Null texts count as empty; empty texts and texts that hold a mark stay plain, and
    of the rest all but `fim_rate` in a hundred. Very long texts are laid out alone. An empty table
    gives an empty one. Other columns stay; one named `fim` is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(FIM)
    def lay_out(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        data, at = _bytes_of(texts)
        h = np.asarray(hashes.flatten()).reshape(-1, 4).T
        parts = []
        for rows in _blocks(np.diff(at)):
            mine = at[rows.start : rows.stop + 1]
            form, n, pre, mid, out, out_at = _lay_out(data[mine[0] : mine[-1]], mine - mine[0], h[:, rows], fim_rate, spm_rate)
            none = form == PLAIN
            fields = [pa.array(np.array(FORMS)[form]), pa.array(n, pa.int64()), pa.array(pre, pa.int64(), mask=none), pa.array(mid, pa.int64(), mask=none), _strings(out, out_at)]
            parts.append(pa.StructArray.from_arrays(fields, ["form", "n", "prefix_chars", "middle_chars", "output"]))
        return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]

    return docs.withColumn("fim", lay_out(text_col, cut_hashes(id_col, seed)))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text from which `output` of `form` was made."""

    @F.arrow_udf("string")
    def put_back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        data, at = _bytes_of(outputs)
        plain = np.asarray(forms.to_pylist()) == FORMS[PLAIN]
        parts = []
        for rows in _blocks(np.diff(at)):
            mine = at[rows.start : rows.stop + 1]
            parts.append(_strings(*_put_back(data[mine[0] : mine[-1]], mine - mine[0], plain[rows])))
        return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]

    return put_back(output, form)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 13: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    made = made.select("doc_id", "fim.*").withColumn("restored", restored("output", "form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The contract in SQL: tokens are matches of the pattern, cuts are joined lists of them.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, len(toks) AS n, least(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS lo, greatest(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS hi,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
    p AS (SELECT *, array_to_string(toks[1:lo], '') AS pre, array_to_string(toks[lo + 1:hi], '') AS mid, array_to_string(toks[hi + 1:n], '') AS suf FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
