"""Text functions of the corpus as Column expressions, so that they stay inside code generation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.batches import bounded_batches

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# What the normal form replaces.
QUOTE_FROM, QUOTE_TO = "’ʼ`«»“”–—", "'''\"\"\"\"--"
LEAD = r"(?i)^\s*(question|sujet)\s*[0-9]*\s*[:.\-]\s*"


def normalize_text(c: Column) -> Column:
    """Straight quotes and dashes, single blanks, no blank before ?!:;, no leading `question N:`, no outer quotes.

    Text outside NFC is to be composed before, with `composed()`.
    """
    t = F.regexp_replace(F.translate(c, QUOTE_FROM, QUOTE_TO), "…", "...")
    t = F.regexp_replace(F.regexp_replace(t, SPACE + "+", " "), " +([?!:;])", "$1")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, LEAD, "")), "^[\"']+|[\"']+$", ""))


@lru_cache(1)
def accent_table() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one of a-z or 0-9 and marks, and those."""
    pairs = []
    for n in range(0x80, 0x10000):
        base = [x for x in unicodedata.normalize("NFD", chr(n)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] in "abcdefghijklmnopqrstuvwxyz0123456789":
            pairs.append((chr(n), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(1)
def combining_marks() -> str:
    """Every character of a combining class other than 0."""
    return "".join(chr(n) for n in range(0x300, 0x110000) if unicodedata.combining(chr(n)))


def without_accents(c: Column) -> Column:
    """Accented letters as letters, and no combining mark of any script: one pass, since what `translate` has no partner for goes."""
    letters, plain = accent_table()
    return F.translate(c, letters + combining_marks(), plain)


def flatten_accents(c: Column) -> Column:
    """normalize_text(), lower case, accents gone: what the exact and the weighted tier both read."""
    return without_accents(F.lower(normalize_text(c)))


def fingerprint(c: Column) -> Column:
    """sha256 of the flattened text's letters, digits and blanks."""
    return F.sha2(F.regexp_replace(flatten_accents(c), "[^a-z0-9 ]", ""), 256)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(flatten_accents(c), F.lit("[a-z0-9]+"), F.lit(0))


GONE = 1  #: what letters() gives for a combining mark
_LETTER_HASH = np.random.default_rng(5).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_HASH = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE = 1 << 18  #: of texts whose words are hashed together
_BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
_LEAD_WORDS = re.compile(rf"{_BLANK}(?:question|sujet){_BLANK}[0-9]*{_BLANK}[:.\-–—…]", re.ASCII | re.IGNORECASE)


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point what word_tokens() makes of it: the code of a letter or digit, GONE for a combining mark, 0 for what parts words."""
    plain = dict(zip(*accent_table())) | dict.fromkeys(combining_marks(), "")
    out = np.zeros(0x110000, np.uint8)
    out[[ord(c) for c in combining_marks()]] = GONE
    for n in range(0x10000):
        made = "".join(plain.get(c, c) for c in chr(n).lower())
        if len(made) == 1 and made in "abcdefghijklmnopqrstuvwxyz0123456789":
            out[n] = ord(made)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values whose bits all depend on all bits of `h`; distinct ones stay distinct."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed_together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts])
    kinds = letters()[np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")]
    at = np.flatnonzero(kinds != GONE)
    kinds = kinds[at]
    inside = kinds != 0
    begin = inside & ~np.append(False, inside[:-1])[: len(inside)]
    doc = np.searchsorted(ends, at[begin], "right")
    kinds, begin = kinds[inside], np.flatnonzero(begin[inside])
    if not len(begin):
        return np.zeros(0, np.uint64), doc
    sizes = np.diff(np.append(begin, len(kinds)))
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max()) - 1, _PLACE_HASH, np.uint64)))
    place = np.arange(len(kinds)) - np.repeat(begin, sizes)
    return mixed(np.add.reduceat(_LETTER_HASH[kinds] * powers[place], begin)), doc


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each of the texts' word_tokens(), in order, and the number of its text. Null texts have none.

    A word's hash sums up one of each letter times a power of an odd number for its place, all texts of a
    chunk at once; word_tokens() takes several passes and a string for each word.
    """
    found, held, size, first = [], [], 0, 0
    for k, t in enumerate(texts):
        t = t or ""
        lead = _LEAD_WORDS.match(t)
        held.append(t[lead.end() :] if lead else t)
        size += len(t) + 1
        if size >= CHARS_AT_ONCE:
            h, doc = _hashed_together(held)
            found.append((h, doc + first))
            held, size, first = [], 0, k + 1
    if held:
        h, doc = _hashed_together(held)
        found.append((h, doc + first))
    hashes, docs = zip(*found) if found else ((), ())
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *docs])


def ngram_hashes(h: np.ndarray, doc: np.ndarray, upto: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ngrams() by those of the words and the numbers of their texts: the words', then those of runs of 2 to `upto`."""
    all_h, all_doc, run = [h], [doc], h
    for n in range(2, upto + 1):
        run = mixed(run[:-1] * _PLACE_HASH + h[n - 1 :])
        same = doc[: len(run)] == doc[n - 1 :]
        all_h.append(run[same])
        all_doc.append(doc[: len(run)][same])
    return np.concatenate(all_h), np.concatenate(all_doc)


def ngrams(words: Column, upto: int = 2) -> Column:
    """The words, then all runs of 2 to `upto` of them joined by a blank."""
    out = words
    for n in range(2, upto + 1):
        last = F.greatest(F.size(words) - n + 1, F.lit(0))
        out = F.concat(out, F.transform(F.slice(words, 1, last), lambda _, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))  # noqa: B023
    return out


def label_key(c: Column) -> Column:
    """Label names as they are looked up: straight apostrophes, single blanks, case folded."""
    return F.replace(F.lower(F.trim(F.regexp_replace(F.translate(c, "’", "'"), SPACE + "+", " "))), F.lit("ß"), F.lit("ss"))


def answer_key(c: Column) -> Column:
    """The looser key of model answers: outer blanks and case only."""
    return F.replace(F.lower(F.trim(c)), F.lit("ß"), F.lit("ss"))


def deaccent_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(without_accents(F.lower(c)), "[^a-z0-9]+", " "))


# French month names and their spellings in addresses.
MONTHS = {
    "janvier": 1, "junvier": 1, "janv": 1, "jan": 1, "fevrier": 2, "fevr": 2, "fev": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6,
    "juillet": 7, "juil": 7, "jui": 7, "aout": 8, "septembre": 9, "sept": 9, "sep": 9, "octobre": 10, "oct": 10, "novembre": 11, "nov": 11, "decembre": 12, "dec": 12,
}


def month_number(name: Column) -> Column:
    """1 to 12 of a month name in any case or accent; null for other words."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.try_element_at(table, deaccent_slug(name))


def compose_id(source: Column, period: Column, tache: Column, partie: Column, sujet: Column) -> Column:
    """13 digits: source 2, year 4, month 2, task 1, part 2, subject 2."""
    return F.format_string("%02d%s%s%d%02d%02d", source.cast("int"), F.substring(period, 1, 4), F.substring(period, 6, 2), tache.cast("int"), partie.cast("int"), sujet.cast("int"))


def parse_id(c: Column) -> Column:
    """The struct that compose_id() was given; null for other than 13 digits."""
    part = lambda a, n: F.substring(c, a, n).cast("int")
    period = F.concat(F.substring(c, 3, 4), F.lit("-"), F.substring(c, 7, 2))
    return F.when(c.rlike("^[0-9]{13}$"), F.struct(part(1, 2).alias("source_no"), period.alias("period"), part(9, 1).alias("tache"), part(10, 2).alias("partie"), part(12, 2).alias("sujet")))


# Fixed value: what may lead a line as decoration.
LEADING_MARKS = r"^[\s\x{2022}\x{2023}\x{25aa}-\x{25ff}\x{2190}-\x{21ff}\x{2600}-\x{27bf}\x{1f000}-\x{1faff}\x{fe0f}]+"


def clean_decoration(c: Column) -> Column:
    """Without leading bullets, arrows and emoji; inner arrows become colons; single blanks."""
    t = F.regexp_replace(F.translate(c, "\u00a0", " "), LEADING_MARKS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*\x{2192}\s*", " : "), SPACE + "+", " "))


# How requests, wishes and roles begin.
STRONG = r"(?i)((?:vous\s+me\s+(?:demandez|posez)|(?:posez|demandez)-moi)[^.]*)"
WEAK = r"(?i)(vous\s+(?:voulez|souhaitez|cherchez)[^.]*)"
ROLE = r"(?i)^(\s*(?:je\s+suis|je\s+travaille|je\s+viens)\b[^.]*)"


def breakdown_slots(c: Column) -> Column:
    """Struct of role, task, hints (array) and situation; each null (hints: empty) where the text has none.

    The task is the last explicit request, else the last wish; the hints are the last parenthesis;
    the situation is every sentence that holds no beginning of role or task.
    """
    last = lambda pattern, group: F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))
    role = F.nullif(F.regexp_extract(c, ROLE, 1), F.lit(""))
    task = F.coalesce(last(STRONG, 1), last(WEAK, 1))
    inner = last(r"\(([^)]*)\)", 1)
    hints = F.coalesce(F.transform(F.split(inner, ","), lambda x: F.trim(x)), F.array().cast("array<string>"))
    sentences = F.filter(F.transform(F.split(c, r"(?<=\.)\s+"), lambda s: F.trim(s)), lambda s: s != "")
    heads = F.array_compact(F.array(F.substring(F.trim(role), 1, 30), F.substring(F.trim(task), 1, 30)))
    left = F.array_join(F.filter(sentences, lambda s: ~F.exists(heads, lambda h: F.contains(s, h))), " ")
    return F.struct(F.trim(role).alias("role"), F.trim(task).alias("task"), hints.alias("hints"), F.nullif(left, F.lit("")).alias("situation"))


def period_year(c: Column) -> Column:
    return F.substring(c, 1, 4).cast("int")


def period_month(c: Column) -> Column:
    return F.substring(c, 6, 2).cast("int")


def snippet(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def clipped_label(c: Column, n: int = 200) -> Column:
    """Trimmed, cut to n, null if nothing is left."""
    return F.nullif(F.substring(F.trim(c), 1, n), F.lit(""))


def token_estimate(c: Column) -> Column:
    """About three characters a token and eight more for each text."""
    return (F.floor(F.length(c) / 3) + 8).cast("int")


def composed(df: DataFrame, col: str = "text") -> DataFrame:
    """`df` with `col` in NFC. Only rows with characters that NFC may change go through Python."""
    odd = F.coalesce(F.col(col).rlike(r"[\x{300}-\x{200f}\x{2028}-\x{10ffff}]"), F.lit(False))

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return df.filter(~odd).unionByName(df.filter(odd).withColumn(col, nfc(col)))


DIFF_OPS = 20_000  #: ops that a task hands over at once
DIFF_ROWS = 256  #: rows of the table that are held at once, and between those that are remembered


def _common_steps(p: np.ndarray, q: np.ndarray) -> Iterator[str]:
    """The steps `=`, `-` and `+` of a longest common subsequence, a deletion first where both gain alike.

    The table of lengths is computed from its end, row by row; every DIFF_ROWS-th row is remembered
    and the rows between are computed again on the way back, so long texts need little memory.
    """

    def row_before(i: int, after: np.ndarray) -> np.ndarray:
        gain = np.where(q == p[i], after[1:] + 1, after[:-1])
        return np.append(np.maximum.accumulate(gain[::-1])[::-1], 0)

    held = {len(p): np.zeros(len(q) + 1, np.int32)}
    row = held[len(p)]
    for i in reversed(range(len(p))):
        row = row_before(i, row)
        if i % DIFF_ROWS == 0:
            held[i] = row
    j = 0
    for begin in range(0, len(p), DIFF_ROWS):
        end = min(begin + DIFF_ROWS, len(p))
        rows = [held[end]]
        for i in reversed(range(begin, end)):
            rows.append(row_before(i, rows[-1]))
        rows.reverse()
        i = begin
        while i < end:
            if j < len(q) and p[i] == q[j]:
                i, j = i + 1, j + 1
                yield "="
            elif j == len(q) or rows[i + 1 - begin][j] >= rows[i - begin][j + 1]:
                i += 1
                yield "-"
            else:
                j += 1
                yield "+"
    yield from "+" * (len(q) - j)


def word_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    """`df` with `diff`: ops (`=`, `-`, `+`) and tokens of the longest common subsequence of two texts.

    Tokens are words and the white space between them; on equal gain a deletion comes first.
    """
    cut = re.compile(r"(\s+)")

    def ops(x: str, y: str) -> list[dict]:
        p, q = [t for t in cut.split(x or "") if t], [t for t in cut.split(y or "") if t]
        names = {t: k for k, t in enumerate(dict.fromkeys([*p, *q]))}
        kept = _common_steps(np.array([names[t] for t in p], np.int64), np.array([names[t] for t in q], np.int64))
        out, i, j = [], 0, 0
        for step in kept:
            out.append({"op": step, "tok": q[j] if step == "+" else p[i]})
            i, j = i + (step != "+"), j + (step != "-")
        return out

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            begin, diffs, size = 0, [], 0
            for n, (x, y) in enumerate(zip(d[a], d[b])):
                diffs.append(ops(x, y))
                size += len(diffs[-1])
                if size >= DIFF_OPS or n + 1 == len(d):
                    yield d.iloc[begin : n + 1].assign(diff=diffs)
                    begin, diffs, size = n + 1, [], 0

    bounded_batches(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, diff array<struct<op:string,tok:string>>")
