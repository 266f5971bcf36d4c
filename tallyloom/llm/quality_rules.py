"""Quality rules with line-first cleaning (operator 8), in DataFrame functions only.

Every line is judged by itself: by its symbols, marks and letters, as a fragment without a closing
mark, as navigation, as boilerplate and as shouting. Lines that fail are removed; a document that
loses too much of its text is rejected. Base measures of the whole text (repeated three-word windows and the like) are computed
within the row by sorting window hashes, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.common import documents, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MAX_LOSS = 0.3  #: a document that loses a larger share of its word characters is rejected
MIN_WORDS = 50
FEW = 50  #: repeated windows up to which each window is looked up among them

# Phrases of navigation and boilerplate lines, in the four languages of the corpus.
PHRASES = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|accept (all )?cookies|javascript is (disabled|required)|enable javascript|lorem ipsum|powered by|licensed under|released under the"
    "|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|wir verwenden cookies"
    "|tous droits réservés|conditions d.utilisation|politique de confidentialité|nous utilisons des cookies"
    "|todos los derechos reservados|términos de uso|política de privacidad|utilizamos cookies"
)
LINKS = (
    "home|menu|login|log in|sign (in|up)|search|next|previous|back to top|read more|share|contact( us)?|about( us)?|subscribe|skip to content"
    "|startseite|menü|anmelden|suche|weiter|zurück|nach oben|mehr lesen|kontakt|über uns"
    "|accueil|connexion|recherche|suivant|précédent|retour en haut|lire la suite|à propos"
    "|inicio|menú|iniciar sesión|buscar|siguiente|anterior|volver arriba|leer más|contacto|sobre nosotros"
)
BOILERPLATE, NAVIGATION = f"(?iu)({PHRASES})", f"(?iu)^({LINKS})$"
SEPARATED = "([|»›>•·] ?[^|»›>•·]{1,30} ?){3}"
MARKS = "!?¡¿"
CLOSED = r"[.!?…:;,\"'»”)\]]\s*$"  #: how a line ends that isn't a fragment
FRAGMENT_WORDS = 3  #: of a line without a closing mark at most
PHRASE_CHARS = 120  #: a line with a phrase for each so many characters is boilerplate


def _length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def _without_space(c: Column) -> Column:
    """Blanks go by a plain replacement, which is much faster than a pattern; the pattern then finds little."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), SPACE, "")


def _count(c: Column, chars: str) -> Column:
    """How many of the characters a string holds; strings without any are told by a search."""
    return F.when(c.rlike("[" + chars.replace("|", r"\|") + "]"), F.length(c) - F.length(F.translate(c, chars, ""))).otherwise(0)


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    found = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """How many words of the array lie in a three-word window that occurs twice or more.

    Windows are compared by a 64-bit hash. Of the sorted positions of repeated windows each covers
    three words, less what the next covers.
    """
    hashes = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, lambda w: let(hashes(w), _covered)))


def _covered(hashes: Column) -> Column:
    """Sorting finds the repeated hashes. If they are few, their places are looked for; else `(hash, place)` is sorted."""
    repeated = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i + 1))))
    few = lambda d: F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(d, h), i)))
    places = let(repeated, lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, few(d)).otherwise(_places(hashes)))
    return let(places, _cover_three)


def _places(hashes: Column) -> Column:
    """The sorted places of hashes that occur twice, in n log n."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = lambda s, i: F.when(i > 0, F.get(s, i - 1)["h"])
    after = lambda s, i: F.get(s, i + 1)["h"]
    hit = let(pairs, lambda s: F.transform(s, lambda p, i: F.when((p["h"] == before(s, i)) | (p["h"] == after(s, i)), p["i"])))
    return F.array_sort(F.array_compact(hit))


def _cover_three(at: Column) -> Column:
    """Positions covered by runs of three from each of the sorted positions."""
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)


def line_fails(line: Column) -> Column:
    """Whether the rules remove a line (with a word). Marks, letters and capitals count against its length, so short lines may hold a few."""
    return let(_without_space(line), lambda bare: _bare_fails(line, bare))


def _bare_fails(line: Column, bare: Column) -> Column:
    n = F.length(bare)
    upper = F.length(F.regexp_replace(bare, r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(bare, r"\P{L}+", ""))
    odd = line.rlike(r"[#*$%&|<>!?¡¿»›•·]")  # one search lets plain lines pass the rules about marks
    fragment = ~line.rlike(CLOSED) & (F.size(F.split(F.trim(line), SPACE, FRAGMENT_WORDS + 1)) <= FRAGMENT_WORDS)
    return (
        odd & ((_count(bare, SYMBOLS) * 20 > n) | (_count(bare, MARKS) * 20 > n + 40) | line.rlike(SEPARATED))
        | let(letters, lambda k: (k * 2 < n - 10) | (upper * 2 > k + 20))
        | fragment
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * PHRASE_CHARS > n)
    )


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `quality`, a struct of base measures, the cleaned text and the verdict.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text,
    n_removed (lines), removed_chars (of words) and kept. kept is false if base_failed, or if the
    removed lines hold over MAX_LOSS of the word characters. Null texts count as empty: no words,
    base_failed. Blank lines are never removed. Every row is judged by itself, so repeated rows are
    judged alike; an empty table gives an empty one. Other columns stay; a column quality is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    step = docs.withColumn("quality", F.struct(words_of(text).alias("words"), F.split(text, "\n", -1).alias("lines")))
    step = step.withColumn(
        "quality",
        F.struct(
            F.size("quality.words").cast("long").alias("n_words"),
            _length(_without_space(text)).cast("long").alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(F.filter("quality.lines", solid), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("quality.words")).cast("long").alias("n_repeat_words"),
            F.transform("quality.lines", lambda x: F.struct(x.alias("line"), (solid(x) & line_fails(x)).alias("bad"))).alias("lines"),
        ),
    )
    q = F.col("quality")
    base_failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    of = lambda bad: F.transform(F.filter(q["lines"], lambda x: x["bad"] == F.lit(bad)), lambda x: x["line"])
    any_bad = F.exists(q["lines"], lambda x: x["bad"])
    lost = F.when(any_bad, F.length(_without_space(F.array_join(of(True), "")))).otherwise(0)
    return step.withColumn(
        "quality",
        F.struct(
            *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            base_failed.alias("base_failed"),
            F.when(any_bad, F.array_join(of(False), "\n")).otherwise(text).alias("clean_text"),
            F.when(any_bad, F.size(of(True))).otherwise(0).alias("n_removed"),
            lost.cast("long").alias("removed_chars"),
            (~base_failed & (lost <= MAX_LOSS * q["word_chars"])).alias("kept"),
        ),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 8."""
    out = clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed", "removed_chars")
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names])


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
s AS (SELECT doc_id, line, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS bare, pos FROM l),
j AS (
  SELECT doc_id, line, bare, length(bare) AS n, length(bare) - length(translate(bare, '{SYMBOLS}', '')) AS sym,
    length(bare) - length(translate(bare, '!?¡¿', '')) AS marks,
    length(regexp_replace(bare, '[^\p{{Lu}}]', '', 'g')) AS upper, length(regexp_replace(bare, '[^\p{{L}}]', '', 'g')) AS letters
  FROM s WHERE bare <> ''),
f AS (
  SELECT doc_id, line, n, (sym * 20 > n) OR (marks * 20 > n + 40) OR (letters * 2 < n - 10) OR (upper * 2 > letters + 20)
    OR (NOT regexp_matches(line, '{CLOSED.replace("'", "''")}') AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= {FRAGMENT_WORDS})
    OR regexp_matches(line, '(?i)^({LINKS})$') OR regexp_matches(line, '{SEPARATED}') OR len(regexp_extract_all(line, '(?i)({PHRASES})')) * {PHRASE_CHARS} > n AS bad FROM j),
g AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_removed, coalesce(sum(n) FILTER (bad), 0) AS removed_chars FROM f GROUP BY ALL),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM win),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY ALL),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
  FROM t LEFT JOIN g USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND removed_chars <= {MAX_LOSS} * word_chars AS kept FROM m
"""
