"""Line dedup by a log-template tree (operator 3), in DataFrame functions only.

A line's place in the tree is fixed-depth: its token count, then its three leading tokens (twelve in
long lines, which else would meet by chance), with every token that holds a digit read as a variable
field. Only leaves that several texts reach are
looked into. There, a token is constant at its position if enough texts have it there; other
positions vary. A line is an instance of the template so made if at most a fifth of its positions
vary and at least half hold constant words, or if it is found as it stands in enough texts, whatever
it consists of. Templates of MIN_DOCS texts recur (of LONG_MIN_DOCS for long lines, which don't agree
by chance), and their lines are dropped from all documents but the first.

Equal texts count as one: a text doesn't recur by being copied whole, and its copies are treated
alike. Equal lines are one row with a count before tokens are looked at, so a line of a third of
all documents weighs as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.common import documents, join_hot_keys_apart, perhaps_among
from tallyloom.operators.materialize import materialize

MIN_DOCS = 5  #: texts that make a template recur
LONG, LONG_MIN_DOCS = 50, 2  #: tokens from which a line is long, and texts that make its template recur
LEADING, LONG_LEADING = 3, 12  #: tokens below the token count in the tree, and in that of long lines
VARIABLE_SHARE = 5  #: one position of so many may vary
FIELD_SHARE = 2  #: one position of so many may be a field of digits
COPY_SHARE = 0.8  #: of its characters that a copy has in common with the document it copies

_WIDE_SPACE = r"(?:\x20(?=[\x09-\x0D\x20])|[\x09-\x0D])[\x09-\x0D\x20]*+"  #: white space that isn't one blank


def _words_in(normal: Column) -> Column:
    """Tokens of a text that isn't empty and whose white space is single blanks."""
    return F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WIDE_SPACE, " "))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """`(doc_id, th, chars, pos, size, n, leaf, line, masked)` of each line with a token of `(doc_id, th, text)`.

    chars is the length of the whole text, size that of the line; line is a hash of the line as it
    stands, but for its white space. Every step that a later one reads twice is a select of its own,
    so that it is computed once.
    """
    at = docs.select("doc_id", "th", F.length("text").alias("chars"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).filter(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    at = at.select("doc_id", "th", "chars", "pos", F.length("raw").alias("size"), _normal(F.col("raw")).alias("line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(F.col("line"))
    line = at.select("doc_id", "th", "chars", "pos", "size", F.xxhash64("line").alias("line"), masked.alias("masked"))
    n = _words_in(F.col("masked"))
    leaf = F.xxhash64(n, F.when(n >= LONG, F.substring_index("masked", " ", LONG_LEADING)).otherwise(F.substring_index("masked", " ", LEADING)))
    return line.select("doc_id", "th", "chars", "pos", "size", n.alias("n"), leaf.alias("leaf"), "line", "masked")


def _enough(n: Column, min_docs: int) -> Column:
    return F.when(n >= LONG, min(LONG_MIN_DOCS, min_docs)).otherwise(min_docs)


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`(leaf, line, template, first, rows)` of the distinct lines whose template recurs.

    `lines` are those of parsed_lines(), read several times. template is a hash of the template;
    first the struct (id missing, doc_id, th) of the first document that has it; rows how many
    lines of all documents are this one.
    """
    seen = lines.groupBy("leaf", "n", "th").agg(F.lit(1).alias("one"))
    leaves = materialize(seen.groupBy("leaf", "n").count().filter(F.col("count") >= _enough(F.col("n"), min_docs)).select("leaf"), "leaves")
    in_docs = perhaps_among(lines, leaves, "leaf").join(leaves, "leaf")  # a semi join would be moved before the bitmap
    place = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    by_doc = materialize(in_docs.groupBy("leaf", "line", "th").agg(F.any_value("n").alias("n"), F.any_value("masked").alias("masked"), place.alias("place"), F.count("*").alias("rows")), "by_doc")
    distinct = materialize(by_doc.groupBy("leaf", "line").agg(F.any_value("n").alias("n"), F.any_value("masked").alias("masked"), F.count("*").alias("docs"), F.sum("rows").alias("rows")), "distinct_lines")
    # Where a leaf has one line, that line is the template; tokens tell others apart.
    several = materialize(distinct.groupBy("leaf").agg(F.count("*").alias("lines")).filter("lines > 1").select("leaf"), "several")
    alone = distinct.join(several, "leaf", "left_anti").select("leaf", "line", "n", "rows", F.xxhash64("line", F.lit("alone")).alias("template"))
    distinct = materialize(distinct.join(several, "leaf", "left_semi"), "several_lines")
    tokens = distinct.select("leaf", "line", "n", "docs", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    constant = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support"), F.count("*").alias("_n"), F.any_value("n").alias("n")).filter(F.col("support") >= _enough(F.col("n"), min_docs))
    constant = materialize(constant.select("leaf", "at", "token", "_n"), "constants")
    n_tokens = distinct.agg(F.sum("n")).first()[0] or 0
    held = join_hot_keys_apart(tokens.select("leaf", "line", "at", "token"), constant, ["leaf", "at", "token"], n_tokens)
    # Of a line, only the constant positions are left here; what is missing varies.
    shape = held.groupBy("leaf", "line").agg(F.bit_xor(F.xxhash64("at", "token")).alias("template"), F.count("*").alias("constant"), F.sum(F.when(F.col("token") == "<*>", 1).otherwise(0)).alias("fields"))
    read = distinct.join(shape, ["leaf", "line"], "left").select("leaf", "line", "n", "docs", "rows", F.coalesce("template", F.lit(0)).alias("template"), F.coalesce("constant", F.lit(0)).alias("constant"), F.coalesce("fields", F.lit(0)).alias("fields"))
    fits = ((F.col("n") - F.col("constant")) * VARIABLE_SHARE <= F.col("n")) & (F.col("fields") * FIELD_SHARE <= F.col("n"))
    as_it_stands = F.col("docs") >= _enough(F.col("n"), min_docs)
    shape = read.filter(fits | as_it_stands).select("leaf", "line", "n", "rows", F.when(fits, F.col("template")).otherwise(F.xxhash64("line", F.lit("as it stands"))).alias("template"))
    shape = materialize(shape.unionByName(alone), "shapes")
    of_docs = by_doc.select("leaf", "line", "th", "place").join(shape, ["leaf", "line"]).groupBy("leaf", "template", "th").agg(F.min("place").alias("place"), F.any_value("n").alias("n"))
    recurs = of_docs.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("place").alias("first"), F.any_value("n").alias("n")).filter(F.col("docs") >= _enough(F.col("n"), min_docs))
    recurs = materialize(recurs.select("leaf", "template", "first"), "templates")
    return shape.join(recurs, ["leaf", "template"]).select("leaf", "line", "template", "first", "rows")


def _copies(hit: DataFrame, lines: DataFrame) -> DataFrame:
    """`(doc_id, th)` of the documents whose lines dropped for one other document are COPY_SHARE of both documents' characters."""
    shared = hit.groupBy("doc_id", "th", "chars", "first").agg(F.sum("size").alias("shared")).filter(F.col("shared") >= COPY_SHARE * F.col("chars"))
    firsts = shared.select(F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th")).distinct()
    lengths = lines.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), F.col("chars").alias("f_chars")).join(firsts, ["f_id", "f_th"], "left_semi").distinct()
    both = shared.withColumn("f_id", F.col("first.doc_id")).withColumn("f_th", F.col("first.th")).join(lengths, ["f_id", "f_th"])
    return both.filter(F.col("shared") >= COPY_SHARE * F.col("f_chars")).select("doc_id", "th").distinct()


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leave_copies: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the lines of recurring templates removed from `text_col`, and a column more.

    line_dedup: struct of n_lines (split at line feeds, blank ones included; 0 for a null text),
    n_dropped and copy. A template's lines stay in the document of smallest id that has it, and in
    those of the same text. With `leave_copies`, documents that are copies of one other by their
    lines (see COPY_SHARE) stay as they are, with copy true, for a later removal of whole documents.
    Blank lines are never dropped; a null text stays null; an empty one stays empty. Rows with a
    null id are treated like others, but come after all ids when the first is sought. Rows repeated
    with id and text count once and are all treated alike. An empty table gives an empty one. Other
    columns stay, whatever their names, except that a column line_dedup is replaced.
    """
    key = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = materialize(parsed_lines(key), "lines")
    drops = materialize(recurring_lines(lines, min_docs).select("leaf", "line", "first", F.col("rows").alias("_n")), "recurring")
    narrow = lines.select("doc_id", "th", "chars", "pos", "size", "leaf", "line")
    hit = join_hot_keys_apart(perhaps_among(narrow, drops, "line"), drops, ["leaf", "line"], lines.count())
    hit = hit.filter(F.col("th") != F.col("first.th")).dropDuplicates(["doc_id", "th", "pos"])
    if leave_copies:
        hit = materialize(hit.drop("leaf", "line"), "hits")
        copies = materialize(_copies(hit, lines), "copies").select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"))
        own = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))
        hit = hit.join(copies, own, "left").select("doc_id", "th", "pos", F.col("c_th").isNotNull().alias("copy"))
    else:
        hit = hit.select("doc_id", "th", "pos", F.lit(False).alias("copy"))
    cut = hit.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("pos").alias("_drop"), F.any_value("copy").alias("_copy"))
    docs = docs.drop("line_dedup")
    rows = docs.select(F.struct("*").alias("_row"))  # so that no column of theirs can clash
    text = F.col("_row")[text_col]
    joined = rows.join(cut, F.col("_row")[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left")
    parts = F.split(text, "\n", -1)
    remove = F.col("_drop").isNotNull() & ~F.col("_copy")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    lean = F.element_at(F.transform(F.array(parts), lambda p: F.transform(stay, lambda i: F.get(p, i))), 1)  # parts once, not for each line
    kept = F.when(remove, F.array_join(lean, "\n")).otherwise(text)
    report = F.struct(
        F.when(text.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(remove, F.size("_drop")).otherwise(0).alias("n_dropped"),
        F.coalesce(F.col("_copy"), F.lit(False)).alias("copy"),
    )
    return joined.select(*[(kept if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns], report.alias("line_dedup"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 3: doc_id, text without its recurring lines, n_lines, n_dropped."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"))


ORACLE = r"""
WITH key AS (SELECT doc_id, text, md5(coalesce(text, '')) AS th, string_split(text, chr(10)) AS parts FROM documents),
cut AS (SELECT doc_id, th, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos FROM key WHERE text IS NOT NULL),
normal AS (SELECT doc_id, th, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM cut),
lines AS (
  SELECT doc_id, th, pos, line, len(toks) AS n, CASE WHEN len(toks) >= 50 THEN 2 ELSE 5 END AS enough, array_to_string(toks, ' ') AS masked, array_to_string(toks[1:CASE WHEN len(toks) >= 50 THEN 12 ELSE 3 END], ' ') AS lead
  FROM (SELECT doc_id, th, pos, line, list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks FROM normal WHERE line <> '')),

leaves AS (SELECT n, lead FROM (SELECT DISTINCT n, enough, lead, th FROM lines) GROUP BY n, enough, lead HAVING count(*) >= enough),
by_doc AS (SELECT n, enough, lead, masked, line, th, min(doc_id) AS doc_id FROM lines SEMI JOIN leaves USING (n, lead) GROUP BY ALL),
dist AS (SELECT n, enough, lead, masked, line, count(*) AS docs FROM by_doc GROUP BY ALL),
tokens AS (SELECT n, enough, lead, line, docs, unnest(string_split(masked, ' ')) AS token, generate_subscripts(string_split(masked, ' '), 1) AS place FROM dist),
const AS (SELECT n, lead, place, token FROM tokens GROUP BY n, enough, lead, place, token HAVING sum(docs) >= enough),
read AS (
  SELECT t.n, t.enough, t.lead, t.line, any_value(t.docs) AS docs, string_agg(t.place || ':' || t.token, ' ' ORDER BY t.place) FILTER (c.token IS NOT NULL) AS template,
    5 * count(*) FILTER (c.token IS NULL) <= t.n AND 2 * count(*) FILTER (c.token = '<*>') <= t.n AS fits
  FROM tokens t LEFT JOIN const c USING (n, lead, place, token) GROUP BY t.n, t.enough, t.lead, t.line),
shape AS (SELECT n, enough, lead, line, CASE WHEN fits THEN template ELSE 'as it stands: ' || line END AS template FROM read WHERE fits OR docs >= enough),
recurs AS (
  SELECT n, lead, template, arg_min(th, doc_id) AS first
  FROM (SELECT n, enough, lead, template, th, min(doc_id) AS doc_id FROM by_doc JOIN shape USING (n, enough, lead, line) GROUP BY ALL) GROUP BY n, enough, lead, template HAVING count(*) >= enough),
hit AS (
  SELECT l.doc_id, l.th, l.pos FROM lines l JOIN shape USING (n, lead, line) JOIN recurs r USING (n, lead, template)
  WHERE l.th <> r.first),
lost AS (SELECT doc_id, th, list(pos) AS gone FROM hit GROUP BY ALL)
SELECT k.doc_id,
  CASE WHEN gone IS NOT NULL THEN array_to_string([p[1] FOR p IN list_zip(parts, range(len(parts))) IF NOT list_contains(gone, p[2])], chr(10)) ELSE text END AS text,
  CAST(coalesce(len(parts), 0) AS INTEGER) AS n_lines,
  CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped
FROM key k LEFT JOIN lost USING (doc_id, th)
"""
