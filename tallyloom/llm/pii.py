"""Personal data by bootstrapped contextual extraction (operator 4), in DataFrame functions only.

Base entities (email, ip, card, phone) are found by fixed patterns and checks; they are seeds, and so
are tokens that can hardly be anything but a key (long runs of letters and digits), which are given only
if a pattern accepts them.
Every token but a plain word (letters, no capital after the first) is a possible identifier.
The words around it are lexical patterns (one or two before it, one or two behind it, one on each
side), its value an instance; patterns and instances form a bipartite graph, which Spark scores in
rounds. A pattern is as good as the share of known identifiers among its instances: seeds and
identifiers found so far speak for it, plain numbers, dates and times against it, and values of
which nothing is known count a little against it. An instance is as good as its patterns together,
if it occurs mostly in them; without a digit it needs more of them. Accepted instances lend their
other patterns weight in the next round. If asked, patterns that few different plain words fill find
plain words too in the end, where these words occur mostly there. All become spans of kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.common import documents, let, small_or_shuffled, sums_before
from tallyloom.operators.materialize import materialize

# The patterns of the base kinds, in the order that breaks ties. Groups are possessive
# where nothing could follow anyway; cards ask for their least number of digits at once.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that a text may hold the kind at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){11}+", "phone": "+"}
KINDS = [*BASE, "id"]
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
TOKEN = r"\+?[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"  #: a run without white space, less the marks around it
# Fixed value: plain numbers, decimals, dates, times and ordinals, which speak against a pattern.
PLAIN = r"^(?:[0-9]{1,5}|[0-9]+[.,][0-9]+|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|[0-9]+(?:st|nd|rd|th))$"

# All that a key's token must match: 18 letters and digits or more, of which five are digits, and a letter.
KEY = (r"^[A-Za-z0-9]{18,}$", r"^(?:[^0-9]*[0-9]){5}", "[A-Za-z]")
PLAIN_WORD = r"^\p{L}\p{Ll}*$"
PIECE = 32
LEXICAL, FEW_WORDS = r"[^_#^$]", 200  #: what a part of a pattern holds if it is a word; words that are sought in a text at once
LISTED = 10_000  #: patterns or values that are looked up in a list; more are joined
PART_BYTES, PART_STEP = 8 << 20, 8  #: texts by which the first patterns that many words fill are found, and growth from part to part
ROUNDS = 3
MIN_SEEDS = 5  #: distinct known identifiers of a pattern, by their scores
UNKNOWN = 0.1  #: how much a value of which nothing is known counts against its pattern
PATTERN_SCORE, INSTANCE_SCORE = 0.6, 0.7
WORDLIKE_SCORE = 0.9  #: of an instance without a digit, plain words among them
INSIDE = 0.5  #: least share of an instance's occurrences that lie in one accepted pattern
MIN_CHARS = 4  #: of a discovered identifier


def _placed(text: Column, pattern: str) -> Column:
    """The hits of a pattern as structs (start, hit): lengths of what lies before and of the hits in turn give every place in code points."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(F.length(p).alias("p"), h.alias("h")))
    hits = F.filter(both, lambda x: x["h"].isNotNull())
    return let(hits, lambda xs: F.zip_with(xs, sums_before(F.transform(xs, lambda x: x["p"] + F.length(x["h"]))), lambda x, at: F.struct((at + x["p"]).alias("start"), x["h"].alias("hit"))))


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return hit.rlike(r"^(0*+([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(\.|$)){4}$")
    if kind == "card":
        digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        luhn = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
        return F.when(n.between(12, 19), luhn % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    hint = F.contains(text, F.lit(HINT[kind])) if len(HINT[kind]) == 1 else text.rlike(HINT[kind])
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"))
    found = F.filter(F.transform(_placed(text, BASE[kind]), span), lambda x: _valid(kind, x["value"]))
    return F.when(hint, found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """The base entities of a text, by start, then kind: array of (start, rank, end, kind, value)."""
    return F.array_sort(F.concat(*[_spans_of(k, text) for k in BASE]))


def _around(xs: Column, i: Column) -> list[Column]:
    """The words around token i of (start, hit) structs, lower-cased, `#` if they hold a digit, `^` and `$` past the ends."""
    near = lambda k, past: let(F.get(xs, k)["hit"], lambda w: F.when(w.isNull(), F.lit(past)).when(w.rlike("[0-9]"), "#").otherwise(F.lower(w)))
    return [near(i - 1, "^").alias("l1"), near(i - 2, "^").alias("l2"), near(i + 1, "$").alias("r1"), near(i + 2, "$").alias("r2")]


def _patterns(l1: Column, l2: Column, r1: Column, r2: Column) -> Column:
    """The five patterns of a place, `_` where the instance stands."""
    at = F.lit("_")
    return F.array(F.concat_ws(" ", l1, at), F.concat_ws(" ", l2, l1, at), F.concat_ws(" ", at, r1), F.concat_ws(" ", at, r1, r2), F.concat_ws(" ", l1, at, r1))


def _tokens(text: Column, plain: bool, fields, said: list[tuple[int, str]] | None = None) -> Column:
    """`fields(tokens, i)` as a struct for each token that is a plain word, or that isn't; of these, only those that have one of the words `said` so many places off, if given as `(offset, word)`.

    Places are added up for these tokens only: sums of all before the piece of PIECE tokens that one
    is in, and of those before it in the piece.
    """
    both = F.zip_with(F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit")))
    summed = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["hit"]))
    pieces = lambda xs: sums_before(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PIECE).cast("int")), lambda k: summed(F.slice(xs, k * PIECE + 1, PIECE))))

    def one(xs: Column, before: Column, i: Column) -> Column:
        inside = i % PIECE
        start = F.get(before, F.floor(i / PIECE).cast("int")) + summed(F.slice(xs, i - inside + 1, inside)) + F.get(xs, i)["gap"]
        return F.struct(start.alias("start"), (start + F.length(F.get(xs, i)["hit"])).alias("end"), F.get(xs, i)["hit"].alias("value"), *fields(xs, i))

    def some(xs: Column) -> Column:
        fits = lambda i: F.get(xs, i)["hit"].rlike(PLAIN_WORD) == F.lit(plain)
        if said is None:
            at = F.filter(F.transform(xs, lambda _, i: i), fits)
        else:
            lows = F.transform(xs, lambda x: F.lower(x["hit"]))
            places = lambda lows, off: F.transform(lows, lambda w, i: F.when(w.isin([v for o, v in said if o == off]), i - off))
            beside = let(lows, lambda lows: F.array_distinct(F.concat(*[F.filter(places(lows, off), lambda i: i.between(0, F.size(xs) - 1)) for off in sorted({o for o, _ in said})])))
            at = F.filter(beside, fits)
        return let(at, lambda at: let(F.when(F.size(at) > 0, pieces(xs)), lambda before: F.transform(at, lambda i: one(xs, before, i))))

    return let(F.filter(both, lambda x: x["hit"].isNotNull()), some)


def occurrences(docs: DataFrame) -> DataFrame:
    """Base entities and possible identifiers of `(doc_id, th, text)`: `(doc_id, th, start, end, rank, kind, value, l1, l2, r1, r2)`; kind and rank are null for possible identifiers."""
    none = lambda kind: F.lit(None).cast(kind)
    order = ("start", "end", "rank", "kind", "value", "l1", "l2", "r1", "r2")
    tokens = F.transform(_tokens(F.col("text"), False, _around), lambda x: F.struct(*[none("int" if c == "rank" else "string").alias(c) if c in ("rank", "kind") else x[c].alias(c) for c in order]))
    base = F.transform(base_spans(F.col("text")), lambda b: F.struct(*[b[c].alias(c) if c in ("start", "end", "rank", "kind", "value") else none("string").alias(c) for c in order]))
    return docs.select("doc_id", "th", F.explode(F.concat(base, tokens)).alias("t")).select("doc_id", "th", "t.*")


def told_apart(found: DataFrame) -> DataFrame:
    """occurrences() once each, and of possible identifiers only those outside base entities and, as `seed`, the first token of one."""
    # One shuffle serves the groups and the windows, which see a text's rows together anyway.
    once = found.repartition("doc_id", "th").groupBy("doc_id", "th", "start", "end", "rank", "kind").agg(*[F.any_value(c).alias(c) for c in ("value", "l1", "l2", "r1", "r2")])
    here = Window.partitionBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    # Of equal starts base entities come first in both orders.
    back = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(here.orderBy("start", F.col("rank").asc_nulls_last(), "end"))
    ahead = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(here.orderBy(F.desc("start"), F.col("rank").asc_nulls_last(), "end"))
    rows = once.withColumn("back", back).withColumn("ahead", ahead)
    seed = F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    inside = F.coalesce(F.col("back") > F.col("start"), F.lit(False)) & ~seed
    return rows.filter(F.col("kind").isNotNull() | ~inside).withColumn("seed", F.col("kind").isNull() & seed).drop("back", "ahead")


def _trust(against: Column) -> Column:
    return F.round(F.col("mass") / (F.col("mass") + against + 1), 9)


def _key_like(value: Column) -> Column:
    return value.rlike(KEY[0]) & value.rlike(KEY[1]) & value.rlike(KEY[2])


def discovered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(value)`, the instances among told_apart() rows that the bootstrapped patterns accept, and the patterns `(pattern, mass, against)` of the last round."""
    tokens = found.filter("kind is null")
    edges = tokens.select("value", "seed", F.explode(_patterns(*map(F.col, ("l1", "l2", "r1", "r2")))).alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "edges")
    values = edges.filter(F.col("pattern").startswith("_") & ~F.col("pattern").substr(3, 1_000_000).contains(" ")).groupBy("value").agg(F.max("seed").alias("seed"), F.sum("n").alias("times"))
    marked = values.select("value", "seed", "times", (~F.col("seed") & F.col("value").rlike(PLAIN)).alias("plain"), (F.col("seed") | _key_like(F.col("value"))).alias("sure"))
    known = materialize(marked.withColumn("score", F.col("sure").cast("double")).withColumn("taken", F.lit(False)), "known")
    # A pattern of fewer values than it needs seeds can never be good.
    enough = materialize(edges.groupBy("pattern").count().filter(F.col("count") >= MIN_SEEDS).select("pattern"), "enough")
    edges = materialize(edges.join(small_or_shuffled(enough), "pattern", "left_semi").select("pattern", "value", "n"), "edges")
    for _ in range(ROUNDS):
        weighed = edges.join(known, "value")
        against = F.when(F.col("plain"), 1.0).when(F.col("score") > 0, 0.0).otherwise(UNKNOWN)
        graded = weighed.groupBy("pattern").agg(F.sum("score").alias("mass"), F.sum(against).alias("against")).filter(F.col("mass") >= MIN_SEEDS)
        good = materialize(graded.withColumn("trust", _trust(F.col("against"))).filter(F.col("trust") >= PATTERN_SCORE), "patterns")
        scored = edges.join(small_or_shuffled(good), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("found"), F.max("n").alias("inside"))
        joined = known.join(scored, "value", "left")
        bar = F.when(F.col("value").rlike("[0-9]"), INSTANCE_SCORE).otherwise(WORDLIKE_SCORE)
        accepted = ~F.col("plain") & (F.length("value") >= MIN_CHARS) & (F.round("found", 9) >= bar) & (F.col("inside") >= INSIDE * F.col("times"))
        taken = F.coalesce(accepted, F.lit(False))
        known = materialize(joined.select("value", "seed", "times", "plain", "sure", F.when(F.col("sure"), 1.0).when(taken, F.round("found", 9)).otherwise(0.0).alias("score"), taken.alias("taken")), "known")
    return known.filter("not seed and taken").select("value"), good.select("pattern", "mass", "against")


def _words(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """`(doc_id, th, start, end, value, pattern)` of the plain words of `(doc_id, th, text)` that stand in one of the patterns."""
    fields = lambda xs, i: [_patterns(*_around(xs, i)).alias("patterns")]
    parts = F.split("pattern", " ")
    lexical = F.filter(F.transform(parts, lambda w, k: F.struct(F.length(w).alias("n"), w.alias("w"), (k + 1 - F.array_position(parts, "_")).cast("int").alias("off"))), lambda x: x["w"].rlike(LEXICAL))
    said = patterns.select(F.array_max(lexical).alias("x")).select("x.off", "x.w").distinct()  # the longest word of each
    beside = [(r.off, r.w) for r in said.collect()] if said.count() <= LISTED else None  # others can't stand in a pattern
    if beside is not None and len(beside) <= FEW_WORDS:  # texts that say none of the patterns' words are passed over
        docs = docs.filter(let(F.lower("text"), lambda low: F.exists(F.array(*[F.lit(w) for _, w in beside]), lambda w: F.contains(low, w))))
    words = _tokens(F.col("text"), True, fields, beside)
    if patterns.count() > LISTED:
        rows = docs.select("doc_id", "th", F.explode(words).alias("t")).select("doc_id", "th", "t.start", "t.end", "t.value", F.explode("t.patterns").alias("pattern"))
        return rows.join(patterns.select("pattern"), "pattern", "left_semi")
    listed = [r.pattern for r in patterns.select("pattern").collect()]
    held = F.filter(F.transform(words, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.filter(x["patterns"], lambda p: p.isin(listed)).alias("patterns"))), lambda x: F.size(x["patterns"]) > 0)
    return docs.select("doc_id", "th", F.explode(held).alias("t")).select("doc_id", "th", "t.start", "t.end", "t.value", F.explode("t.patterns").alias("pattern"))


def discovered_words(docs: DataFrame, good: DataFrame) -> DataFrame | None:
    """`(doc_id, th, start, end, value)` of plain words that patterns `(pattern, mass, against)` accept; None if there can't be any.

    Only patterns with a word in them count. Here the different words of a pattern count against it too. A pattern that has too many
    of them in a part of the texts has too many in all, so patterns which all sorts of words fill are out before their words are looked at
    everywhere: the first part is of about PART_BYTES, each next one PART_STEP times the last.
    """
    good = materialize(good.filter(F.exists(F.split("pattern", " "), lambda w: w.rlike(LEXICAL))), "lexical")
    if good.isEmpty():
        return None
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = 1
    while size > share * PART_BYTES:
        share *= PART_STEP
    while share > 1:
        part = docs.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(share)) == 0)
        seen = _words(part, good).groupBy("pattern").agg(F.countDistinct("value").alias("words"))
        worst = _trust(F.col("against") + F.coalesce("words", F.lit(0)) * UNKNOWN)
        good = materialize(good.join(seen, "pattern", "left").filter(worst >= PATTERN_SCORE).select(*good.columns), "word_patterns")
        if good.isEmpty():
            return None
        share //= PART_STEP
    hits = materialize(_words(docs, good).distinct(), "words")
    kinds = hits.groupBy("pattern").agg(F.countDistinct("value").alias("words"))
    trusted = materialize(good.join(kinds, "pattern").select("pattern", _trust(F.col("against") + F.col("words") * UNKNOWN).alias("trust")).filter(F.col("trust") >= PATTERN_SCORE), "trusted")
    edges = hits.join(small_or_shuffled(trusted), "pattern").groupBy("value", "pattern", "trust").agg(F.count("*").alias("n"))
    scored = edges.groupBy("value").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("trust")))), 9).alias("found"), F.max("n").alias("inside"))
    scored = materialize(scored.filter((F.col("found") >= WORDLIKE_SCORE) & (F.length("value") >= MIN_CHARS)), "scored_words")
    every = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    if scored.count() <= LISTED:
        sought = [r.value for r in scored.select("value").collect()]
        if not sought:
            return None
        everywhere = docs.select(F.explode(F.filter(every, lambda v: v.isin(sought))).alias("value"))
    else:
        everywhere = docs.select(F.explode(every).alias("value")).join(scored.select("value"), "value", "left_semi")
    times = everywhere.groupBy("value").agg(F.count("*").alias("times"))
    accepted = materialize(scored.join(times, "value").filter(F.col("inside") >= INSIDE * F.col("times")).select("value"), "accepted_words")
    places = hits.join(trusted.select("pattern"), "pattern", "left_semi").join(accepted, "value", "left_semi")
    return places.select("doc_id", "th", "start", "end", "value").distinct()


def find_pii(docs: DataFrame, plain_words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `pii`: struct of base and extra, arrays of (start, rank, end, kind, value) by start, then kind.

    Positions count code points, ends are exclusive. base holds the fixed kinds, leftmost and
    non-overlapping per kind; extra holds the discovered identifiers, which never overlap base ones.
    Plain words are looked at only with `plain_words`, which reads the texts again, and looks only where the words of patterns stand.
    A null text counts as empty and has no spans. Rows are matched by id and text, nulls included;
    repeated rows are treated alike; an empty table gives an empty one. Other columns stay; a column
    pii is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = materialize(told_apart(occurrences(key)), "found")
    news, good = discovered(found)
    fresh = found.filter("kind is null and not seed").join(news, "value", "left_semi").withColumn("rank", F.lit(KINDS.index("id"))).withColumn("kind", F.lit("id"))
    spans = ["doc_id", "th", "start", "end", "rank", "kind", "value"]
    words = discovered_words(key, good) if plain_words else None
    spans = found.filter("kind is not null").select(*spans).unionByName(fresh.select(*spans))
    if words is not None:
        # A word within a base entity belongs to that.
        words = words.withColumns({"rank": F.lit(KINDS.index("id")), "kind": F.lit("id")})
        here = Window.partitionBy("doc_id", "th")
        back = F.max(F.when(F.col("kind") != "id", F.col("end"))).over(here.orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0))
        spans = spans.unionByName(words).withColumn("back", back).filter("kind <> 'id' or back is null or back <= start").drop("back")
    by_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "value"))).alias("_spans"))
    docs = docs.drop("pii")
    # Numbered names, so that no column can clash; those that nobody reads, the text among them, don't move.
    rows = docs.select(F.col(id_col).alias("_own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_own_th"), *[F.col(c).alias(f"_own_{k}") for k, c in enumerate(docs.columns)])
    own = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_th") == F.col("_th"))
    of = lambda extra: F.coalesce(F.filter("_spans", lambda s: (s["kind"] == "id") == F.lit(extra)), F.array().cast(SPANS))
    return rows.join(by_doc, own, "left").select(*[F.col(f"_own_{k}").alias(c) for k, c in enumerate(docs.columns)], F.struct(of(False).alias("base"), of(True).alias("extra")).alias("pii"))


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; overlapping spans, ordered by start, are replaced together."""
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out"),
        )
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of operator 4."""
    out = find_pii(documents(spark, sf_dir).select("doc_id", "text"), plain_words=True)
    base = F.col("pii.base")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    everything = F.array_sort(F.concat(base, F.col("pii.extra")))
    return out.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(everything).alias("spans"), F.size("pii.extra").cast("long").alias("n_id"))


def _sql_kind(rank: int, kind: str, pattern: str, valid: str) -> str:
    return f"""SELECT doc_id, p.at + sum(length(p.piece)) OVER w + coalesce(sum(length(p.hit)) OVER (PARTITION BY doc_id ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, {rank} AS rank, '{kind}' AS kind, p.hit AS hit, {valid} AS ok
    FROM (SELECT doc_id, unnest([{{'at': 0, 'k': i, 'piece': string_split_regex(text, '{pattern}')[i], 'hit': regexp_extract_all(text, '{pattern}')[i]}} FOR i IN range(1, len(regexp_extract_all(text, '{pattern}')) + 1)]) AS p FROM t)
    WINDOW w AS (PARTITION BY doc_id ORDER BY p.k)"""


_DIGITS = "regexp_replace(p.hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) ELSE CAST(reverse({_DIGITS})[i + 1] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END END FOR i IN range(0, length({_DIGITS}))]) % 10 = 0"
_NEAR = "CASE WHEN {x} IS NULL THEN '{past}' WHEN regexp_matches({x}, '[0-9]') THEN '#' ELSE lower({x}) END AS {name}"
_AROUND = ", ".join(_NEAR.format(x=f"{f}(p.hit, {k}) OVER w", past=past, name=name) for f, k, past, name in (("lag", 1, "^", "l1"), ("lag", 2, "^", "l2"), ("lead", 1, "$", "r1"), ("lead", 2, "$", "r2")))
_ROUND = """m{n} AS MATERIALIZED (SELECT *, round(mass / (mass + against + 1), 9) AS trust FROM (SELECT e.pattern, sum(k.score) AS mass, sum(CASE WHEN k.plain THEN 1.0 WHEN k.score > 0 THEN 0.0 ELSE {unknown} END) AS against FROM edges e JOIN k{b} k USING (value) GROUP BY e.pattern HAVING sum(k.score) >= {seeds})),
f{n} AS MATERIALIZED (SELECT e.value, round(1 - exp(sum(ln(1 - m.trust))), 9) AS found, max(e.n) AS inside FROM edges e JOIN m{n} m USING (pattern) WHERE m.trust >= {bar} GROUP BY e.value),
k{n} AS MATERIALIZED (SELECT value, seed, times, plain, sure, CASE WHEN sure THEN 1.0 WHEN taken THEN found ELSE 0.0 END AS score, taken FROM (SELECT k.* EXCLUDE (taken), f.found,
  coalesce(NOT k.plain AND length(k.value) >= {chars} AND f.found >= CASE WHEN regexp_matches(k.value, '[0-9]') THEN {instance} ELSE {wordlike} END AND f.inside >= {share} * k.times, false) AS taken FROM k{b} k LEFT JOIN f{n} f USING (value)))"""
_PATTERNS = "[l1 || ' _', l2 || ' ' || l1 || ' _', '_ ' || r1, '_ ' || r1 || ' ' || r2, l1 || ' _ ' || r1]"
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_sql_kind(0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_sql_kind(1, 'ip', '[0-9]+(?:[.][0-9]+){3}', "len(list_filter(string_split(p.hit, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")}
  UNION ALL {_sql_kind(2, 'card', '[0-9](?:[ -]?[0-9]){11,}', f'length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}')}
  UNION ALL {_sql_kind(3, 'phone', '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15')}),
base AS MATERIALIZED (SELECT doc_id, CAST(start AS BIGINT) AS start, rank, kind, CAST(start + length(hit) AS BIGINT) AS fin FROM found WHERE ok),
cut AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS hits, string_split_regex(text, '{TOKEN}') AS pieces FROM t),
placed AS (SELECT doc_id, unnest([{{'k': i, 'piece': pieces[i], 'hit': hits[i]}} FOR i IN range(1, len(hits) + 1)]) AS p FROM cut),
toks AS MATERIALIZED (SELECT doc_id, p.hit AS value, CAST(sum(length(p.piece) + length(p.hit)) OVER w - length(p.hit) AS BIGINT) AS start, CAST(sum(length(p.piece) + length(p.hit)) OVER w AS BIGINT) AS fin, {_AROUND}
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY p.k)),
occ AS (SELECT o.*, EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start >= o.start AND b.start < o.fin) AS seed, EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start <= o.start AND b.fin > o.start) AS covered
  FROM toks o WHERE NOT regexp_matches(value, '{PLAIN_WORD}')),
c AS MATERIALIZED (SELECT * FROM occ WHERE seed OR NOT covered),
all_edges AS MATERIALIZED (SELECT pattern, value, count(*) AS n FROM (SELECT value, unnest({_PATTERNS}) AS pattern FROM c) GROUP BY ALL),
edges AS MATERIALIZED (SELECT * FROM all_edges WHERE pattern IN (SELECT pattern FROM all_edges GROUP BY pattern HAVING count(*) >= {MIN_SEEDS})),
k0 AS (SELECT *, CASE WHEN sure THEN 1.0 ELSE 0.0 END AS score, false AS taken FROM (SELECT value, bool_or(seed) AS seed, count(*) AS times, NOT bool_or(seed) AND regexp_matches(value, '{PLAIN}') AS plain,
  bool_or(seed) OR ({' AND '.join(f"regexp_matches(value, '{k}')" for k in KEY)}) AS sure FROM c GROUP BY value)),
{', '.join(_ROUND.format(n=n, b=n - 1, unknown=UNKNOWN, seeds=MIN_SEEDS, bar=PATTERN_SCORE, chars=MIN_CHARS, instance=INSTANCE_SCORE, wordlike=WORDLIKE_SCORE, share=INSIDE) for n in range(1, ROUNDS + 1))},
news AS (SELECT value FROM k{ROUNDS} WHERE NOT seed AND taken),
spans AS (SELECT doc_id, start, rank, kind, fin FROM base UNION ALL SELECT DISTINCT doc_id, start, {len(BASE)}, 'id', fin FROM c SEMI JOIN news USING (value) WHERE NOT seed),
per AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'id') AS n_id,
  string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (kind <> 'id') AS based, string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_id, 0) AS n_id
FROM documents LEFT JOIN per USING (doc_id)
"""
