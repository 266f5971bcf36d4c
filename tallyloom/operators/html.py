"""Questions out of web pages: text nodes by a small parser in the tasks, all structure by windows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.operators.batches import bounded_batches

SKIPPED = frozenset("script style nav footer header".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol td th tr table section article blockquote".split())
BOLD = frozenset("b strong".split())
NODES_AT_ONCE = 10_000  #: rows that a task hands over


class _Nodes(HTMLParser):
    """Text nodes in order: (block number, tag, bold, text). A line break counts as a blank in its block.

    With `bold_runs` the beginning of a bold run is an empty node, so that runs without text are seen.
    """

    def __init__(self, bold_runs: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.bold_runs = bold_runs
        self.skip, self.bold, self.block, self.tag = 0, 0, 0, ""
        self.found: list[tuple[int, str, bool, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BOLD:
            self.bold += 1
            if self.bold_runs and not self.skip:
                self.found.append((self.block, self.tag, True, ""))
        elif tag in BLOCKS:
            self.block, self.tag = self.block + 1, tag
        elif tag == "br" and not self.skip:
            self.found.append((self.block, "br", self.bold > 0, " "))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BOLD:
            self.bold = max(0, self.bold - 1)
        elif tag in BLOCKS:
            self.block, self.tag = self.block + 1, ""

    def handle_data(self, data):
        if not self.skip and data:
            self.found.append((self.block, self.tag, self.bold > 0, data))


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bold_runs: bool = False) -> DataFrame:
    """`(page_id, pos, block, tag, bold, text)`: the visible text nodes of each page in order, with `bold_runs` also an empty one where a bold run begins. Null pages have none."""

    names = ["page_id", "pos", "block", "tag", "bold", "text"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, html in zip(b["page_id"], b["html"]):
                p = _Nodes(bold_runs)
                p.feed(html or "")
                p.close()
                rows += [(i, n, *node) for n, node in enumerate(p.found)]
                if len(rows) >= NODES_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    bounded_batches(pages.sparkSession)
    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, f"page_id {kind}, pos int, block int, tag string, bold boolean, text string")


@F.udtf(returnType="pos int, block int, tag string, bold boolean, text string")
class HtmlNodes:
    """`html_nodes(html)` for SQL, to be used with LATERAL: the same rows for one page."""

    def eval(self, html: str):
        p = _Nodes()
        p.feed(html or "")
        p.close()
        for n, node in enumerate(p.found):
            yield n, *node


def register_html_nodes(spark: SparkSession, name: str = "html_nodes") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, HtmlNodes)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, "\u00a0", " "), r"\s+", " "))


def block_texts(nodes: DataFrame) -> DataFrame:
    """`(page_id, block, tag, text, bold_text)`: a block's pieces joined as they stand; bold_text those of its bold runs."""
    piece = F.struct("pos", "bold", "text")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "")
    out = nodes.groupBy("page_id", "block").agg(F.array_sort(F.collect_list(piece)).alias("ps"), F.max("tag").alias("tag"))
    return out.select("page_id", "block", "tag", squeezed(joined(F.col("ps"))).alias("text"), squeezed(joined(F.filter("ps", lambda x: x["bold"]))).alias("bold_text")).filter("text <> ''")


def bold_blocks(nodes: DataFrame) -> DataFrame:
    """`(page_id, block, bold_text)` of each block that has bold nodes, whether they hold text or not."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "")
    out = nodes.filter("bold").groupBy("page_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ps"))
    return out.select("page_id", "block", squeezed(joined(F.col("ps"))).alias("bold_text"))


# How headings name task, part and subject.
MARKERS = {"tache": r"(?i)^t[âa]che\s*(\d+)", "partie": r"(?i)^(?:partie|combinaison)\s*(\d+)", "sujet": r"(?i)^sujet\s*(\d+)"}


def questions(blocks: DataFrame, footer: str = "(?i)^(mentions légales|footer)", least: int = 40) -> DataFrame:
    """`(page_id, tache, partie, sujet, text)` of pages whose headings say task, part and subject.

    A task heading resets part and subject, a part heading the subject. A subject heading arms; the
    first long bold text after it is the question and disarms. Nothing counts after the footer.
    Only tasks 2 and 3 count; a question that comes twice on a page counts once.
    """
    w = Window.partitionBy("page_id").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = lambda k: F.regexp_extract("text", MARKERS[k], 1).try_cast("int")
    b = blocks.withColumns({f"m_{k}": number(k) for k in MARKERS} | {"stop": F.col("text").rlike(footer).cast("int")})
    b = b.withColumn("stopped", F.max("stop").over(before)).filter("stopped = 0")
    b = b.withColumns({"s_tache": F.count("m_tache").over(before), "tache": F.last("m_tache", ignorenulls=True).over(before)})
    within = Window.partitionBy("page_id", "s_tache").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumns({"s_partie": F.count("m_partie").over(within), "partie": F.last("m_partie", ignorenulls=True).over(within)})
    inner = Window.partitionBy("page_id", "s_tache", "s_partie").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumns({"s_sujet": F.count("m_sujet").over(inner), "sujet": F.last("m_sujet", ignorenulls=True).over(inner)})
    marker = F.coalesce(*[f"m_{k}" for k in MARKERS]).isNotNull()
    long_ = b.filter(~marker & (F.length("bold_text") > least) & F.col("tache").isin(2, 3) & F.col("sujet").isNotNull())
    first = long_.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "s_tache", "s_partie", "s_sujet").orderBy("block"))).filter("n = 1")
    return first.select("page_id", "tache", "partie", "sujet", F.col("bold_text").alias("text")).distinct()


def pushed_payload(html: Column) -> Column:
    """The text that a page's `push([1,"..."])` calls carry, unescaped and joined."""
    parts = F.regexp_extract_all(html, F.lit(r'\.push\(\[1,("(?:[^"\\]|\\.)*+")\]\)'), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.from_json(F.concat(F.lit("["), p, F.lit("]")), "array<string>")[0]), "")


def bracket_slice(payload: Column, key: Column) -> Column:
    """The JSON array that follows `"key":`, by counting brackets outside strings; null without one."""

    # From a key's array on only strings and brackets matter; the expression skips all else at once.
    marks = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[{]|[\]}]', re.DOTALL)

    def one(s: str | None, k: str) -> str | None:
        at = (s or "").find(f'"{k}":[')
        if at < 0:
            return None
        start, depth = s.index("[", at), 0
        for m in marks.finditer(s, start):
            c = m[0]
            depth += (c in "[{") - (c in "]}")
            if not depth:
                return s[start : m.end()]
        return None

    @F.pandas_udf("string")
    def cut(payloads: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([one(s, k) for s, k in zip(payloads, keys)], dtype=object)

    if spark := SparkSession.getActiveSession():
        bounded_batches(spark)
    return cut(payload, key)


PARTIES = "array<struct<partie:int,sujets:array<struct<tache:int,text:string>>>>"


def nested_questions(pages: DataFrame, parties: Column) -> DataFrame:
    """`(page_id, partie, tache, sujet, text)` of nested parts and subjects; sujet counts within page, part and task."""
    a = pages.select("page_id", F.posexplode(parties).alias("p", "x")).select("page_id", "p", "x.partie", F.posexplode("x.sujets").alias("s", "y"))
    rows = a.select("page_id", "partie", "p", "s", "y.tache", F.trim("y.text").alias("text")).filter(F.col("tache").isin(2, 3) & (F.coalesce("text", F.lit("")) != ""))
    n = F.row_number().over(Window.partitionBy("page_id", "partie", "tache").orderBy("p", "s"))
    return rows.select("page_id", "partie", "tache", n.alias("sujet"), "text")


HREF = r"""<a\s(?:[^>]*?\s)?href=("[^"]*"|'[^']*')"""


def links(pages: DataFrame, slug: str) -> DataFrame:
    """`(page_id, url, slug)`: same-host links whose path matches, once for each slug, absolute, the first on the page.

    Links may be absolute, without scheme, from the root, or beside the page; hosts must be equal.
    """
    hrefs = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "quoted"))
    hrefs = hrefs.withColumn("href", F.trim(F.substring("quoted", F.lit(2), F.length("quoted") - 2))).filter("href <> '' and not startswith(href, '#')")
    host = lambda c: F.lower(F.regexp_extract(c, "^(https?://[^/?#]+)", 1))
    beside = F.when(F.col("base").rlike("^https?://[^/]+/"), F.regexp_replace(F.regexp_replace("base", "[?#].*$", ""), "[^/]*$", "")).otherwise(F.concat("base", F.lit("/")))
    absolute = (
        F.when(F.col("href").rlike("^https?://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract("base", "^(https?:)", 1), "href"))
        .when(F.col("href").startswith("/"), F.concat(F.regexp_extract("base", "^(https?://[^/?#]+)", 1), "href"))
        .when(~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(beside, "href"))
    )
    found = hrefs.withColumn("link", absolute).filter(F.col("link").isNotNull() & (host(F.col("link")) == host(F.col("base"))))
    found = found.withColumn("slug", F.regexp_extract("link", slug, 1)).filter("slug <> ''")
    first = found.groupBy("page_id", "slug").agg(F.min_by("link", "pos").alias("url"))
    return first.select("page_id", "url", "slug")


def widget_lists(pages: DataFrame) -> DataFrame:
    """`(page_id, title, link)` of `data-attributes` JSON; entries without link are left out."""
    raw = F.explode(F.regexp_extract_all("html", F.lit("data-attributes='([^']*)'"), F.lit(1)))
    plain = F.replace(F.replace(F.replace("j", F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    rows = pages.select("page_id", raw.alias("j")).select("page_id", F.from_json(plain, "title string, lists array<struct<link:string>>").alias("w"))
    return rows.select("page_id", "w.title", F.explode("w.lists.link").alias("link")).filter("link <> ''")


def content_changes(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """`(page_id, sha, change)` against `(page_id, sha)` of the last visit: new, identical or changed."""
    now = pages.select("page_id", F.sha2("html", 256).alias("sha")).join(manifest.select("page_id", F.col("sha").alias("was")), "page_id", "left")
    return now.select("page_id", "sha", F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("sha"), "identical").otherwise("changed").alias("change"))


def yield_report(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Questions of each page by task; pages without any are flagged."""
    counts = found.groupBy("page_id").agg(F.count(F.when(F.col("tache") == 2, 1)).alias("t2"), F.count(F.when(F.col("tache") == 3, 1)).alias("t3"))
    out = pages.select("page_id").distinct().join(counts, "page_id", "left").fillna(0, ["t2", "t3"])
    return out.withColumn("empty", F.col("t2") + F.col("t3") == 0)
