"""Paragraphs of web pages, by Spark expressions: tags are tokens, elements are intervals of tokens.

A page is cut into tags, comment marks and text. The depth of a tag name is a running sum that never falls below zero; a tag that opens an element and the one that closes it
are neighbours among the tags of that name and depth, so every element is an interval that one window finds. Whatever lies in a dropped element (navigation, page heads and feet, scripts,
markup) goes; if a page has a main part only its paragraphs stay. Block tags part paragraphs, white space is one blank, character references are decoded, and
paragraphs of one character go.

Defined results: a null page has no paragraphs; what is never closed reaches to the page's end; a closing tag without its opening one is ignored; equal keys are one page, so keys should be
unique; an empty table gives an empty table. A page has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

TOKEN = r"<!--|-->|<[!?][^<>]*>|</?[A-Za-z][^<>]*>|[^<-]+|[<-]"
#: Elements and classes that are dropped, tags that part paragraphs, tags without an end.
DROPPED = ("nav", "header", "footer", "aside", "script", "style", "noscript", "template", "svg")
DROPPED_CLASSES = ("nhsuk-header", "nhsuk-footer", "nhsuk-skip-link")
BLOCKS = (
    "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "td", "th", "tr", "br", "section", "article",
    "dd", "dt", "blockquote", "pre", "figcaption", "summary", "ul", "ol", "table",
)
VOID = ("br", "img", "input", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")
RAW = ("script", "style")


def attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    return F.regexp_replace(F.regexp_replace(found, rf"(?i)^\s{name}\s*=\s*", ""), "^[\"']|[\"']$", "")


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, s, name, opens, closes) of every token that is neither in a comment nor in a script or style sheet."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "s"))
    is_tag = F.col("s").rlike(r"^</?[A-Za-z]")
    name = F.when(is_tag, F.lower(F.regexp_extract("s", r"^</?([A-Za-z][^\s/>]*)", 1)))
    rows = rows.withColumn("name", name).withColumn("ending", is_tag & F.startswith("s", F.lit("</")))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    state = lambda starts, ends: F.coalesce(F.last(F.when(starts, True).when(ends, False), True).over(before), F.lit(False))
    rows = rows.withColumn("hidden", state(F.col("s") == "<!--", F.col("s") == "-->"))
    for raw in RAW:
        own = (F.col("name") == raw) & ~F.col("hidden")
        # what ends the region is still a tag, what lies in it is not
        inside = state(own & ~F.col("ending"), own & F.col("ending")) & ~own
        rows = rows.withColumn("hidden", F.col("hidden") | inside)
    rows = rows.filter(~F.col("hidden") & ~F.col("s").isin("<!--", "-->") & ~F.col("s").rlike("^<[!?].*>$"))
    counted = F.col("name").isNotNull() & ~F.col("name").isin(*VOID) & ~F.endswith("s", F.lit("/>"))
    return rows.select(key, "pos", "s", "name", (counted & ~F.col("ending")).alias("opens"), (counted & F.col("ending")).alias("closes"))


def elements(rows: DataFrame, key: str) -> DataFrame:
    """Tokens with the place of the tag that closes what they open; null where they open nothing, a large number where nothing closes it."""
    along = Window.partitionBy(key, "name").orderBy("pos")
    step = F.col("opens").cast("int") - F.col("closes").cast("int")
    rows = rows.withColumn("sum", F.sum(step).over(along))
    floor = F.least(F.lit(0), F.min("sum").over(along))
    rows = rows.withColumn("depth", F.col("sum") - floor)  # after the token
    level = F.when(F.col("opens"), F.col("depth")).when(F.col("closes"), F.col("depth") + 1)
    stray = F.col("closes") & (F.col("sum") == floor) & (F.col("sum") < F.coalesce(F.least(F.lit(0), F.min("sum").over(along.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0)))
    rows = rows.withColumn("level", F.when(~stray, level))
    pairs = Window.partitionBy(key, "name", "level").orderBy("pos")
    return rows.withColumn("end", F.when(F.col("opens"), F.coalesce(F.lead("pos").over(pairs), F.lit(1 << 30)))).drop("sum", "depth", "level")


def inside(rows: DataFrame, key: str, which: Column) -> Column:
    """Whether a token lies in an element that which picks, by its opening tag."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(which, F.col("end"))).over(before) > F.col("pos"), F.lit(False))


def paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, nth, text) of every paragraph, from 1."""
    rows = elements(tokens(pages, key, html), key)
    classes = attribute(F.col("s"), "class")
    dropped = F.col("opens") & (F.col("name").isin(*DROPPED) | (attribute(F.col("s"), "role") == "navigation") | F.exists(F.array(*map(F.lit, DROPPED_CLASSES)), lambda c: F.contains(classes, c)))
    rows = rows.withColumn("dropped", dropped).withColumn("gone", inside(rows, key, F.col("dropped")))
    main = F.col("opens") & ~F.col("gone") & ~F.col("dropped") & ((F.col("name") == "main") | (attribute(F.col("s"), "id") == "maincontent"))
    rows = rows.withColumn("main", main).withColumn("in_main", inside(rows, key, F.col("main")))
    along = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("para", F.count_if(F.col("name").isin(*BLOCKS)).over(along)).withColumn("has_main", F.max("main").over(Window.partitionBy(key)))
    kept = rows.filter(F.col("name").isNull() & ~F.col("gone") & (F.col("in_main") | ~F.col("has_main")))
    whole = kept.groupBy(key, "para").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("raw"))
    text = F.trim(F.regexp_replace(T.unescape_html(F.col("raw")), r"[\s\x{A0}]+", " "))
    full = whole.select(key, "para", text.alias("text")).filter(F.char_length("text") >= 2)
    return full.select(key, F.row_number().over(Window.partitionBy(key).orderBy("para")).cast("long").alias("nth"), "text")
