"""Corpus preparation: repeated edge lines, page statistics, sections, best windows, chapters, paragraphs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import bounded


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))


def edge_lines(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.25, least: int = 3) -> DataFrame:
    """First and last lines that stand on many pages of a document: digits do not tell lines apart."""
    x = pages.select(doc, page, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("l"))
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\d+", "#")))
    edges = x.select(doc, page, F.explode(F.array_distinct(F.array(key(F.get("l", F.lit(0))), key(F.element_at("l", -1))))).alias("line")).filter("line <> ''")
    n = x.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"))
    found = edges.groupBy(doc, "line").agg(F.count(F.lit(1)).alias("on_pages")).join(n, doc)
    return found.filter(F.col("on_pages") >= F.greatest(F.lit(float(least)), F.col("pages") * share))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 120, most_garble: float = 0.03) -> DataFrame:
    """Words, share of garbled words, share of short lines, and whether a text is too damaged to use. A line is short below
    half the middle length of its text."""
    filled = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), F.trim), lambda x: x != "")
    parts = docs.select(key, F.explode(F.array(F.struct(F.array_sort(F.transform(filled, F.char_length)).alias("sizes"), T.words(F.col(text)).alias("words")))).alias("p"))
    spelt = lambda w: F.regexp_count(w, F.lit(r"\p{L}")) >= 3
    share = lambda part, of: F.round(F.coalesce(F.try_divide(part, of), F.lit(1.0)), 6)
    middle = F.get("p.sizes", F.floor(F.size("p.sizes") / 2).cast("int"))
    out = parts.select(
        key, F.size("p.words").cast("long").alias("words"),
        share(F.size(F.filter("p.words", lambda w: spelt(w) & T.is_garbled(w))), F.size(F.filter("p.words", spelt))).alias("garble"),
        share(F.size(F.filter("p.sizes", lambda n: 2 * n < middle)), F.size("p.sizes")).alias("short_share"),
    )
    return out.withColumn("damaged", (F.col("words") < least_words) | (F.col("garble") > most_garble))


def tasks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Items of Markdown task lists outside fenced code, in order: (key, nth, done, task)."""
    x = lines(docs, key, text)
    along = Window.partitionBy(key).orderBy("pos")
    x = x.withColumn("inside", F.sum(F.startswith("line", F.lit("```")).cast("int")).over(along) % 2 == 1)
    item = r"^\s*[-*+] \[([ xX])\] +(\S.*)$"
    found = x.filter(~F.col("inside") & F.col("line").rlike(item))
    done, task = (F.regexp_extract("line", item, i) for i in (1, 2))
    return found.select(key, F.row_number().over(along).cast("long").alias("nth"), (F.lower(done) == "x").alias("done"), F.trim(task).alias("task"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of Markdown at '## ' outside fenced code: (key, section, title, body)."""
    x = lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("pos")
    fence = F.startswith("line", F.lit("```")).cast("int")
    x = x.withColumn("inside", F.sum(fence).over(w) % 2 == 1)
    head = F.startswith("line", F.lit("## ")) & ~F.col("inside")
    x = x.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("long")).over(w))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    return x.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.substr("line", F.lit(4)))).alias("title"), F.trim(body).alias("body"))


def best_window(blocks: DataFrame, key: str, budget: int, coverage: float = 10.0) -> DataFrame:
    """The best run of successive blocks (key, pos, cost, hits, terms: the query terms in it) within a budget: hits and
    ``coverage`` for each distinct term of the run, less a thousandth of its start; ties go to the first. A block beyond the
    budget is a run by itself. A run reaches only as far as the budget, so what a start meets is bounded by it."""
    w = Window.partitionBy(key).orderBy("pos")
    s = blocks.withColumn("end", F.sum(F.least("cost", F.lit(budget))).over(w)).withColumn("begin", F.col("end") - F.least("cost", F.lit(budget)))
    a = s.select(key, F.col("pos").alias("start"), "begin", F.floor(F.col("begin") / budget).alias("cell"))
    b = s.select(key, F.col("pos").alias("stop"), "end", "cost", "hits", "terms", F.explode(F.array_distinct(F.array(F.floor(F.col("end") / budget), F.floor(F.col("end") / budget) - 1))).alias("cell"))
    runs = a.join(b, [key, "cell"]).filter((F.col("stop") >= F.col("start")) & (F.col("end") - F.col("begin") <= budget))
    upto = Window.partitionBy(key, "start").orderBy("stop")
    runs = runs.withColumn("held", F.sum("hits").over(upto)).withColumn("met", F.size(F.array_distinct(F.flatten(F.collect_list("terms").over(upto)))))
    scored = runs.select(key, "start", "stop", F.round(F.col("held") + coverage * F.col("met") - 0.001 * F.col("start"), 6).alias("score"))
    order = Window.partitionBy(key, "start").orderBy(F.desc("stop"))  # a start takes all that fits
    longest = scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
    best = longest.groupBy(key).agg(F.max(F.struct("score", (-F.col("start")).alias("first"), "stop")).alias("b"))
    return best.select(key, (-F.col("b.first")).alias("start"), "b.stop", "b.score")


def chapters(rows: DataFrame, key: str, cut: int = 4000, least: int = 300) -> DataFrame:
    """(key, chapter, first, words): runs of blocks (key, pos, heading, words) are cut at the first heading after ``cut`` words;
    chapters of fewer than ``least`` join the next. The count starts anew at each cut, so a document's blocks are walked in order:
    a task walks all its documents, sorted, and holds one document's chapters."""

    def fold(out: list[list[int]]) -> list[list[int]]:
        folded: list[list[int]] = []
        carry = None
        for first, n in out:
            if carry:
                first, n, carry = carry[0], carry[1] + n, None
            if n < least:
                carry = [first, n]
            else:
                folded.append([first, n])
        if carry:
            if folded:
                folded[-1][1] += carry[1]
            else:
                folded.append(carry)
        return folded

    def walk(batches):
        at, out, total, first, begun, kind = None, [], 0, None, False, None

        def told(done):
            made = [(k, i, *x) for k, runs in done for i, x in enumerate(fold(runs), 1)]
            cols = list(zip(*made)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[key, "chapter", "first", "words"])

        for batch in batches:
            done, kind = [], batch.schema.field(key).type
            for k, pos, heading, n in zip(*(batch.column(c).to_pylist() for c in (key, "pos", "heading", "words"))):
                if not begun or k != at:
                    if begun:
                        done.append((at, [*out, [first, total]]))
                    at, out, total, first, begun = k, [], 0, pos, True
                if heading and total >= cut:
                    out.append([first, total])
                    total, first = 0, pos
                total += n
            yield told(done)
        if begun:
            yield told([(at, [*out, [first, total]])])

    sorted_rows = rows.select(key, "pos", "heading", "words").repartition(key).sortWithinPartitions(key, "pos")
    bounded(rows.sparkSession)
    return sorted_rows.mapInArrow(walk, f"{key} {dict(rows.dtypes)[key]}, chapter long, first long, words long")


def seen_before(rows: DataFrame, doc: str, page: str, line: str, pages: int = 4) -> DataFrame:
    """Marks a heading that stood on one of the ``pages`` pages just before; a page may have several."""
    w = Window.partitionBy(doc, line).orderBy(page).rangeBetween(-pages, -1)
    return rows.withColumn("repeats", F.count(F.lit(1)).over(w) > 0)


def links(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """Absolute and root-relative links of a page without fragments, each once, in order."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']([^"'#]+)"""), F.lit(1))
    root = F.regexp_extract(F.col(base), r"^(https?://[^/]+)", 1)
    absolute = F.transform(hrefs, lambda h: F.when(h.rlike("^https?://"), h).when(F.startswith(h, F.lit("/")), F.concat(root, h)))
    clean = F.array_distinct(F.filter(absolute, lambda h: h.isNotNull()))
    return pages.select(key, F.posexplode(clean).alias("pos", "link"))


PACKED = 64


def sentence_chunks(text: Column, most: int = 600) -> Column:
    """Sentences packed greedily into texts of at most ``most`` characters; a longer sentence is cut between words first, and
    only a single longer word stands alone."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    sentences = F.filter(F.split(clean, r"(?<=[.!?;:])\s+"), lambda x: x != "")
    none = F.array().cast("array<string>")

    def pack(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.char_length(last) + F.char_length(x) + 1 <= most)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, x)))).otherwise(F.concat(acc, F.array(x)))

    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.char_length(s) <= most, F.array(s)).otherwise(F.aggregate(F.split(s, " "), none, pack))))
    # pieces are packed in groups, so that what is copied at each step stays short
    many = lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: (i % PACKED == 0) & (i < F.size(p))), lambda i: F.slice(p, i + 1, F.lit(PACKED)))
    groups = F.flatten(F.transform(F.array(pieces), many))
    begin = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("last"))

    def further(acc, group):
        both = F.transform(F.array(F.aggregate(group, acc["last"], pack)), lambda r: F.struct(F.slice(r, F.lit(1), F.size(r) - 1).alias("done"), F.slice(r, F.size(r), F.lit(1)).alias("last")))[0]
        return F.transform(F.array(both), lambda x: F.struct(F.concat(acc["done"], F.array(x["done"])).alias("done"), x["last"].alias("last")))[0]

    return F.aggregate(groups, begin, further, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))
