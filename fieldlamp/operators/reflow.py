"""Lines of printed pages into headings, paragraphs, list items and captions.

What a line is (heading, item, caption, text) and whether it opens a block follow from itself, its neighbours and what lies between: a blank, the
end of a page, a caption. The one thing that is carried further is whether the open block is a list item, as its short last line ends it where a
paragraph would go on. A line therefore either sets that state (it opens a block), leaves it, or turns an item into a paragraph; such steps
compose, so lines are cut into chunks of ``CHUNK_LINES``: windows work inside a chunk, a row a chunk carries the neighbours, the state and the number of
blocks over its edges, and one long book is many tasks' work.

Defined results: a null text has no lines; blank lines are no blocks; control characters but tab and newline are dropped; a caption comes after the block that it interrupts; equal keys are one
document, so keys should be unique; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

CHUNK_LINES = 256
LONGEST_HEADING = 90
SHORT, ITEM_SHORT = 0.55, 0.8  # of a page's usual width
#: How lines of headings, items and captions begin, what ends a sentence, and words that no item ends with.
DIVISION = r"(?i)^(chapter|part|section|appendix|book|volume|lesson|unit)\b"
NUMBERED_TITLE = r"^\d{1,3}(\.\d{1,3})*\.?\s+[A-Z]"
ITEM = r"^([•·▪■●○\-–—*]|\(?([a-z]|[ivx]{1,3}|\d{1,3})[.)])\s+"
MARKED_ITEM = r"^([•·▪■●○\-–—*]|\(?[a-z][.)])\s+"
NUMBERED_ITEM = r"^\(?\d{1,3}[.)]\s+"
CAPTION = r"(?i)^(fig(ure)?|plate|table|photo)\.?\s*\S{1,5}\s*[.:—–-]"
RUN_IN = r"^[A-Z][A-Za-z]{2,}(?: [A-Za-z]{2,}){0,5}\.\s?[—–-]\s"
PAGE_NUMBER = r"(?i)^(page\s+)?\d{1,4}(\s+of\s+\d{1,4})?$|^[ivxlcdm]{1,7}$"
RULE = r"^[\-–—_.·•*=~]{1,4}$"
LEADER = r"(\.\s?){4,}|\s\d{1,4}$"
TERMINAL = r"[.!?:;\"'”’)\]]$"
DANGLING = ("and", "or", "of", "the", "a", "an", "to", "in", "for", "with", "by", "on", "at", "from", "as", "its", "their")
MENDED = "\b"


def caps_ratio(line: Column) -> Column:
    letters = F.char_length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.char_length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def heading_kind(line: Column) -> Column:
    """h1 for a division or a line of capitals, h2 for a numbered title, else null. line is trimmed."""
    letters = F.char_length(F.regexp_replace(line, r"[^\p{L}]", ""))
    never = (F.char_length(line) > LONGEST_HEADING) | line.rlike("[.,;]$") | line.rlike(MARKED_ITEM) | (letters < 3)
    h1 = line.rlike(DIVISION) | ((caps_ratio(line) > 0.85) & (letters >= 4))
    return F.when(~never & h1, "h1").when(~never & line.rlike(NUMBERED_TITLE) & (F.size(F.split(line, r"\s+")) <= 12), "h2")


def is_noise(line: Column) -> Column:
    """Page numbers, rules, and a few letters of grit. line is trimmed."""
    words = F.split(line, r"\s+")
    grit = (F.size(words) <= 4) & (F.char_length(line) <= 12) & ~F.exists(words, lambda w: w.rlike(r"^\p{L}{3,}$"))
    return (line != "") & (line.rlike(PAGE_NUMBER) | line.rlike(RULE) | grit)


def contents_pages(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page) of pages of which half the lines, and six at least, end in a page number or run to one."""
    body = lines.filter("line <> ''").groupBy(key, "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").rlike(LEADER)).alias("refs"))
    return body.filter("n >= 6 and refs * 2 >= n").select(key, "page")


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, page, line): lines from 0; a form feed begins a page."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f￾￿]", "")
    pages = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(clean, "\f")).alias("page", "p"))
    rows = pages.select(key, "page", F.posexplode(F.split("p", "\n")).alias("at", "line"), F.size(F.split("p", "\n")).alias("held"))
    before = pages.select(key, "page", F.size(F.split("p", "\n")).alias("held")).withColumn("before", F.sum("held").over(Window.partitionBy(key).orderBy("page")) - F.col("held"))
    return rows.join(before.select(key, "page", "before"), [key, "page"]).select(key, (F.col("before") + F.col("at")).cast("long").alias("n"), F.col("page").cast("long").alias("page"), tidy(F.col("line")).alias("line"))


def tidy(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def widths(lines: DataFrame, key: str) -> DataFrame:
    """(key, page, width): the upper median of a page's lines."""
    full = lines.filter("line <> ''").withColumn("size", F.char_length("line"))
    return full.groupBy(key, "page").agg(F.expr("percentile_disc(0.5) within group (order by size desc)").cast("int").alias("width"))


def described(lines: DataFrame, key: str) -> DataFrame:
    """Lines with what each is by itself, and their page's width."""
    line = F.col("line")
    x = lines.join(widths(lines, key), [key, "page"], "left").withColumn("c", F.floor(F.col("n") / CHUNK_LINES))
    return x.select(
        key, "n", "page", "line", "c", "width", (line == "").alias("blank"), (line.rlike(CAPTION) & (F.char_length(line) < LONGEST_HEADING)).alias("caption"),
        F.coalesce(heading_kind(line), F.lit("")).alias("title"), line.rlike(ITEM).alias("item"), line.rlike(NUMBERED_ITEM).alias("numbered"), line.rlike(r"^\p{Ll}").alias("lower"), line.rlike(r"^\p{Lu}").alias("upper"),
        line.rlike("^[-–—]").alias("dash"), line.rlike(TERMINAL).alias("ends"), line.endswith("-").alias("hyphen"), line.rlike(r"(^| )[^ -]*\p{L}-$").alias("broken"), line.rlike(RUN_IN).alias("run_in"),
        F.lower(F.substring_index(line, " ", -1)).isin(*DANGLING).alias("hangs"), F.char_length(line).alias("size"),
    )


def with_neighbours(x: DataFrame, key: str) -> DataFrame:
    """Lines with p, the last line of text before (null without one), whether a caption or a blank lies between, and whether the next line is a numbered item."""
    says = F.struct("n", "page", "ends", "hyphen", "broken", "hangs", "size", "title", "item", "numbered", "width", F.lit(False).alias("gap"))
    texty, inside = ~F.col("blank") & ~F.col("caption"), Window.partitionBy(key, "c").orderBy("n")
    after = F.struct("blank", "page")
    x = x.withColumn("next_line", F.lead(after).over(inside)).withColumn("p_own", F.when(texty, says.withField("gap", F.coalesce(F.col("next_line.blank") & (F.col("next_line.page") == F.col("page")), F.lit(False)))))
    edge = x.groupBy(key, "c").agg(
        F.max("p_own").alias("p"), F.max(F.when(F.col("caption"), F.col("n"))).alias("cap"), F.max("n").alias("last"), F.min(F.struct("n", "blank", "page")).alias("first"),
        F.min(F.when(~F.col("blank"), F.struct("n", "numbered"))).alias("full"),
    )
    along = Window.partitionBy(key).orderBy("c")
    # the last line of a chunk is followed by the first of the next
    follows = F.lead("first").over(along)
    gap = F.when((F.col("p.n") == F.col("last")) & follows["blank"] & (follows["page"] == F.col("p.page")), True).otherwise(F.col("p.gap"))
    edge = edge.withColumn("p", F.when(F.col("p").isNotNull(), F.col("p").withField("gap", gap)))
    before, behind = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    edge = edge.select(key, "c", F.last("p", True).over(before).alias("p_far"), F.last("cap", True).over(before).alias("cap_far"), F.first("full", True).over(behind).alias("full_far"))
    earlier, later = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    x = x.withColumn("p_near", F.last("p_own", True).over(earlier)).withColumn("cap_near", F.last(F.when(F.col("caption"), F.col("n")), True).over(earlier))
    x = x.withColumn("full_near", F.first(F.when(~F.col("blank"), F.struct("n", "numbered")), True).over(later))
    x = x.join(edge, [key, "c"]).withColumn("p", F.coalesce("p_near", "p_far"))
    between = F.coalesce(F.coalesce("cap_near", "cap_far") > F.col("p.n"), F.lit(False))
    return x.withColumn("captioned", between).withColumn("then_numbered", F.coalesce(F.coalesce("full_near", "full_far")["numbered"], F.lit(False))).drop("p_own", "p_near", "p_far", "cap_near", "cap_far", "full_near", "full_far", "next_line")


def _closed() -> Column:
    """Whether the block before a line has ended: by a short last line, a blank, or a page whose last sentence has ended."""
    p, blank = F.col("p"), F.col("p.gap") & ~F.col("captioned")
    between = F.when(p["page"] != F.col("page"), p["ends"] | blank).otherwise(blank & ~p["hyphen"])
    return p.isNull() | (p["ends"] & (p["size"] < SHORT * p["width"])) | between


def titles(x: DataFrame) -> DataFrame:
    """Lines whose title is null where it is an item among others, or stands inside a sentence."""
    p = F.col("p")
    among_items = F.col("numbered") & (F.col("title") == "h2") & (F.col("then_numbered") | F.coalesce(p["numbered"], F.lit(False)))
    free = _closed() | p["ends"] | (p["title"] != "")
    return x.withColumn("title", F.when(free & ~among_items, F.col("title")).otherwise("")).drop("p", "captioned", "then_numbered")


def steps(x: DataFrame) -> DataFrame:
    """Lines of text and captions with their step: h1, h2, li or p opens such a block; + goes on; ? goes on, or opens a paragraph after an item."""
    p = F.col("p")
    after_title = F.coalesce(p["title"] != "", F.lit(False))
    same_title = (p["title"] == F.col("title")) & ~p["gap"] & (p["page"] == F.col("page"))
    dash_inside = F.col("dash") & ~_closed() & ~F.coalesce(p["ends"], F.lit(False))
    kind = (
        F.when(F.col("caption"), "caption")
        .when((F.col("title") != "") & same_title, "+")
        .when(F.col("title") != "", F.col("title"))
        .when(F.col("item") & ~dash_inside, "li")
        .when(p.isNull() | after_title, "p")
        .when(F.col("lower"), "+")
        .when(_closed() | (F.col("run_in") & p["ends"]), "p")
        .when(F.col("upper") & (p["size"] < ITEM_SHORT * F.col("width")) & ~p["hangs"], "?")
        .otherwise("+")
    )
    return x.filter(~F.col("blank")).withColumn("step", kind)


def numbered_blocks(x: DataFrame, key: str) -> DataFrame:
    """Lines with the number of their block, from 1, and its kind."""
    inside = Window.partitionBy(key, "c").orderBy("n")
    opens = F.col("step").isin("h1", "h2", "li", "p")
    x = x.withColumn("opens", opens).withColumn("g", F.sum(F.col("opens").cast("int")).over(inside))
    within = Window.partitionBy(key, "c", "g").orderBy("n")
    asks = F.col("step") == "?"
    x = x.withColumn("first_ask", asks & (F.sum(asks.cast("int")).over(within) == 1)).withColumn("own", F.first(F.when(F.col("opens"), F.col("step")), True).over(within))
    # a row a chunk: what it makes of the state, and how many blocks it opens
    turned = F.col("first_ask") & (F.col("own") == "li")
    edge = x.groupBy(key, "c").agg(
        F.max(F.struct("g", F.when(F.col("first_ask"), F.lit(1)).otherwise(0).alias("asked"))).alias("z"), F.max_by("own", F.struct("g", F.col("own").isNotNull())).alias("kind"),
        F.sum(F.coalesce((F.col("opens") | turned).cast("int"), F.lit(0))).alias("sure"), F.max(F.coalesce((F.col("first_ask") & (F.col("g") == 0)).cast("int"), F.lit(0))).alias("lead"),
    )
    along = Window.partitionBy(key).orderBy("c")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    leaves = F.when(F.col("z.g") > 0, F.when((F.col("kind") == "li") & (F.col("z.asked") == 1), "p").otherwise(F.col("kind"))).when(F.col("lead") == 1, "p")
    edge = edge.withColumn("leaves", leaves).withColumn("state", F.last("leaves", True).over(before))
    made = F.col("sure") + F.when(F.col("state") == "li", F.col("lead")).otherwise(0)
    edge = edge.withColumn("before", F.coalesce(F.sum(made).over(before), F.lit(0))).select(key, "c", "state", "before")
    x = x.join(edge, [key, "c"])
    turned = F.col("first_ask") & (F.coalesce("own", "state") == "li")
    x = x.withColumn("opens", F.coalesce(F.col("opens") | turned, F.lit(False)))
    return x.withColumn("block", F.col("before") + F.sum(F.col("opens").cast("int")).over(inside))


def blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, kind, text), blocks in order from 1, of lines (key, n, page, line)."""
    # each step joins its lines with a row a chunk of them, so they are written: else every step would do all before it twice
    described_lines = written(described(written(lines, "printed-lines"), key), "described-lines")
    titled = written(titles(with_neighbours(described_lines, key)), "titled-lines")
    x = numbered_blocks(written(steps(with_neighbours(titled, key)), "line-steps"), key)
    mended = F.col("p.broken") & F.col("lower")
    glue = F.when(F.col("opens"), "").when(mended, MENDED).when(F.col("p.hyphen"), "").otherwise(" ")
    words = F.when(F.col("step") == "li", F.regexp_replace("line", ITEM, "")).otherwise(F.col("line"))
    caption = F.col("step") == "caption"
    rows = x.select(key, "block", F.when(caption, F.col("n")).alias("cap"), F.struct("n", F.when(caption, F.col("line")).otherwise(F.concat(glue, words)).alias("s")).alias("s"), F.when(F.col("opens"), F.when(F.col("step") == "?", "p").otherwise(F.col("step"))).alias("kind"))
    held = rows.groupBy(key, "block", "cap").agg(F.first("kind", True).alias("kind"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["s"]), "").alias("text"))
    text = F.regexp_replace("text", "-" + MENDED, "")
    order = Window.partitionBy(key).orderBy("block", F.col("cap").asc_nulls_first())
    return held.select(key, F.row_number().over(order).cast("long").alias("block"), F.coalesce("kind", F.lit("caption")).alias("kind"), text.alias("text"))


def is_prose(par: Column) -> Column:
    """A paragraph of running text: thirty words, mostly letters, few capitals, neighbouring lower-case words, two sentences or clauses."""
    count = lambda pattern: F.size(F.regexp_extract_all(par, F.lit(pattern), F.lit(0)))
    letters, upper = F.char_length(F.regexp_replace(par, r"[^\p{L}]", "")), F.char_length(F.regexp_replace(par, r"[^\p{Lu}]", ""))
    words = F.size(F.filter(F.split(par, r"\s+"), lambda w: w != ""))
    runs = par.rlike("[a-z]{3,} [a-z]{2,} [a-z]{2,}") & ((count("[.!?]") >= 2) | (count(",") >= 2))
    return (words >= 30) & (letters >= 0.7 * F.char_length(par)) & (upper <= 0.25 * letters) & runs & (count(r"\b(?:CHAPTER|Chapter|PART)\b") < 3)


def spread_windows(text: Column, n: int = 4, size: int = 1200) -> Column:
    """n windows of about size characters, evenly spaced, that begin with a sentence if one begins soon, and end with a word."""

    def window(k: Column) -> Column:
        at = F.floor(F.char_length(text) * (k + 0.5) / n).cast("int")
        whole = F.substr(text, at + 1, F.lit(size + 400))
        head = F.regexp_extract(F.substr(whole, F.lit(1), F.lit(300)), "(?s)^(.*?[.!?] )[A-Z\"'“‘]", 1)
        cut = F.substr(whole, F.char_length(head) + 1, F.lit(size))
        space = F.char_length(cut) - F.char_length(F.substring_index(cut, " ", -1)) - 1
        return F.trim(F.when(space > 0.7 * size, F.substr(cut, F.lit(1), space)).otherwise(cut))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), window)
