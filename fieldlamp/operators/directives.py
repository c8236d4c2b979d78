"""Conditional content: ``{{#if flag}} .. {{else}} .. {{/if}}``, ``{{#unless flag}}``, nested to any depth, and inline ``[[call n]]``.

Marks and text between them are tokens. The depth of a mark is a running sum; the marks of one block are neighbours among those of their depth, so a block's hidden branch is an interval of
tokens, and text is shown if no hidden interval holds it. Nothing recurses, so depth costs nothing.

Errors are rows, with the place (in code points, from 0) of the mark that is wrong: an else or an end without a block, a second else, an end of the other kind, a block that is never closed, a
flag that nobody sets. A document with an error has no text. Flags whose names begin with ``scenario:`` are off unless they are set.

Defined results: a null text is empty; the last of repeated flags of a document doesn't count, they are or-ed; equal keys are one document, so keys should be unique; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPENS = r"\{\{#(?:if|unless)\s+[\w:-]+\s*\}\}"
MARK = rf"{OPENS}|\{{\{{else\}}\}}|\{{\{{/(?:if|unless)\}}\}}"
CALL = r"\[\[call ([^\]]+)\]\]"
MOST_FLAGS = 6


def marks(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, at, s, what, kind, name) of texts and marks in order; what is open, else, close or text. Columns of the document in carry come along."""
    body = F.coalesce(F.col(text), F.lit(""))
    apart = F.regexp_replace(body, f"({MARK})", "\u0001$1\u0001")  # marks between signs that texts don't hold
    rows = docs.select(key, *carry, F.posexplode(F.split(apart, "\u0001")).alias("pos", "s"))
    kind = F.regexp_extract("s", r"^\{\{[#/](if|unless)", 1)
    what = F.when(F.col("s").rlike(f"^(?:{OPENS})$"), "open").when(F.col("s") == "{{else}}", "else").when(F.col("s").rlike(r"^\{\{/(?:if|unless)\}\}$"), "close").otherwise("text")
    size = F.sum(F.char_length("s")).over(Window.partitionBy(key).orderBy("pos")) - F.char_length("s")
    return rows.select(key, *carry, "pos", size.alias("at"), "s", what.alias("what"), kind.alias("kind"), F.regexp_extract("s", r"^\{\{#\w+\s+([\w:-]+)", 1).alias("name"))


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """Marks and texts with their block: its level, the place of its opening mark, and that of its next mark."""
    along = Window.partitionBy(key).orderBy("pos")
    step = F.when(F.col("what") == "open", 1).when(F.col("what") == "close", -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(step).over(along))
    level = F.when(F.col("what") == "close", F.col("depth") + 1).when(F.col("what") != "text", F.col("depth"))
    rows = rows.withColumn("level", level)
    same = Window.partitionBy(key, "level").orderBy("pos")
    opened = F.when(F.col("what") == "open", F.struct("pos", "kind", "name"))
    rows = rows.withColumn("block", F.when(F.col("level").isNotNull(), F.last(opened, True).over(same))).withColumn("was", F.lag("what").over(same))
    return rows.withColumn("next", F.when(F.col("level").isNotNull(), F.lead("pos").over(same))).withColumn("then", F.when(F.col("level").isNotNull(), F.lead("what").over(same)))


def wrong() -> Column:
    """What is wrong with a mark of blocks(), null if nothing is."""
    return (
        F.when(F.col("what").isin("else", "close") & (F.col("level") < 1), "without a block")
        .when((F.col("what") == "else") & (F.col("was") == "else"), "second else")
        .when((F.col("what") == "close") & (F.col("kind") != F.col("block.kind")), "closed by the other kind")
        .when((F.col("what") == "open") & (F.col("then").isNull() | (F.col("then") == "open")), "never closed")
        .when((F.col("what") == "else") & (F.col("then").isNull() | (F.col("then") == "open")), "never closed")
    )


def problems(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(key, at, problem) of the first thing that is wrong in each document. known: (key, flag) that are set."""
    rows = blocks(marks(docs, key, text), key)
    found = rows.withColumn("problem", wrong()).filter("problem is not null").select(key, "at", "problem")
    if known is not None:
        used = rows.filter((F.col("what") == "open") & ~F.startswith("name", F.lit("scenario:"))).select(key, "at", F.col("name").alias("flag"))
        found = found.unionByName(used.join(known.select(key, "flag").distinct(), [key, "flag"], "left_anti").select(key, "at", F.lit("unknown flag").alias("problem")))
    return found.groupBy(key).agg(F.min(F.struct("at", "problem")).alias("p")).select(key, "p.at", "p.problem")


def resolved(docs: DataFrame, flags: DataFrame, key: str = "doc_id", text: str = "text", no_phones: str = "find help in person ({n})") -> DataFrame:
    """(key, text) of documents without problems, with what the flags (key, flag, value) show. Calls are "call n" unless the flag phones is off."""
    values = flags.groupBy(key, "flag").agg(F.max("value").alias("value"))
    sound = docs.join(problems(docs, key, text, values), key, "left_anti").select(key, text)
    rows = blocks(marks(sound, key, text), key)
    value = values.select(key, F.col("flag").alias("block_name"), "value")
    rows = rows.withColumn("block_name", F.col("block.name")).join(value, [key, "block_name"], "left")
    on = F.coalesce("value", F.lit(False)) != (F.col("block.kind") == "unless")
    # the branch after a mark is hidden up to the block's next mark
    hides = F.when(F.col("what") == "open", ~on).when(F.col("what") == "else", on).otherwise(False)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.coalesce(F.max(F.when(hides, F.col("next"))).over(before) > F.col("pos"), F.lit(False))
    shown = rows.withColumn("hidden", hidden).filter((F.col("what") == "text") & ~F.col("hidden"))
    whole = shown.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("s"))
    phones = values.filter("flag = 'phones'").select(key, F.col("value").alias("phones"))
    told = sound.select(key).join(whole, key, "left").join(phones, key, "left")
    return told.select(key, F.coalesce(called(F.col("s"), F.col("phones"), no_phones), F.lit("")).alias(text))


def called(s: Column, phones: Column, no_phones: str) -> Column:
    return F.when(F.coalesce(phones, F.lit(True)), F.regexp_replace(s, CALL, "call $1")).otherwise(F.regexp_replace(s, CALL, no_phones.replace("{n}", "$1")))


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, names) of documents with MOST_FLAGS flags at most (phones is one, if there are calls)."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.regexp_extract_all(body, F.lit(r"\{\{#(?:if|unless)\s+([\w:-]+)\s*\}\}"), F.lit(1))
    names = F.array_sort(F.array_distinct(F.concat(own, F.when(body.rlike(CALL), F.array(F.lit("phones"))).otherwise(F.array().cast("array<string>")))))
    return docs.select(key, text, names.alias("names")).filter(F.size("names") <= MOST_FLAGS)


def every_set(rows: DataFrame) -> DataFrame:
    """rows (names) with every combination (set, flags): the bits of set from the highest are the names in order, and a flag is on if its bit is 0."""
    sets = rows.select("*", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("names")).cast("int") - 1)).alias("set")).withColumn("set", F.col("set").cast("long"))
    bit = lambda n, i: F.floor(F.col("set") / F.pow(F.lit(2), F.size("names") - 1 - i)) % 2 == 0
    return sets.withColumn("flags", F.map_from_arrays("names", F.transform("names", bit)))


def flag_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, set, flags) of every combination of a document's flags (and of phones, if it has calls): 2^n rows, flags a map. Documents with more than MOST_FLAGS flags
    have none; they are too many to be looked through."""
    return every_set(named(docs, key, text).select(key, "names")).select(key, "set", "flags")


def branches(docs: DataFrame, key: str = "doc_id", text: str = "text", no_phones: str = "find help in person ({n})") -> DataFrame:
    """(key, set, flags, text): what each combination of a document's flags shows. The tokens of a document are looked at once for all of them: a running sum for each flag and value
    counts the branches around a text that the value hides, so a text knows the values that hide it, as bits, and a combination takes the texts that none of its values hides."""
    rows = blocks(marks(named(docs, key, text), key, text, ("names",)), key)
    # the branch that a mark begins or ends is hidden by one value of its block's flag: twice the flag's place, and one more if by true
    place, unless = 2 * (F.array_position("names", F.col("block.name")) - 1), (F.col("block.kind") == "unless").cast("int")
    first, second = place + unless, place + 1 - unless
    begins = F.when(F.col("what") == "open", first).when(F.col("what") == "else", second)
    ends = F.when(F.col("what") == "else", first).when(F.col("what") == "close", F.when(F.col("was") == "else", second).otherwise(first))
    rows = rows.select(key, "names", "pos", "s", "what", begins.alias("begins"), ends.alias("ends"), wrong().alias("problem"))
    along = Window.partitionBy(key).orderBy("pos")
    around = lambda c: F.sum(F.when(F.col("begins") == c, 1).otherwise(0) - F.when(F.col("ends") == c, 1).otherwise(0)).over(along)
    rows = rows.select("*", *[around(c).alias(f"around{c}") for c in range(2 * MOST_FLAGS)])
    bits = lambda on: sum((F.when((F.size("names") > i) & (F.col(f"around{2 * i + on}") > 0), F.pow(F.lit(2), F.size("names") - 1 - i).cast("long")).otherwise(0) for i in range(MOST_FLAGS)), F.lit(0))
    shown = F.when(F.col("what") == "text", F.struct("pos", "s", bits(0).alias("off"), bits(1).alias("on")))
    whole = rows.groupBy(key).agg(F.first("names").alias("names"), F.count("problem").alias("problems"), F.sort_array(F.collect_list(shown)).alias("pieces"))
    sets = every_set(whole.filter("problems = 0").select(key, "names", "pieces"))
    open_ = F.filter("pieces", lambda x: (x["off"].bitwiseAND(F.col("set")) == 0) & (x["on"].bitwiseAND(F.bitwise_not("set")) == 0))
    told = F.array_join(F.transform(open_, lambda x: x["s"]), "")
    return sets.select(key, "set", "flags", told.alias("s")).select(key, "set", "flags", called(F.col("s"), F.col("flags")["phones"], no_phones).alias(text))
