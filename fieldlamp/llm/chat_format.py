"""Chat formatting as relational expressions: sort the collected turns, merge neighbours of one role by array
aggregation, concatenate; every step is a Spark expression, and linear in the length of a conversation.

A conversation becomes one text of merged turns::

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_next|>TEXT...]<|im_end|>\\n

Neighbouring turns of one role share a header; the separator between their texts keeps them apart, so the output
can be read back turn by turn. Inside roles and texts a backslash is doubled and the control strings of common
templates get a backslash after their first character, so no control string survives in a text and
``unescape`` gives it back exactly. ``loss_spans`` marks (start, length) in code points of what the loss covers:
each assistant text, without markers and separators.

Defined results: a null text or role is empty; a null turn sorts first; rows that tie on ``turn`` sort by role, then
text, and repeated rows stay; a null conv_id is a conversation; an empty table gives an empty table; columns other
than the four named are ignored. A conversation is one output row by definition, so it has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The markers of the output, and the control strings (as a pattern with two groups) that texts may
#: not contain unescaped.
START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"
CONTROL = r"([<\[])(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of (conv_id, turn, role, text). Every step is linear in the turns of a conversation: places in the
    output are a running sum, runs of one role are slices of the sorted array."""
    plain = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = F.coalesce(F.col("role").cast("string"), F.lit(""))
    order = [F.col("turn"), F.col("own"), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    along = Window.partitionBy("conv_id").orderBy(*order)
    opens = F.coalesce(F.lag("own").over(along) != F.col("own"), F.lit(True))
    closes = F.coalesce(F.lead("own").over(along) != F.col("own"), F.lit(True))
    rows = turns.select("conv_id", "turn", "role", "text", own.alias("own")).select(
        "conv_id", "own", opens.alias("opens"), closes.alias("closes"), plain("role").alias("role"), plain("text").alias("s"), F.row_number().over(along).alias("place")
    )
    head = F.when(F.col("opens"), F.char_length("role") + len(START) + len(SEP)).otherwise(len(NEXT)).cast("long")
    size = F.char_length("s").cast("long")
    upto = F.sum(head + size + F.when(F.col("closes"), len(END)).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    span = F.when(F.col("own") == loss_role, F.struct((F.coalesce(upto, F.lit(0)) + head + 1).alias("start"), size.alias("length")))
    turn = F.struct("place", "opens", "role", "s", span.alias("span"))
    ordered = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    heads = F.transform(F.filter("t", lambda x: x["opens"]), lambda x: x["place"])
    cut = ordered.withColumn("heads", heads)
    texts = lambda first, next_: F.transform(F.slice("t", first, next_ - first), lambda x: x["s"])
    run = lambda first, k: F.struct(F.element_at("t", first)["role"].alias("role"), texts(first, F.coalesce(F.get("heads", k + 1), F.size("t") + 1)).alias("texts"))
    merged = cut.select("conv_id", "t", F.transform("heads", run).alias("runs"))
    said = F.transform("runs", lambda r: F.concat(F.lit(START), r["role"], F.lit(SEP), F.array_join(r["texts"], NEXT), F.lit(END)))
    return merged.select("conv_id", F.array_join(said, "").alias("formatted"), F.transform(F.filter("t", lambda x: x["span"].isNotNull()), lambda x: x["span"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    runs = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda r: F.char_length(r) > 0)

    def turns_of(run: Column) -> Column:
        parts = F.split(F.substring(run, len(START) + 1, 1 << 30), r"\Q" + SEP + r"\E", -1)
        role = unescape(parts[0])
        return F.transform(
            F.split(parts[1], r"\Q" + NEXT + r"\E", -1),
            lambda x: F.struct(role.alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(runs, turns_of))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Code points are four bytes each here, so that a span is found at once."""
    cut = lambda b: F.transform(spans, lambda s: unescape(F.decode(F.substring(b, (s["start"] * 4 - 3).cast("int"), (s["length"] * 4).cast("int")), "UTF-32")))
    return F.array_join(F.flatten(F.transform(F.array(F.encode(formatted, "UTF-32")), cut)), "")
