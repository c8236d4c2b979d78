"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Texts are lower-cased words of letters and digits. Fixed masks select some of SPAN successive words and ignore the
others; every window of every text is hashed under each mask, and equal hashes of a test item and a training document
propose an alignment. An overlap is verified on the words around the hit: some WINDOW words at that alignment
must agree in at least ``NEED`` places. The masks find every such overlap: two substitutions in WINDOW words, and, with
the two further masks that are used when there are items of fewer words, one substitution in SPAN to WINDOW - 1 words (a
unit test tries all placements).

Scale: what the join shuffles is not all window hashes. The test hashes set bits of a table (two bits a hash, ``BITS`` bits
of room for each, 256 KB at least and 16 MB at most); document windows that miss a bit are left inside the scan. The
table only filters: however full it gets, the join on hashes decides. Hits of a passage that a third of all documents
share meet in the hash join, where Spark splits skewed partitions; verification goes back to one row a document.

Defined results: a null text has no words; an overlap has SPAN words of item and document at least, so items with fewer
words are never found; items shorter than WINDOW need the same share of agreement over their whole length; repeated
items and rows give a pair each way (a pair of ids is returned once, with its best values); a null id stays a null id;
other columns are ignored; empty tables give an empty table; long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

#: The masks, as the offsets that count; those of SHORT_MASKS are for items of SPAN to WINDOW - 1 words.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SHORT_MASKS = ((2, 4, 5, 6, 7), (0, 1, 2, 3, 4, 5))
ALL_MASKS = MASKS + SHORT_MASKS
SPAN, WINDOW, NEED = 8, 13, 11
LEAST_SLOTS, MOST_SLOTS, BITS = 1 << 15, 1 << 21, 32  # slots of 64 bits
TOKEN = r"[\p{L}\p{N}]++"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seed(h: Column, i: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(h, i + F.lit(k)) for k in ALL_MASKS[mask]])


def places(h: Column) -> Column:
    """First positions of all windows."""
    return F.when(F.size(h) >= SPAN, F.sequence(F.lit(0), F.size(h) - F.lit(SPAN))).otherwise(F.array().cast("array<int>"))


def slots_for(hashes: int) -> int:
    """A power of two."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << max(0, hashes * BITS // 64 - 1).bit_length()))


def bit_table(index: DataFrame, slots: int) -> DataFrame:
    """One row: the table as array<long>."""
    bits = index.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("x"))
    bits = bits.groupBy(slot(F.col("x"), slots).alias("slot")).agg(F.bit_or(bit(F.col("x"))).alias("bits"))
    every = index.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    row = every.join(bits, "slot", "left").select("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return row.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda s: s["bits"]).alias("t"))


def slot(x: Column, slots: int) -> Column:
    return F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(slots - 1)).cast("int")


def bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def overlaps(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, window_agreement, agreement) of every contaminated pair: the best window at any alignment,
    and the most words that agree at one alignment."""
    tests = staged(
        items.select(F.col("item_id").cast("long").alias("item_id"), hashes(F.col("text").cast("string")).alias("item")).withColumn("item_row", F.monotonically_increasing_id()),
        "seed-items",
    )

    def seeds(mask: int) -> Column:
        found = F.transform(places(F.col("item")), lambda i: F.struct(i.alias("at"), seed(F.col("item"), i, mask).alias("hash")))
        return found if mask < len(MASKS) else F.when(F.size("item") < WINDOW, found).otherwise(F.slice(found, 1, 0))

    short = tests.filter(F.size("item").between(SPAN, WINDOW - 1)).limit(1).count()
    masks = range(len(ALL_MASKS) if short else len(MASKS))
    index = tests.select("item_row", F.explode(F.concat(*[seeds(m) for m in masks])).alias("s"))
    index = staged(index.select("item_row", F.col("s.at").alias("item_at"), F.col("s.hash").alias("hash")), "seed-index")
    slots = slots_for(index.count())
    table = staged(bit_table(index, slots), "seed-table").scalar()

    def probable(x: Column) -> Column:
        return F.get(F.col("t"), slot(x, slots)).bitwiseAND(bit(x)) != F.lit(0).cast("long")

    def hits(mask: int) -> Column:
        h = F.col("h")

        def found(i: Column) -> Column:
            x = seed(h, i, mask)
            return probable(x) & probable(F.shiftrightunsigned(x, 32))
        return F.transform(F.filter(places(h), found), lambda i: F.struct(i.alias("at"), seed(h, i, mask).alias("hash")))

    # explode of one array keeps the optimizer from computing the words again within the lambdas
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(hashes(F.col("text").cast("string")))).alias("h"))
    docs = docs.withColumn("t", table).select("doc_id", "h", F.explode(F.array(F.concat(*[hits(m) for m in masks]))).alias("hits"))
    docs = staged(docs.filter(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()), "seed-hits")
    aligned = (
        docs.select("row", F.explode("hits").alias("s"))
        .select("row", F.col("s.at").alias("at"), F.col("s.hash").alias("hash"))
        .join(index, "hash")
        .select("row", "item_row", (F.col("at") - F.col("item_at")).alias("shift"))
        .groupBy("row", "item_row")
        .agg(F.collect_set("shift").alias("shifts"))
    )
    pairs = aligned.join(docs.select("row", "doc_id", "h"), "row").join(tests, "item_row")
    h, item = F.col("h"), F.col("item")

    def compared(shift: Column) -> Column:
        begin = F.greatest(F.lit(0), -shift)
        end = F.least(F.size(item), F.size(h) - shift)  # exclusive
        agree = F.transform(F.sequence(begin, end - 1), lambda i: (F.get(h, i + shift) == F.get(item, i)).cast("int"))
        return F.struct(agree.alias("agree"), F.least(F.lit(WINDOW), F.size(item)).alias("width"))

    def best(c: Column) -> Column:
        add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c["agree"]) - c["width"] + 1))
        return F.struct(
            F.array_max(F.transform(starts, lambda s: add(F.slice(c["agree"], s, c["width"])))).alias("window_agreement"),
            add(c["agree"]).alias("agreement"),
        )

    compares = pairs.select("doc_id", "item_id", F.least(F.lit(WINDOW), F.size(item)).alias("width"), F.explode(F.transform("shifts", compared)).alias("c"))
    scored = compares.select("doc_id", "item_id", "width", F.explode(F.array(best(F.col("c")))).alias("b"))
    passed = scored.filter(F.col("b.window_agreement") * F.lit(WINDOW) >= F.lit(NEED) * F.col("width"))
    return passed.groupBy("doc_id", "item_id").agg(
        F.max("b.window_agreement").cast("long").alias("window_agreement"), F.max("b.agreement").cast("long").alias("agreement")
    )


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents without those that overlap an item."""
    bad = overlaps(documents, items).select(F.col("doc_id").alias("bad_id")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
