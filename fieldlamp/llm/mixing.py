"""Mixing sources to target weights: temperature mixing with budgeted block permutations, in DataFrame functions only.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised. The exponent is the smallest (the
flattest mixture) at which the entropy of the weights is no more than ``entropy_share`` of its maximum and no source
is repeated more than ``max_repeats`` times; both fall with a, so it is bisected: each round evaluates 64 points of
the interval in one aggregation over the table of sources, which halves it six times. Each source then gets its
weight's share of the token budget. Its documents are permuted once an epoch by a hash; whole epochs are taken while
the budget lasts, and of the last epoch the first documents whose running tokens stay within the rest.

Where the last epoch ends is found without putting a source in order: tokens are summed by blocks of the hash's high
bits (1,024 a level, pre-aggregated), the block in which the budget ends is cut again by the next bits, and only the
documents of that last block are ordered. All that remains per source is a hash limit, so documents meet a row a
source; the join is salted because one source may hold a third of all rows.

Defined results: a null source is a source; a null text has no tokens; null or repeated doc_ids share a hash, so such
rows are taken or left together; a corpus without tokens has equal weights and nothing is taken; other columns pass
through ``mix`` unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

SALTS = 16
ROUNDS, POINTS = 5, 64
HASH_DIGITS = 15  # hexadecimal digits of md5 that order an epoch
LEVEL_BITS, LEVELS = 10, 2
WORD = r"[^\x20\x09-\x0D]++"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def epoch_hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in an epoch's permutation: an integer below 2^60."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long")


def exponent(shares: DataFrame, entropy_share: float, max_repeats: float, budget_share: float) -> float:
    """shares: a row a source with its share p. Only one row a round comes back."""
    n = shares.count()
    target = entropy_share
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (hi - lo) / POINTS
        points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda j: F.lit(lo) + F.lit(step) * j)
        x = shares.select("p", F.posexplode(points).alias("j", "a")).filter("p > 0")
        x = x.withColumn("q", F.pow("p", F.col("a")))
        x = x.groupBy("j").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), F.max(F.col("q") / F.col("p")).alias("m"))
        entropy = F.log("z") - F.col("s") / F.col("z")
        good = (entropy <= F.lit(target) * F.log(F.lit(float(max(n, 2)))) + F.lit(1e-9)) & (F.lit(budget_share) * F.col("m") / F.col("z") <= F.lit(max_repeats + 1e-9))
        j = x.filter(good).agg(F.min("j")).first()[0]
        if j is None:
            lo = lo + step * (POINTS - 1)
        elif j == 0:
            hi = lo
        else:
            lo, hi = lo + step * (j - 1), lo + step * j
    return round(hi, 6)


def plan(
    documents: DataFrame, source: str = "source", entropy_share: float = 0.95, max_repeats: float = 4.0, budget_share: float = 1.0, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """The narrow table (doc_id, source, n_tokens) and a row a source: weight, tokens, budget, epochs, cut.
    A document is in every epoch below ``epochs`` and in that epoch if its hash is below ``cut``."""
    narrow = staged(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(source).isNull().alias("unknown"), tokens(F.col("text").cast("string")).alias("n_tokens")),
        "mix-tokens",
    )
    key = ["source", "unknown"]
    totals = staged(narrow.groupBy(key).agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(shares, entropy_share, max_repeats, budget_share)
    powered = shares.withColumn("q", F.when(F.col("p") > 0, F.pow("p", F.lit(a))).otherwise(0.0))
    z = powered.agg(F.sum("q")).first()[0] or 1.0
    budget = int(total * budget_share)
    planned = powered.select(*key, "tokens", F.round(F.col("q") / F.lit(z), 9).alias("weight"))
    planned = planned.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
    planned = planned.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    planned = staged(planned.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-plan")
    return narrow, planned.join(cuts(narrow, planned, seed), key, "left")


def salted(left: DataFrame, right: DataFrame, key: list[str], by: Column) -> DataFrame:
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*key, "salt"]).drop("salt")


def cuts(narrow: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Per source the smallest hash of its last epoch that goes beyond the budget."""
    key = ["source", "unknown"]
    rows = salted(narrow, planned.select(*key, "epochs", "rest"), key, F.col("doc_id"))
    rows = rows.select(*key, "rest", epoch_hash(F.col("doc_id"), F.col("epochs"), seed).alias("h"), "n_tokens")
    shift = 4 * HASH_DIGITS
    for _ in range(LEVELS):
        shift -= LEVEL_BITS
        rows = rows.withColumn("block", F.shiftright("h", shift))
        sums = rows.groupBy(*key, "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
        before = F.sum("t").over(Window.partitionBy(*key).orderBy("block")) - F.col("t")
        ends = sums.withColumn("before", before).filter("before <= rest and before + t > rest")
        rows = rows.drop("rest").join(ends.select(*key, "block", (F.col("rest") - F.col("before")).alias("rest")), [*key, "block"])
    upto = F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("h"))  # rows of one hash count together
    return rows.withColumn("upto", upto).filter("upto > rest").groupBy(key).agg(F.min("h").alias("cut"))


def draw(rows: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """rows (doc_id, source, unknown and others) once for every epoch that takes them, with weight, epoch and place:
    sorted by place (0 to 1), every source is spread evenly over the mixture."""
    found = salted(rows, planned, ["source", "unknown"], F.col("doc_id"))
    last = F.when(epoch_hash(F.col("doc_id"), F.col("epochs"), seed) < F.col("cut"), 1).otherwise(0)
    copies = (F.col("epochs") + last).cast("int")
    found = found.withColumn("copies", copies).filter("copies > 0 and tokens > 0")
    found = found.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("epoch") + epoch_hash(F.col("doc_id"), F.col("epoch"), seed) / F.lit(float(1 << 4 * HASH_DIGITS))
    place = F.round(at / (F.col("budget") / F.col("tokens")), 9)
    return found.withColumn("place", place).drop("copies", "tokens", "budget", "epochs", "rest", "cut")


def mix(documents: DataFrame, source: str = "source", seed: int = 7, **targets) -> DataFrame:
    """documents with their own columns, each row as often as the mixture takes it."""
    names = documents.columns
    _, planned = plan(documents, source, seed=seed, **targets)
    whole = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(source).isNull().alias("unknown"),
    )
    return draw(whole, planned, seed).select("whole.*")
