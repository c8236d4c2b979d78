"""Retrieval evaluation: first ranks, hit rates, MRR, nDCG, roll-ups, run comparison, gates, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import numbered


def first_rank(results: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, rank): the first place at which a relevant row stands; null for a miss. gold: (qid, key)."""
    hit = results.join(gold.distinct(), ["qid", key]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid").distinct().join(hit, "qid", "left")


def nearest_rank(values: str, share: float) -> Column:
    """A percentile that is one of the values: the ceil(share * n)-th. Values are counted before they are shuffled."""
    return F.expr(f"percentile_disc({share}) within group (order by {values})")


def metrics(rank: Column, latency: str | None = None) -> list[Column]:
    rate = lambda k: F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}")
    within = rank <= 10
    out = [
        F.count(F.lit(1)).alias("n"), *map(rate, (1, 3, 5, 10)),
        F.round(F.avg(F.when(within, 1.0 / rank).otherwise(0.0)), 6).alias("mrr10"),
        F.round(F.avg(F.when(within, F.ln(F.lit(2.0)) / F.ln(rank + 1.0)).otherwise(0.0)), 6).alias("ndcg10"),
    ]
    return out + ([] if latency is None else [F.percentile(latency, 0.5).alias("median"), nearest_rank(latency, 0.95).alias("p95")])


def rollup(records: DataFrame, rank: str = "rank") -> DataFrame:
    """Metrics by set, by set and group where a row has a group, and over all."""
    r = F.col(rank)
    out = records.groupingSets([["set"], ["set", "group"], []], "set", "group").agg(*metrics(r), F.grouping("set").alias("all_sets"), F.grouping("group").alias("all_groups"))
    label = F.when(F.col("all_sets") == 1, "ALL").when(F.col("all_groups") == 1, F.col("set")).otherwise(F.concat_ws("/", "set", "group"))
    return out.filter("all_groups = 1 or `group` is not null").withColumn("label", label).drop("all_sets", "all_groups", "set", "group")


def compare(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    """(qid, verdict) of two runs (qid, rank): rescued, regressed, better, worse, same, only_a, only_b."""
    x = a.select("qid", F.col("rank").alias("ra"), F.lit(True).alias("in_a")).join(b.select("qid", F.col("rank").alias("rb"), F.lit(True).alias("in_b")), "qid", "full")
    ha, hb = F.coalesce(F.col("ra") <= top, F.lit(False)), F.coalesce(F.col("rb") <= top, F.lit(False))
    verdict = (
        F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(~ha & hb, "rescued").when(ha & ~hb, "regressed")
        .when(ha & hb & (F.col("rb") < F.col("ra")), "better").when(ha & hb & (F.col("rb") > F.col("ra")), "worse").otherwise("same")
    )
    return x.select("qid", verdict.alias("verdict"))


def gates(rates: DataFrame, least: dict[str, float], most_regression: float = 0.05) -> DataFrame:
    """Per run (run, metric, value): whether it passes its gate and holds against the run before it."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("run"))
    floor = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in least.items()], F.lit(None).cast("double"))
    x = rates.withColumn("before", before).withColumn("floor", floor)
    return x.select("run", "metric", "value", (F.col("floor").isNull() | (F.col("value") >= F.col("floor"))).alias("passes"), F.coalesce(F.col("before") - F.col("value") <= most_regression, F.lit(True)).alias("holds"))


def paired_bootstrap(pairs: DataFrame, by: str = "set", resamples: int = 4000, seed: int = 7) -> DataFrame:
    """Per group of (by, a, b): mean difference b - a, its 95 % interval, wins, losses, ties. Differences are counted by
    value first (ranks give few), so a group's resampling costs the same at any size."""
    counted = pairs.withColumn("d", F.round(F.col("b") - F.col("a"), 6)).groupBy(by, "d").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, n = pdf["d"].to_numpy(), pdf["n"].to_numpy()
        total = int(n.sum())
        draws = np.random.default_rng(seed).multinomial(total, n / total, resamples) @ d / total
        low, high = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "diff": [float(d @ n / total)], "low": [low], "high": [high], "wins": [int(n[d > 0].sum())], "losses": [int(n[d < 0].sum())], "ties": [int(n[d == 0].sum())]})

    return counted.groupBy(by).applyInPandas(run, f"{by} {dict(pairs.dtypes)[by]}, diff double, low double, high double, wins long, losses long, ties long")


def halves(rows: DataFrame, part: str = "set", key: str = "qid") -> DataFrame:
    """Even and odd rows of each set, in order of the key."""
    return numbered(rows, part, [key]).withColumn("half", F.pmod(F.col("place") - 1, F.lit(2)).cast("long")).drop("place")


def first_match(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank) like ``first_rank`` where gold names urls: a result matches one of its query's urls or lies under it."""
    from ..functions import text as T

    pairs = results.join(gold.select("qid", F.col("url").alias("wanted")).distinct(), "qid").filter(T.url_matches(F.col("url"), F.col("wanted")))
    return gold.select("qid").distinct().join(pairs.groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")


def covered(results: DataFrame, gold: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(qid, relevant, found, coverage, ndcg) with many relevant rows a query; the ideal list begins with k of them at most."""
    gain = F.ln(F.lit(2.0)) / F.ln(F.col("rank") + 1.0)
    wanted = gold.select("qid", key).distinct()
    hit = results.filter(F.col("rank") <= k).join(wanted, ["qid", key]).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.sum(gain).alias("dcg"))
    size = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + F.ln(F.lit(2.0)) / F.ln(i + 1.0))
    x = size.join(hit, "qid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return x.select("qid", "relevant", "found", F.round(F.col("found") / F.col("relevant"), 6).alias("coverage"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def profile(scores: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Interpolated percentiles of each kind of score."""
    return scores.groupBy(by).agg(*[F.round(F.percentile(value, p), 6).alias(f"p{round(100 * p)}") for p in shares], F.count(F.lit(1)).alias("n"))


def shares_by_kind(results: DataFrame, kind: str = "kind", length: str = "length") -> DataFrame:
    """Per kind: its share of first places and of the first ten, and the middle length of its texts."""
    one, ten = F.sum((F.col("rank") == 1).cast("long")), F.sum((F.col("rank") <= 10).cast("long"))
    x = results.groupBy(kind).agg(one.alias("one"), ten.alias("ten"), F.percentile(length, 0.5).alias("middle"))
    share = lambda c: F.round(F.try_divide(F.col(c), x.agg(F.sum(c)).scalar()), 6)
    return x.select(kind, share("one").alias("top1"), share("ten").alias("top10"), "middle")


def rate(good: Column, of: Column) -> Column:
    """A share to six places, null without cases."""
    return F.round(F.try_divide(good, of), 6)
