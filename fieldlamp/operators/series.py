"""Sensor-like time series: latest, history, retention, detectors, windows. Rows: (sensor, id, at, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def newest(part: str, at: str = "ts", id: str = "event_id"):
    return Window.partitionBy(part).orderBy(F.desc(at), F.desc(id))


def latest(rows: DataFrame, part: str, id: str = "event_id") -> DataFrame:
    """The row of the largest id of each key; its time plays no part. max_by aggregates before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(part).agg(F.max_by(whole, F.col(id)).alias("row")).select("row.*")


def history(rows: DataFrame, part: str, n: int, at: str = "ts", id: str = "event_id") -> DataFrame:
    w = newest(part, at, id)
    return rows.withColumn("nth", F.row_number().over(w).cast("long")).filter(F.col("nth") <= n)


def retain(rows: DataFrame, days: int, at: str = "ts") -> DataFrame:
    """Rows within days of the newest; the newest time is one aggregated value."""
    last = rows.agg(F.max(at).alias("last")).scalar()
    return rows.filter(F.col(at) >= last - F.expr(f"interval {days} days"))


def failing(rows: DataFrame, part: str, low: float, k: int = 3, at: str = "ts", id: str = "event_id") -> DataFrame:
    """Keys whose k newest values are all below low."""
    h = history(rows, part, k, at, id)
    return h.groupBy(part).agg(F.sum((F.coalesce("value", F.lit(0.0)) < low).cast("long")).alias("low"), F.count(F.lit(1)).alias("n")).filter(f"n >= {k} and low = n").select(part)


def dropped(rows: DataFrame, part: str, drop: float, least: int = 3, n: int = 48, at: str = "ts", id: str = "event_id") -> DataFrame:
    """Per key with least readings: the newest value, the best of the up to n - 1 before it, whether it fell by drop."""
    h = history(rows, part, n, at, id)
    x = h.groupBy(part).agg(F.max(F.when(F.col("nth") == 1, F.col("value"))).alias("newest"), F.max(F.when(F.col("nth") > 1, F.col("value"))).alias("best"), F.count(F.lit(1)).alias("n"))
    return x.filter((F.col("n") >= least) & F.col("newest").isNotNull() & F.col("best").isNotNull()).withColumn("fell", F.col("best") - F.col("newest") >= drop)


def tumbling(rows: DataFrame, size: str, by: str, at: str = "ts", slide: str | None = None) -> DataFrame:
    w = F.window(F.col(at).cast("timestamp"), size, slide) if slide else F.window(F.col(at).cast("timestamp"), size)
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "mean")


def sessions(rows: DataFrame, part: str, gap: str, at: str = "ts") -> DataFrame:
    w = F.session_window(F.col(at).cast("timestamp"), gap)
    return rows.groupBy(part, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(part, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def islands(rows: DataFrame, part: str, bad: Column, at: str = "ts", id: str = "event_id") -> DataFrame:
    """Runs of successive bad rows: (part, run length) of every run."""
    w = Window.partitionBy(part).orderBy(at, id)
    x = rows.withColumn("bad", bad).withColumn("good_before", F.sum((~bad).cast("long")).over(w))
    return x.filter("bad").groupBy(part, "good_before").agg(F.count(F.lit(1)).alias("run"))


def path_length(rows: DataFrame, part: str, order: str, distance) -> DataFrame:
    """Sum of distance(previous, current) along the order of each key."""
    w = Window.partitionBy(part).orderBy(order)
    x = rows.withColumn("lat0", F.lag("lat").over(w)).withColumn("lon0", F.lag("lon").over(w))
    step = F.coalesce(distance(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), F.lit(0.0))
    return x.groupBy(part).agg(F.round(F.sum(step), 1).alias("metres"), F.count(F.lit(1)).alias("points"))
