"""Streaming twins of the time-series operators: sessions, duplicates, detectors. Sources are file streams of events; each job
runs with any trigger, and ``drained`` runs it over what is there (availableNow) and returns what it wrote."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path


def events(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """The events table as a stream, with event time ``at``; each event ``copies`` times."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    return rows if copies == 1 else rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")


def drained(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    out, state = new_path(spark, f"stream-{label}"), new_path(spark, f"stream-state-{label}")
    drained_once(df, out, state, mode)
    return spark.read.schema(df.schema).parquet(out)


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions by user; a session is written once the watermark passes its end, so the sessions that are open when the
    stream stops come with the next run and not with this one."""
    w = stream.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(stream: DataFrame, size: str, late: str) -> DataFrame:
    w = stream.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def distinct(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def drained_once(df: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Run a stream over what is there and not yet read, from the checkpoint in state, and append to out."""
    q = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state)
    q.format("parquet").option("path", out).start().awaitTermination()


def streaks(stream: DataFrame, low: float, k: int) -> DataFrame:
    """(user_id, event_id) at which a user's k-th successive value below low comes. The state of a user is the length of the run that is open; rows of a user
    come in order of time over the batches, within a batch they are sorted."""

    def walk(key, parts, state):
        n = state.get[0] if state.exists else 0
        rows = pd.concat(parts).sort_values(["at", "event_id"])
        out = []
        for event_id, value in rows[["event_id", "value"]].itertuples(index=False):
            n = n + 1 if value < low else 0  # a value that is missing ends a run
            if n == k:
                out.append((key[0], event_id))
        state.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    rows = stream.select("user_id", "at", "event_id", "value").groupBy("user_id")
    return rows.applyInPandasWithState(walk, "user_id long, event_id long", "n long", "append", "NoTimeout")


def streaks_batch(rows: DataFrame, low: float, k: int) -> DataFrame:
    """The same from a table, by windows."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = rows.withColumn("low", F.col("value") < low).withColumn("good", F.sum((~F.col("low")).cast("long")).over(w))
    run = F.sum(F.col("low").cast("long")).over(Window.partitionBy("user_id", "good").orderBy("ts", "event_id"))
    return x.withColumn("run", run).filter(F.col("low") & (F.col("run") == k)).select("user_id", "event_id")
