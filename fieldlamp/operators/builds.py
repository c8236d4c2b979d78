"""Long builds that go on where they stopped: keyed rows are dealt to ranges, each range is written by itself and noted with a digest of what it was made
from; a later run leaves ranges whose digest stands and makes the others anew.

The identity of a build (model, dimensions, parameters) is written before anything else and has to be the same ever after. Notes are written after the range's rows, so a
range that was cut off has no note and is made again. ``publish`` takes the whole build as a generation once every range stands.

Defined results: keys may be null or repeated (their rows are one range's); rows are ordered by key in a range; a range that loses all its rows loses its files; an empty
table is a build without rows, which has nothing to read or publish.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import files


class IdentityChanged(ValueError):
    """The build on disk is another one's."""


def digests(rows: DataFrame, key: str, ranges: int) -> DataFrame:
    """(range, digest, n) of every range: order and partitions don't matter, repeated rows do."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}))
    x = rows.select(range_of(key, ranges).alias("range"), whole.alias("h"))
    halves = [F.sum(F.shiftright("h", 32)), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)), F.bit_xor(F.xxhash64("h"))]
    return x.groupBy("range").agg(F.concat_ws("-", *halves, F.count(F.lit(1))).alias("digest"), F.count(F.lit(1)).alias("n"))


def range_of(key: str, ranges: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(ranges)).cast("int")


def identify(spark: SparkSession, path: str, identity: dict) -> None:
    said = json.dumps(identity, sort_keys=True)
    held = files.read_notes(spark, f"{path}/identity").get("identity")
    if held is None:
        files.write_note(spark, f"{path}/identity", said)
    elif held != said:
        raise IdentityChanged(f"{path} was built as {held}, not as {said}")


def noted(spark: SparkSession, path: str) -> dict[int, str]:
    """The digest of each range that was written whole: a note a wave, the newest counts."""
    notes = files.read_notes(spark, f"{path}/notes")
    return {range_: digest for name in sorted(notes) for range_, digest in json.loads(notes[name])}


def build(rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], path: str, identity: dict, ranges: int = 64, wave: int = 8) -> list[int]:
    """Bring path up to date with step(rows); ``wave`` ranges are one job. Returns the ranges that were written. step maps rows to rows and keeps the
    key. A row a range reaches the driver."""
    spark = rows.sparkSession
    identify(spark, path, identity | {"ranges": ranges, "key": key})
    now, was = {r.range: r.digest for r in digests(rows, key, ranges).collect()}, noted(spark, path)
    todo = [r for r in range(ranges) if now.get(r) != was.get(r)]
    dealt = rows.withColumn("range_", range_of(key, ranges))
    for at in range(0, len(todo), wave):
        own = todo[at : at + wave]
        for r in own:  # what an unfinished run, or other rows, left
            files.remove(spark, f"{path}/rows/range_={r}")
        made = step(dealt.filter(F.col("range_").isin(own)).drop("range_")).withColumn("range_", range_of(key, ranges))
        made.repartition(len(own), "range_").sortWithinPartitions("range_", key).write.mode("append").partitionBy("range_").parquet(f"{path}/rows")
        number = len(files.names_in(spark, f"{path}/notes"))
        files.write_note(spark, f"{path}/notes/{number:012d}", json.dumps([[r, now.get(r)] for r in own]))
    return todo


def built(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("range_")


def publish(rows: DataFrame, key: str, path: str, root: str, generation: str, ranges: int = 64) -> str:
    """The whole build as a generation of root; refused while a range is missing or was made of other rows."""
    spark = rows.sparkSession
    was = noted(spark, path)
    missing = sorted(r.range for r in digests(rows, key, ranges).collect() if r.digest != was.get(r.range))
    if missing:
        raise ValueError(f"ranges {missing[:10]} are not built")
    return files.publish(built(spark, path), root, generation)
