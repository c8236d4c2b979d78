"""Merges of snapshots, upserts and checksummed export."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import BATCH_BYTES


def last_writer_wins(local: DataFrame, incoming: DataFrame, key: list[str], at: str) -> DataFrame:
    """The newer row of each key; the local one on a tie, a missing time is the oldest. taken: from the incoming side."""
    both = local.withColumn("taken", F.lit(False)).unionByName(incoming.withColumn("taken", F.lit(True)))
    w = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), "taken")
    return both.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def append_absent(local: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """local, and what is incoming under keys it lacks, each key once."""
    new = incoming.join(local.select(*key), key, "left_anti").dropDuplicates(key)
    return local.unionByName(new)


def upsert(base: DataFrame, changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    c = changes.select(*key, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("changed"))
    x = base.join(c, key, "full")
    return x.select(*key, *[F.when(F.col("changed"), F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def without_stale(rows: DataFrame, current: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows whose key is no longer current)."""
    return rows.join(current.select(*key).distinct(), key, "left_semi"), rows.join(current.select(*key).distinct(), key, "left_anti")


def canonical_json(names: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def checksum(payload: Column) -> Column:
    return F.sha2(payload, 256)


EXPORT = "part long, parts long, digest string, body string"


def cut_pieces(batches, size: int):
    """Batches of (key, part, parts, digest, body) of batches of (key, payload): many rows each, of about BATCH_BYTES at most."""

    def told(batch, rows):
        at, part, parts, digest, body = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(part, pa.int64()), pa.array(parts, pa.int64()), pa.array(digest), pa.array(body)], ["key", "part", "parts", "digest", "body"])

    for batch in batches:
        rows, held = [], 0
        for at, p in enumerate(batch.column("payload").to_pylist()):
            raw = (p or "").encode()
            body = base64.b64encode(gzip.compress(raw, mtime=0)).decode()
            cut = [body[i : i + size] for i in range(0, len(body), size)]
            digest = hashlib.sha256(raw).hexdigest()
            rows += [(at, i, len(cut), digest, x) for i, x in enumerate(cut, 1)]
            held += len(body)
            if held >= BATCH_BYTES:
                yield told(batch, rows)
                rows, held = [], 0
        if rows:
            yield told(batch, rows)


def export(payloads: DataFrame, size: int = 800) -> DataFrame:
    """(key, part, parts, digest, body) of (key, payload): gzip, base64, pieces of size characters."""
    kind = dict(payloads.dtypes)["key"]
    return payloads.select("key", "payload").mapInArrow(lambda batches: cut_pieces(batches, size), f"key {kind}, {EXPORT}")


def restore(pieces: DataFrame) -> DataFrame:
    """(key, payload, problem) from pieces in any order: problem is 'missing' or 'checksum', else null."""
    kind = dict(pieces.dtypes)["key"]
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("part", "body"))).alias("p"), F.max("parts").alias("parts"), F.max("digest").alias("digest"))
    joined = whole.select("key", F.concat_ws("", F.transform("p", lambda x: x["body"])).alias("body"), "digest", (F.size("p") == F.col("parts")).alias("complete"))

    def run(batches):
        for batch in batches:
            out = []
            for body, digest, complete in zip(*(batch.column(c).to_pylist() for c in ("body", "digest", "complete"))):
                if not complete:
                    out.append((None, "missing"))
                    continue
                try:
                    raw = gzip.decompress(base64.b64decode(body))
                except (ValueError, OSError, EOFError):
                    raw = None
                good = raw is not None and hashlib.sha256(raw).hexdigest() == digest
                out.append((raw.decode(), None) if good else (None, "checksum"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["key", "payload", "problem"])

    return joined.mapInArrow(run, f"key {kind}, payload string, problem string")
