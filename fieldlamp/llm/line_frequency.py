"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, digits to 0, runs of white space to one space, trimmed) and hashed to 64 bits; per
host the distinct documents that hold a line are counted; lines in more than ``max_docs`` and more than ``max_percent`` % of the
documents of their host are taken out, so that more documents of the same kind change no verdict once a host has
100 ``max_docs`` / ``max_percent``, and a document that loses more than ``max_removed`` of its words, or keeps fewer
than ``min_words``, is depleted and rejected. ``judge`` gives the verdicts, ``clean`` the documents that are kept with those
lines taken out. In-document signals (words, symbols, repeated lines, repeated word windows) come from the same pass.

Scale: one pass over the texts leaves 12 bytes a line. Counts are pre-aggregated before their shuffle, and a line that
a third of all documents hold meets its count through a salted join: only lines above the limit are replicated, each
stands for more than ``max_docs`` rows, so the copies stay below SALTS / max_docs of the lines. Only rows whose doc_id occurs
again go through a distinct before the count.

Defined results: a null text has no words; an empty or short document fails the base rules; a null host is a host;
the rows of a doc_id are one document when lines are counted, rows without doc_id are one each, and every row is judged
by itself, so repeated rows are judged alike; an empty table gives an empty table; other columns are ignored by ``judge``
and pass through ``clean``, whatever their names. Long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import bounded, mix64, small_batches, staged, words_of_batch

SALTS = 16
SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "
SPACE, DIGIT = re.compile(r"\s+"), re.compile(r"\d")
SIGNALS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def repeated_window_words(begin: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Per text: the words that lie in a window of width words which the text holds twice or more. begin: where each
    text's words start in codes, and the end."""
    n, texts = len(codes), len(begin) - 1
    out = np.zeros(texts, np.int64)
    if n < width:
        return out
    of = np.repeat(np.arange(texts), np.diff(begin))
    h = mix64(of[: n - width + 1].astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for k in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - width + 1 + k].astype(np.uint64))
    whole = of[: n - width + 1] == of[width - 1 :]
    at = np.flatnonzero(whole)
    _, back, counts = np.unique(h[at], return_inverse=True, return_counts=True)
    again = at[counts[back] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return np.bincount(of, weights=np.cumsum(cover)[:n] > 0, minlength=texts).astype(np.int64)


def normal_line(line: str) -> str:
    return DIGIT.sub("0", SPACE.sub(" ", line)).strip().lower()


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(normal_line(line).encode("utf-8", "replace")) - (1 << 63)


def _signals(width: int, names: list[str]):
    def run(batches):
        for piece in small_batches(batches, "text"):
            texts = [x or "" for x in piece.column("text").to_pylist()]
            begin, words = words_of_batch(piece.column("text"))
            found = dict(zip(piece.schema.names, piece.columns))
            found["n_words"] = pa.array(np.diff(begin), pa.int64())
            found["word_chars"] = pa.array([len(t) - sum(map(t.count, WHITE)) for t in texts], pa.int64())
            found["n_symbols"] = pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64())
            found["n_repeat_words"] = pa.array(repeated_window_words(begin, words.indices.to_numpy().astype(np.int64), width))
            dup, hashes, sizes = [], [], []
            for t in texts:
                lines = [x for x in t.split("\n") if x.strip(WHITE)]
                dup.append(len(lines) - len(set(lines)))
                hashes.append(np.fromiter(map(line_hash, lines), np.int64, len(lines)))
                sizes.append(np.fromiter((len(x.encode("utf-8", "replace").split()) for x in lines), np.int32, len(lines)))
            found["n_dup_lines"], found["lines"], found["line_words"] = pa.array(dup, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found[n] for n in names], names)

    return run


def frequent_lines(signals: DataFrame, max_docs: int, max_percent: int) -> DataFrame:
    """(host, line) of lines in more than max_docs and more than max_percent % of their host's documents."""
    again = signals.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    once, repeated = signals.join(again, "doc_id", "left_anti"), signals.join(again, "doc_id", "left_semi")
    line = F.explode(F.array_distinct("lines")).alias("line")
    held = once.select("host", line).unionByName(repeated.select("host", "doc_id", line).distinct().drop("doc_id"))
    hosts = once.select("host").unionByName(repeated.select("host", "doc_id").distinct().drop("doc_id"))
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
    counts = counts.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    large = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).filter(max_percent * F.col("host_docs") > 100 * max_docs)
    large = large.select("host", "host_docs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = counts["host"].eqNullSafe(large["host"]) & (counts["salt"] == large["salt"])
    above = large["host_docs"].isNull() | (100 * F.col("docs") > max_percent * large["host_docs"])
    return counts.join(large, own, "left").filter(above).select(counts["host"], "line")


def _judged(
    documents: DataFrame, host: str, whole: bool, max_docs: int, max_percent: int, max_removed: float, min_words: int, width: int, max_repeat_percent: int
) -> DataFrame:
    bounded(documents.sparkSession)
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"), *[own] * whole)
    schema = StructType.fromDDL(SIGNALS)
    if whole:
        schema = schema.add("text", "string").add(rows.schema["whole"])
    marked = rows.mapInArrow(_signals(width, schema.names), schema)
    signals = staged(marked.withColumn("row", F.monotonically_increasing_id()), "line-signals")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    above = frequent_lines(signals, max_docs, max_percent).select("host", "line", salts)
    held = signals.select("row", "host", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", "salt", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words")
    )
    same = held["host"].eqNullSafe(above["host"]) & (held["line"] == above["line"]) & (held["salt"] == above["salt"])
    sums = [F.count(F.lit(1)).alias("removed_lines"), F.sum("words").alias("removed_words"), *[F.collect_set("line").alias("gone")] * whole]
    lost = held.join(above, same, "left_semi").groupBy("row").agg(*sums)
    left = F.col("n_words") - F.col("removed_words")
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("removed_words") > max_removed * F.col("n_words")) | (left < min_words)
    return (
        signals.drop("lines", "line_words")
        .join(lost, "row", "left")
        .fillna(0, ["removed_lines", "removed_words"])
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("row")
    )


def judge(
    documents: DataFrame, host: str = "source", max_docs: int = 10, max_percent: int = 2, max_removed: float = 0.5, min_words: int = 20,
    width: int = 8, max_repeat_percent: int = 30,
) -> DataFrame:
    """Per row of documents (doc_id, text and the host column): signals, base_failed, removed_lines, removed_words, kept."""
    return _judged(documents, host, False, max_docs, max_percent, max_removed, min_words, width, max_repeat_percent)


def clean(
    documents: DataFrame, host: str = "source", max_docs: int = 10, max_percent: int = 2, max_removed: float = 0.5, min_words: int = 20,
    width: int = 8, max_repeat_percent: int = 30,
) -> DataFrame:
    """The kept documents with their own columns; frequent lines are taken out of text."""
    judged = _judged(documents, host, True, max_docs, max_percent, max_removed, min_words, width, max_repeat_percent).filter("kept")
    rows = judged.select("text", "gone", "whole")

    def strip(batches):
        for piece in small_batches(batches, "text"):
            texts = [
                "\n".join(x for x in t.split("\n") if not x.strip(WHITE) or line_hash(x) not in out) if (out := set(gone or ())) else t
                for t, gone in zip(piece.column("text").to_pylist(), piece.column("gone").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), piece.column("whole")], ["text", "whole"])

    stripped = rows.mapInArrow(strip, rows.drop("gone").schema)
    return stripped.select(*[F.col("text") if c == "text" else F.col(f"whole.`{c}`") for c in documents.columns])
