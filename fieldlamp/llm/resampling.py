"""Importance resampling towards a target distribution, over hashed n-grams.

Features of a text are all runs of one to three consecutive words; each falls into one of ``BUCKETS`` buckets by the crc32 of its
bytes. A bucket's gain is the rounded log of its share in the target over its share in the corpus, a document's weight is the sum of the
gains of its features, and its score is the weight plus Gumbel noise that hangs on its id; the highest scores are a sample
without replacement.

Identical texts are collapsed first by grouping on the whole text, so features are computed once a text, and counts are multiplied by
the number of copies. One pass over the distinct texts counts buckets (a task sends one row a bucket), a second weighs
each text; weights come back to the documents by the text's SHA-256, and only then does noise of the document come in. A text
that a third of all rows hold is one row a task when texts are grouped; on the way back its documents are one side of a join that
Spark splits (spark.sql.adaptive.skewJoin). Ranks need no task that holds all rows: scores are sorted by ranges, and a
rank is the place in its range plus the sizes of the ranges before it.

The crc32 of a run is put together from those of its words: crc(ab) = shift(crc(a), length of b) xor crc(b), with a table of
four times 256 entries for a shift, so each text is looked at in whole batches of numpy operations.

Defined results: a null text is empty; a text without words has no features, weight 0 and is never drawn; a null doc_id has the
noise of the empty string and comes last among ties; rows that repeat doc_id and text get ranks of their own, one after the other; rows
that tie on score and doc_id are ordered by their columns; other columns are ignored, whatever their names; an empty table gives
an empty table; an empty target has no counts, so gains follow the corpus alone.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, compact, small_batches, staged, words_of_batch

BUCKETS = 10_000
#: What becomes of each byte: letters are lower-cased, digits and bytes beyond ASCII stay, all else parts words.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@functools.lru_cache(4096)
def shift_table(n: int) -> np.ndarray:
    """What n more bytes do to a crc32, by each of its four bytes: 4 x 256 values."""
    if n == 1:
        one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part of one step
        x = np.arange(256, dtype=np.uint32)
        return np.stack([one, x, x << np.uint32(8), x << np.uint32(16)])
    return shifted(shift_table(n // 2), shift_table(n - n // 2)) if n else np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


def shifted(crc: np.ndarray, table: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """crc after more bytes. table: shift tables one after the other; at: where each crc's own begins."""
    flat = table.reshape(-1)
    out = flat[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words begin (and the end), and the words."""
    whole = compact(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, offsets, data = whole.buffers()
    plain = BYTES[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    return words_of_batch(pa.LargeStringArray.from_buffers(len(whole), offsets, pa.py_buffer(plain)))


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a batch, and the number of words of each text."""
    begin, found = words(texts)
    distinct, code = found.dictionary.cast(pa.large_binary()).to_pylist(), found.indices.to_numpy()
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[code]
    after = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))[code]
    lengths, which = np.unique(np.fromiter((len(w) + 1 for w in distinct), np.int64, len(distinct)), return_inverse=True)
    tables = np.stack([shift_table(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
    at = (which * 1024)[code] if len(distinct) else np.zeros(0, np.int64)
    n = np.diff(begin)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(code)) - np.repeat(begin[:-1], n)
    two = shifted(alone[:-1], tables, at[1:]) ^ after[1:] if len(code) else alone  # ends at word 1, 2, ...
    three = shifted(two[:-1], tables, at[2:]) ^ after[2:] if len(code) > 1 else alone[:0]
    second, third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    crc = np.concatenate([alone, two[second - 1], three[third - 2]])
    return np.concatenate([of, of[second], of[third]]), (crc % np.uint32(BUCKETS)).astype(np.int64), n


def _bucket_counts(batches):
    total = np.zeros(BUCKETS)
    for piece in small_batches(batches, "text"):
        of, bucket, _ = buckets_of(piece.column("text"))
        copies = piece.column("copies").to_numpy()
        total += np.bincount(bucket, weights=copies[of].astype(float), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used].astype(np.int64))], ["bucket", "n"])


def _weights(gains: np.ndarray):
    def run(batches):
        for piece in small_batches(batches, "text"):
            of, bucket, n = buckets_of(piece.column("text"))
            weight = np.bincount(of, weights=gains[bucket], minlength=len(n)).astype(np.int64)  # whole numbers below 2^53: exact
            features = np.bincount(of, minlength=len(n))
            yield pa.RecordBatch.from_arrays([piece.column("digest"), pa.array(n), pa.array(features), pa.array(weight)], ["digest", "n_words", "n_features", "weight"])

    return run


def collapsed(rows: DataFrame) -> DataFrame:
    """(text, copies, digest) of every distinct text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return rows.select(text).groupBy("text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest(F.col("text")))


def digest(text):
    return F.unhex(F.sha2(text, 256))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all copies by bucket: a row a bucket reaches the driver."""
    counts = texts.select("text", "copies").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    all_target, all_corpus = int(target.sum()) + BUCKETS, int(corpus.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for t, s in zip(target.tolist(), corpus.tolist())], float)


def weigh(documents: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of documents. target has a column text."""
    bounded(documents.sparkSession)
    texts = staged(collapsed(documents.select("text")), "distinct-texts")
    gain = gains(bucket_counts(collapsed(target.select("text"))), bucket_counts(texts))
    weights = texts.select("text", "digest").mapInArrow(_weights(gain), "digest binary, n_words long, n_features long, weight long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.join(weights, "digest").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows, which are written, with their place in this order, from 1, without a task that holds them all."""
    dealt = rows.withColumn("row_", F.monotonically_increasing_id())
    order = [*order, F.col("row_")]
    # the id is the number of the range in its high bits and the place in it in the low 33
    sorted_rows = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("row_").withColumn("at_", F.monotonically_increasing_id())
    sorted_rows = staged(sorted_rows, "ranges").withColumn("range_", F.shiftright("at_", 33))
    sizes = sorted_rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))  # a row a range
    before = sizes.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    place = F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1
    return sorted_rows.join(before, "range_").withColumn(name, place).drop("range_", "at_", "before_")


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row: of those with least_words words, percent are drawn; rank is null for
    all others."""
    weighed = staged(weigh(documents, target, seed), "weights")
    able = weighed.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    placed = ranked(able, order)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(weighed.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
