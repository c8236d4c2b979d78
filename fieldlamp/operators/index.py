"""A persistent inverted index: written once from the texts, read by every later batch of queries.

Documents are cut into segments: runs of a partition's documents, ``SEGMENT`` of them or as many as hold ``SEGMENT_BYTES`` of tokens. A block holds one term's
postings of one segment, so no block grows beyond a segment, however common its term. The task that reads a segment counts its terms, so tokens are not shuffled; blocks are, once. Blocks lie in files by bucket of the term, sorted by term, with the number of their postings and the most
that any of them can add to a score. A search reads the heads of its terms' blocks first; what a segment can reach at most follows from
them. Segments are scored from the most promising; the k best so far give each query a score to surpass, and segments that can't reach it are never read.

Defined results: null texts are documents without terms; equal keys are documents of their own, and a search returns each; terms that no document holds add nothing; ties go to
the smaller key; an empty table gives an index without blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import bounded, unstage, written
from .retrieval import B, K1, MARK, query_terms

SEGMENT = 4096
SEGMENT_BYTES = 32 << 20  # of tokens, and four more a token
FIRST_SEGMENTS = 2  # of each query, in the first round


def impact(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def counted(documents: pa.Table, number: int) -> pa.RecordBatch:
    """A row a term of the documents (doc, t), which are a segment: its documents, how often it stands in each, and their lengths; and one row of them all, of the term MARK."""
    tokens = documents["t"].combine_chunks()
    terms, sizes = tokens.flatten().dictionary_encode(), tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n, codes = len(sizes), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(codes * n + np.repeat(np.arange(n), sizes), return_counts=True)
    code, at = np.divmod(pairs, n)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    at, tf = np.concatenate([np.arange(n), at]), np.concatenate([np.zeros(n, np.int64), tf])
    cuts = pa.array(np.concatenate([[0], n + starts, [len(at)]]).astype(np.int32))
    words = pa.concat_arrays([pa.array([MARK]), terms.dictionary.take(pa.array(code[starts])).cast(pa.string())])
    lists = [documents["doc"].combine_chunks().take(pa.array(at)), pa.array(tf.astype(np.int32)), pa.array(sizes[at].astype(np.int32))]
    return pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), number)), *[pa.ListArray.from_arrays(cuts, x) for x in lists]], ["term", "segment", "doc", "tf", "dl"])


def in_segments(segment: int, most: int = SEGMENT_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        number, held, docs, size = TaskContext.get().partitionId() << 33, [], 0, 0
        for batch in batches:
            tokens = batch.column("t")
            strings, at = tokens.values.cast(pa.large_string()), tokens.offsets.to_numpy()
            ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset :][at] + 4 * at if len(strings) else 0 * at
            start = 0
            while start < len(batch):
                fits = int(np.searchsorted(ends, ends[start] + most - size, "right")) - 1
                end = min(len(batch), start + segment - docs, max(start + 1, fits))
                held.append(batch.slice(start, end - start))
                docs, size, start = docs + end - start, size + ends[end] - ends[start], end
                if docs >= segment or size >= most:
                    yield counted(pa.Table.from_batches(held), number)
                    number, held, docs, size = number + 1, [], 0, 0
        if held:
            yield counted(pa.Table.from_batches(held), number)

    return run


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = 64, segment: int = SEGMENT) -> None:
    """Write the index of docs (key, text) under path: blocks by bucket, and one row of totals."""
    spark = bounded(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), T.all_tokens(F.col(text)).alias("t"))
    lists = written(rows.mapInArrow(in_segments(segment), "term string, segment long, doc array<long>, tf array<int>, dl array<int>"), "segment-lists")
    all_ = lists.filter(F.col("term") == MARK).select(F.size("doc").cast("long").alias("docs"), F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    totals = all_.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens") / F.sum("docs"), F.lit(1.0)).alias("mean"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    mean = F.lit(float(spark.read.parquet(f"{path}/totals").first().mean or 1.0))
    laid = lists.filter(F.col("term") != MARK).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    laid = laid.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "segment")
    postings = F.sort_array(F.arrays_zip("doc", F.col("tf").cast("array<long>").alias("tf"), F.col("dl").cast("array<long>").alias("dl")))
    block = laid.select("term", "segment", F.size("doc").cast("long").alias("n"), postings.alias("postings"), "bucket")
    block = block.select("term", "segment", "n", F.array_max(F.transform("postings", lambda p: impact(p["tf"], p["dl"], mean))).alias("most"), "postings", "bucket")
    block.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", str(4 << 20)).parquet(f"{path}/blocks")
    unstage(lists)


class Index:
    """What ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.schema("term string, segment long, n long, most double, postings array<struct<doc:long,tf:long,dl:long>>, bucket int").parquet(f"{path}/blocks")
        totals = spark.read.parquet(f"{path}/totals").first()
        self.docs, self.mean = totals.docs, totals.mean or 1.0
        self.buckets = self.blocks.agg(F.max("bucket")).first()[0]

    def terms(self, queries: DataFrame) -> DataFrame:
        """(qid, term, n_terms) of queries (qid, terms), each term once."""
        return query_terms(queries).select("qid", "term", "n_terms").distinct()

    def weighted(self, queries: DataFrame) -> DataFrame:
        """(qid, term, segment, weight, most): the heads of the blocks of a batch's terms; no postings are read."""
        wanted = self.terms(queries)
        heads = self.blocks.select("term", "segment", "n", "most").join(wanted.select("term").distinct(), "term", "left_semi")
        heads = written(heads, "block-heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.ln(1 + (F.lit(float(self.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return wanted.select("qid", "term").join(heads.join(df, "term"), "term").select("qid", "term", "segment", weight.alias("weight"), "most")

    def scored(self, asked: DataFrame) -> DataFrame:
        """(qid, doc, score) of the asked blocks (qid, term, segment, weight); a block is read once for all queries."""
        used = self.blocks.select("term", "segment", "postings").join(asked.select("term", "segment").distinct(), ["term", "segment"], "left_semi")
        rows = used.join(asked, ["term", "segment"]).select("qid", "weight", F.explode("postings").alias("p"))
        add = F.col("weight") * impact(F.col("p.tf"), F.col("p.dl"), F.lit(self.mean))
        return rows.groupBy("qid", F.col("p.doc").alias("doc")).agg(F.round(F.sum(add), 6).alias("score"))

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, doc, score, rank) of the k best documents by BM25, and (qid, segments, read): how many segments hold a term of a query, and
        of how many postings were read. Segments are scored from the most promising, in rounds of twice as many each."""
        spark = queries.sparkSession
        heads = written(self.weighted(queries), "weighted-heads")
        order = Window.partitionBy("qid").orderBy(F.desc("reach"), "segment")
        bound = heads.groupBy("qid", "segment").agg(F.sum(F.col("weight") * F.col("most")).alias("reach"))
        bound = written(bound.withColumn("nth", F.row_number().over(order)), "segment-bounds")
        found = spark.createDataFrame([], "qid long, doc long, score double, rank long")
        used, at, size = [], 0, FIRST_SEGMENTS
        while True:
            floor = found.filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
            open_ = bound.filter(F.col("nth") > at).join(floor, "qid", "left").filter("floor is null or reach + 0.000001 >= floor")
            now = written(open_.filter(F.col("nth") <= at + size).select("qid", "segment"), "segments-to-read")
            used.append(now)
            if now.limit(1).count():
                more = self.scored(heads.join(now, ["qid", "segment"], "left_semi"))
                found = written(best(found.select("qid", "doc", "score").unionByName(more), k), "best-so-far")
            elif not open_.limit(1).count():  # reach falls, so what is left can't be reached either
                break
            at, size = at + size, 2 * size
        read = used[0]
        for x in used[1:]:
            read = read.unionByName(x)
        read = read.groupBy("qid").agg(F.count(F.lit(1)).alias("read"))
        return found, bound.groupBy("qid").agg(F.count(F.lit(1)).alias("segments")).join(read, "qid")

    def top(self, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
        return self.search(queries, k)[0].withColumnRenamed("doc", key)


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
