"""Vectors: validation, exact and approximate nearest neighbours, truncation, pooling.

Exact search multiplies blocks: the collection is dealt into buckets of about BUCKET_ROWS vectors, the queries into blocks of about
BLOCK_QUERIES, and every bucket meets every block in a task of bounded size, which keeps its k best a query. Neither side
reaches the driver, and the shuffle after it carries k rows a query and bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

BUCKET_ROWS, BLOCK_QUERIES = 20_000, 1_024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def problem(v: Column, dims: int) -> Column:
    """What is wrong with a vector: null, dims, nan, zero; null if nothing is."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "null").when(F.size(v) != dims, "dims").when(bad, "nan").when(F.forall(v, lambda x: x == 0), "zero")


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def truncate(v: Column, dims: int) -> Column:
    """The first dims values, at unit length again."""
    return unit(F.slice(v, 1, dims))


def matrix(table: pa.Table, ids: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a table (ids, v), without zero vectors."""
    m = np.array(table.column("v").to_pylist(), np.float64).reshape(table.num_rows, -1)
    length = np.linalg.norm(m, axis=1)
    return table.column(ids).to_numpy()[length > 0], m[length > 0] / length[length > 0, None]


def best_of(k: int, key: str):
    """The k best of a bucket for each query that comes with it, and those that tie with the last."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"qid": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return none
        (ids, m), (qids, q) = matrix(a, "key"), matrix(b, "qid")
        if not len(ids) or not len(qids):
            return none
        cos = np.round(q @ m.T, 6)
        few = min(k, cos.shape[1])
        edge = -np.partition(-cos, few - 1, axis=1)[:, few - 1 : few]
        i, j = np.nonzero(cos >= edge)  # ties at the edge stay until keys decide
        return pa.table({"qid": pa.array(qids[i]), key: pa.array(ids[j]), "cos": pa.array(cos[i, j])})

    return best


def topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """(qid, key, cos, rank) of the k nearest by cosine; queries (qid, v). Null and zero vectors are left out."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(v).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(v).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(v).isNotNull()).select(F.col("qid").cast("long").alias("qid"), F.col(v).cast("array<double>").alias("v"))
    n = rows.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / 256)))
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    deal = lambda x, m: F.pmod(F.xxhash64(x), F.lit(m)).cast("int")
    copies = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("bucket", deal("key", buckets)).withColumn("block", copies(blocks))
    right = asked.withColumn("block", deal("qid", blocks)).withColumn("bucket", copies(buckets))
    near = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(best_of(k, key), f"qid long, {key} long, cos double")
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), key)
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def sample_of(vectors: DataFrame, v: str, most: int) -> np.ndarray:
    """At most so many distinct unit vectors, those of smallest hash; that is what reaches the driver."""
    rows = vectors.filter(F.col(v).isNotNull()).select(F.col(v).cast("array<double>").alias("v"))
    known = rows.orderBy(F.xxhash64("v")).limit(most).toArrow().combine_chunks()
    x = np.array(known.column("v").to_pylist(), np.float64).reshape(known.num_rows, -1)
    length = np.linalg.norm(x, axis=1) if x.size else np.zeros(0)
    return np.unique(x[length > 0] / length[length > 0, None], axis=0) if x.size else x


def train_cells(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of cells by spherical k-means over unit vectors."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(12):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 400) -> int:
    """The least number of nearest cells that hold this share of the k nearest of some sampled vectors among all sampled ones."""
    step = max(1, len(x) // asked)
    q, near = x[::step], (x @ centres.T).argmax(1)
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    few = min(k + 1, len(x))
    top = np.argpartition(-(q @ x.T), few - 1, axis=1)[:, :few]
    needed = np.sort(np.take_along_axis(place, near[top], 1), axis=None)  # with itself, which is found always
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def cells_of(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """rows (.., v) with each of the n nearest cells."""

    def run(batches):
        for batch in batches:
            m = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.reshape(-1), pa.int32())], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, f"{rows.schema.names[0]} long, v array<double>, cell int")


def approximate(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", v: str = "embedding", cells: int = 64, recall: float = 0.95, sample: int = 20_000) -> DataFrame:
    """(qid, key, cos, rank) by an inverted file: every vector is in the cell of its nearest centre, and a query is compared with those of its
    nearest cells. Centres, and how many cells are looked at for the recall asked for, are learnt from a bounded sample; all vectors are filed. Clustered vectors need few cells, vectors
    without any structure about half of them. A cell of more than BUCKET_ROWS vectors is dealt to blocks, to each of which its queries go."""
    known = sample_of(vectors, v, sample)
    if len(known) < 2:
        return topk(vectors, queries, k, key, v)
    centres = train_cells(known, min(cells, max(2, len(known) // 8)))
    probes = probes_for(known, centres, k, recall)
    rows = vectors.filter(F.col(v).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(v).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(v).isNotNull()).select(F.col("qid").cast("long").alias("qid"), F.col(v).cast("array<double>").alias("v"))
    filed, sent = cells_of(rows, centres, 1), cells_of(asked, centres, probes)
    filed = written(filed, "filed-vectors")
    size = {r.cell: r["count"] for r in filed.groupBy("cell").count().collect()}  # a row a cell
    blocks = F.array(*[F.lit(max(1, math.ceil(size.get(c, 0) / BUCKET_ROWS))) for c in range(len(centres))])
    left = filed.withColumn("block", F.pmod(F.xxhash64("key"), F.get(blocks, F.col("cell"))).cast("int"))
    right = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1)))
    near = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(best_of(k, key), f"qid long, {key} long, cos double")
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), key)
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, vectors: DataFrame, query: str = "q", key: str = "doc_id", v: str = "embedding") -> DataFrame:
    """hits with cos to the query vector of their row; null where the key has no vector or a zero one."""
    got = hits.join(vectors.select(F.col("vec_id").alias(key), F.col(v).alias("own")), key, "left")
    known = F.col("own").isNotNull() & F.exists("own", lambda x: x != 0)
    return got.withColumn("cos", F.when(known, F.round(dot(F.col(query), F.col("own")), 5))).drop("own")


def pooled_vector(windows: Column, k: int) -> Column:
    """The mean of the first k window vectors, at unit length."""
    first = F.slice(windows, 1, k)
    size = F.size(F.get(windows, F.lit(0)))
    total = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(first, F.lit(0.0), lambda s, w: s + F.get(w, i).cast("double")))
    return unit(total)


def collection_problems(rows: DataFrame, before: int, key: str, text: str, least_chars: int = 200, most_shrink: float = 0.5) -> DataFrame:
    """What stops the build of a collection: (problem, n). Repeated keys, or a collection that is much smaller than before; texts
    that are too short for a vector are counted and only skipped."""
    long_enough = F.char_length(F.coalesce(F.col(text), F.lit(""))) >= least_chars
    by_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(long_enough.cast("long")).alias("kept"))
    x = by_key.agg(
        F.sum((F.col("n") > 1).cast("long")).alias("repeated"), F.sum(F.col("n") - F.col("kept")).alias("skipped"), F.sum("kept").alias("kept")
    )
    found = F.array(
        F.struct(F.lit("repeated key").alias("problem"), F.coalesce("repeated", F.lit(0)).alias("n")), F.struct(F.lit("skipped").alias("problem"), F.coalesce("skipped", F.lit(0)).alias("n")),
        F.struct(F.lit("shrunk").alias("problem"), F.when(F.coalesce("kept", F.lit(0)) < most_shrink * before, before - F.coalesce("kept", F.lit(0))).otherwise(F.lit(0).cast("long")).alias("n")),
    )
    return x.select(F.explode(found).alias("p")).select("p.*").filter("n > 0")


def pooled(cosines: Column, k: int) -> Column:
    """Of a document's window scores: max, mean and the mean of the two best among the first k."""
    c = F.sort_array(F.slice(cosines, 1, k), asc=False)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.struct(F.array_max(c).alias("max"), F.round(mean(c), 6).alias("mean"), F.round(mean(F.slice(c, 1, 2)), 6).alias("top2"))
