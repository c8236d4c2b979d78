"""A corpus from raw documents to token files: toxic documents go, one of each group of near copies stays, documents
that overlap the benchmark go, sources are mixed to target weights, and ids are written in Huffman code.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. The near-copy stage takes five words and a
similarity of 0.8 or more; the mixing stage spends the token budget of its input, so it repeats documents of small
sources and leaves out some of the largest.

Defined results, each as its operator states them: a null text is clean, links with nothing, overlaps with nothing and has
the end id alone; mixing takes no document of a source without tokens, so such documents end there; ties are broken by
the smallest doc_id or a hash, never by the order of rows; rows that repeat doc_id and text become one in the second
stage, that with the smallest hash of all its columns; rows without doc_id stay until mixing, which takes or leaves them together; an empty table gives an empty table;
columns beyond doc_id, text and source pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlamp.llm import huffman_ids, mixing, partition_join, spaced_seed, toxic_segments
from fieldlamp.llm.common import new_path, remove_path, save, scratch, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic; without labels, all stay."""
    return toxic_segments.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return partition_join.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap a benchmark item."""
    return spaced_seed.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files."""
    path = new_path(spark, "pipeline-ids")
    huffman_ids.write_ids(docs, path, "word_bpe_49k.json")
    return huffman_ids.read_ids(spark, path)


STAGES = [
    ("toxicity", clean),
    ("near_copies", distinct),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: The learnt classifier, the hashed joins and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own staged files go once its result is written, and so does the result before it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            save(out, path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    last = STAGES[-1][1](spark, docs, sf_dir)
    remove_path(spark, before)  # the last stage returns what it reads from its own files
    return last
