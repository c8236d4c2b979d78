"""The queries of this package's operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, html_extract, huffman_ids, line_frequency, mixing, packing, partition_join, resampling, spaced_seed, spelling, toxic_segments, trie_unigram, warc
from .common import new_path, staged, table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_frequency.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words"
    )


def op2_tag_path_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, planned = mixing.plan(table(spark, sf_dir, "documents"))
    return mixing.draw(narrow, planned).select("doc_id", "source", "n_tokens", "weight", F.col("epoch").cast("long").alias("epoch"), "place")


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    huffman_ids.write_ids(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json")
    return huffman_ids.read_ids(spark, path)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "select cast(-7 as bigint) conv_id, cast(t as bigint) turn, r role, '</s>[INST] ok [/INST]' text from values (0, 'user'), (1, 'assistant') as v(t, r)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = staged(chat_format.format_conversations(turns), "chat")
    read = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "loss", chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans"))
    )
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(spoken, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_segments.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = partition_join.join(table(spark, sf_dir, "documents"), width=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id")


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_trie_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_unigram.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=0, most=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_tag_path_ratio, op3_temperature_mixing, op4_huffman_ids, op5_chat_format, op6_toxic_segments,
        op7_ngram_join, op8_spaced_seeds, op9_warc_revisits, op10_trie_unigram,
        op11_spelling_variants, op12_importance_resampling, op13_sum_of_squares_packing,
    )
}

ORACLES = {
    "op5_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')) n,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')) r,
    lag(role) over w is null or lag(role) over w <> role as opens, lead(role) over w is null or lead(role) over w <> role as closes
  from t window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(n + case when opens then 12 + r + 10 else 11 end + case when closes then 11 else 0 end) as bigint) formatted_chars
from e group by conv_id""",
    "op9_warc_revisits": """
with p as (
  select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id is distinct from first_id and first_id is not null then first_id end refers_to
from f""",
}
