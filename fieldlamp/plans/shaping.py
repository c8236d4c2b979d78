"""Queries of the ranking's policy: evidence order, class weights, boosts, kept rows, fusion of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import intent as I, library as L, ranking as R, retrieval as S
from ..session import table
from .registry import query
from .search import BASE_ALL, EVIDENCE, SURE, TEXTS_SQL, batch, evidence, intent_sql, relevant, tok


@query("o60_evidence_order", f"{BASE_ALL} select qid, doc_id, row_number() over (partition by qid order by round(-(it + ib), 9), rank) place from rel")
def evidence_order(spark, d):
    return R.evidence_order(evidence(spark, d, None), ["qid"], "title", "body").select("qid", "doc_id", "place")


WEIGHTS = {"src0": 1.6, "src1": 2.0, "src2": 0.6}


@query("o62_class_weights", f"{BASE_ALL} select qid, doc_id, round(case source when 'src0' then 1.6 when 'src1' then 2.0 when 'src2' then 0.6 else case when doc_id % 10 = 0 then 1.3 else 1.0 end end / (5 + rank), 6) score from rel")
def class_weights(spark, d):
    item = F.when(~F.col("source").isin(*WEIGHTS) & (F.col("doc_id") % 10 == 0), 1.3)
    return relevant(spark, d, None).select("qid", "doc_id", F.round(R.rank_score(R.class_weight(F.col("source"), WEIGHTS, item), F.col("rank")), 6).alias("score"))


@query("o65_medical_boost", f"{BASE_ALL} select qid, doc_id, round(score * case when qid % 2 = 0 and source in ('src3', 'src4') then 1.5 else 1 end, 6) score from rel")
def medical_boost(spark, d):
    factor = R.medical_boost(F.col("qid") % 2 == 0, F.col("source").isin("src3", "src4"))
    return relevant(spark, d, None).select("qid", "doc_id", F.round(F.col("score") * factor, 6).alias("score"))


@query("o34_furniture", f"{BASE_ALL} select qid, doc_id, round(score * case when doc_id % 3 = 0 then 0.5 else 1 end + 1e-9, 6) score from rel")
def furniture(spark, d):
    url = F.concat(F.lit("/m/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "#go-deeper").when(F.col("doc_id") % 3 == 1, "#what-to-do").otherwise(""))
    return relevant(spark, d, None).select("qid", "doc_id", F.round(F.col("score") * R.furniture(url) + 1e-9, 6).alias("score"))


@query("o69_dedupe_pages", f"{BASE_ALL}, x as (select *, doc_id // 5 page, source in ('src0', 'src1') authored from rel), g as (select *, case when authored then 'p' || page else 'd' || doc_id end grp from x), b as (select *, min(rank) over (partition by qid, grp) as first from g) select qid, doc_id, first as pos from b qualify row_number() over (partition by qid, grp order by score desc, rank) = 1")
def dedupe_pages(spark, d):
    rows = relevant(spark, d, None).withColumn("page", F.floor(F.col("doc_id") / 5).cast("string")).withColumnRenamed("rank", "pos")
    return R.dedupe_pages(rows, ["qid"], "page", F.col("source").isin("src0", "src1")).select("qid", "doc_id", "pos")


@query("o75_with_evidence", f"{BASE_ALL} select qid, doc_id from rel where it > 0 or source = 'src0' or doc_id % 7 = 0 or source = 'src1'")
def with_evidence(spark, d):
    x = evidence(spark, d, None)
    x = x.withColumn("via", F.when(F.col("source") == "src0", "meaning").otherwise("words")).withColumn("kind", F.when(F.col("source") == "src1", "book").otherwise("page"))
    return R.with_evidence(x, F.col("title") == 0, F.col("doc_id") % 7 == 0).select("qid", "doc_id")


@query("o95_keyword_places", f"""{BASE_ALL}, x as (select qid, doc_id, source, score, doc_id // 5 page, source = 'src0' authored, row_number() over (partition by qid order by score desc, doc_id) pos from rel),
g as (select *, case when authored then 'p' || page else 'd' || doc_id end grp from x), b as (select *, row_number() over (partition by qid, grp order by score desc, pos) n from g), t as (select * from b where n = 1 qualify row_number() over (partition by qid, source, doc_id % 50 order by score desc, doc_id) = 1),
v as (select *, round(score * case when nth > 3 then power(0.85, nth - 3) else 1 end, 6) s from (select *, row_number() over (partition by qid, source order by score desc, doc_id) nth from t)) select qid, doc_id, row_number() over (partition by qid order by s desc, doc_id) - 1 place from v""")
def keyword_places(spark, d):
    x = relevant(spark, d, None).withColumn("page", F.floor(F.col("doc_id") / 5).cast("string")).withColumn("words", F.col("score")).withColumn("via", F.lit(None).cast("string"))
    x = x.withColumn("kind", F.lit("article")).withColumn("title", (F.col("doc_id") % 50).cast("string"))
    return R.keyword_places(x, "page", F.col("source") == "src0")


@query("o94_kept_books", f"{BASE_ALL} select qid, doc_id from rel where source = 'src1' and (doc_id % 3 = 0 or doc_id % 100 >= 70) qualify row_number() over (partition by qid order by score desc, doc_id) <= 5")
def kept_books(spark, d):
    cos = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 100 / 100)
    return R.kept_books(relevant(spark, d, None).withColumn("source", F.when(F.col("source") == "src1", "books").otherwise(F.col("source"))).withColumn("cos", cos))


@query("o93_kept_medicines", f"{BASE_ALL} select qid, doc_id from rel where source in ('src1', 'src2', 'src3', 'src4') and rank <= 3 and it >= 0.25")
def kept_medicines(spark, d):
    x = evidence(spark, d, None).withColumn("via", F.lit("words")).withColumn("place", F.col("rank") - 1).withColumn("title_share", F.col("title"))
    x = x.withColumn("source", F.when(F.col("source").isin("src1", "src2", "src3", "src4"), "nhs").otherwise(F.col("source")))
    return R.kept_medicines(x, share=0.25)


@query("o91_protect", f"{BASE_ALL}, x as (select qid, doc_id, rank, doc_id = max(doc_id) over (partition by qid) kept, count(*) over (partition by qid) n from rel), k as (select qid, max(rank) filter (kept) r from x group by qid) select qid, doc_id, case when r <= 3 then rank when kept then 3 when rank >= 3 and rank < r then rank + 1 else rank end place from x join k using (qid)")
def protect(spark, d):
    """One kept row a query: it goes to the third place at worst, and those from there on move down."""
    last = F.max("doc_id").over(Window.partitionBy("qid"))
    return R.protect(relevant(spark, d, None).select("qid", "doc_id", "rank", (F.col("doc_id") == last).alias("kept")), 3)


@query("o97_rrf", f"{BASE_ALL}, l as (select qid, doc_id, rank from rel union all select qid, doc_id, row_number() over (partition by qid order by doc_id) from rel) select qid, doc_id, round(sum(1 / (60.0 + rank)), 6) rrf from l group by all")
def rrf(spark, d):
    x = relevant(spark, d, None)
    other = x.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")).cast("long"))
    # sums of two unit fractions often lie half-way; they are rounded once, and as the SQL does it, on the scaled double
    return R.rrf(x.unionByName(other)).withColumn("rrf", F.round(F.col("rrf") * 1e6) / 1e6)


@query("o97_weighted_minmax", f"""{BASE_ALL}, l as (select qid, doc_id, 'a' list, score from rel union all select qid, doc_id, 'b', doc_id % 97 from rel), m as (select *, min(score) over w lo, max(score) over w hi from l window w as (partition by qid, list))
select qid, doc_id, round(sum(case when hi > lo then (score - lo) / (hi - lo) else 1.0 end * case list when 'a' then 0.7 else 0.3 end), 6) fused from m group by all""")
def weighted_minmax(spark, d):
    x = relevant(spark, d, None).select("qid", "doc_id", F.lit("a").alias("list"), "score")
    y = x.select("qid", "doc_id", F.lit("b").alias("list"), (F.col("doc_id") % 97).cast("double").alias("score"))
    return R.weighted_minmax(x.unionByName(y), {"a": 0.7, "b": 0.3})


@query("o90_distance_bonus", "select event_id, round(case when c >= 0.6 then 0.5 * 0.8 * least(1.0, (c - 0.6) / 0.22) else 0.0 end, 6) bonus, round(0.6 * least(1.0, greatest(0.0, (c - 0.72) / (0.82 - 0.72))), 6) lift from (select event_id, event_id % 101 / 100.0 c from events)")
def distance_bonus(spark, d):
    c = F.col("event_id") % 101 / 100
    return table(spark, d, "events").select("event_id", F.round(R.distance_bonus(c, 0.8), 6).alias("bonus"), F.round(R.ramp(c, 0.72, 0.82, 0.6), 6).alias("lift"))


@query("o134_union_of_retrievers", f"{BASE_ALL} select 'words' via, qid, doc_id, score, cast(null as bigint) n from rel union all select 'prefix', qid, doc_id, null, n from (with p as (select qid, left(min(term), 4) pre from q group by qid) select qid, doc_id, cast(sum(tf) as bigint) n from (select doc_id, term, count(*) tf from occ group by all) o join p on starts_with(term, pre) group by qid, doc_id)")
def union_of_retrievers(spark, d):
    p = batch(spark, d).select("qid", F.left(F.array_min("terms"), F.lit(4)).alias("prefix"))
    near = S.prefix(S.prefix_postings(table(spark, d, "documents"), p), p)
    words = relevant(spark, d, None).select(F.lit("words").alias("via"), "qid", "doc_id", "score")
    return L.together(words, near.select(F.lit("prefix").alias("via"), "qid", "doc_id", "n"))


@query("o80_condition_rows", f"""with {intent_sql(TEXTS_SQL)}, {EVIDENCE},
q as (select id qid, conditions from intents where kind = 'benchmark' and {SURE}),
any_word as (select condition, word from strong union select condition, word from weak),
held as (select doc_id, unnest({tok('text')}) word from documents),
hit as (select distinct qid, doc_id, conditions from q join any_word on list_contains(conditions, any_word.condition) join held on held.word = any_word.word)
select qid, doc_id, coalesce((select string_agg(condition, ',' order by list_position(hit.conditions, condition)) from proof where proof.id = hit.doc_id and list_contains(hit.conditions, condition)), '') evidence from hit""")
def condition_rows(spark, d):
    """Documents that hold a word of a condition that a passage describes, whatever else it says; with what they are evidence of."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("raw"))
    return I.condition_rows(table(spark, d, "documents"), I.flags(items, "qid", "raw"))
