"""Queries over time series (events), merges (orders) and evaluation (orders, lineitem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geo
from ..operators import evaluation as E, library as L, merge as M, series as S
from ..session import table
from ..streaming import jobs
from .registry import query

AT = "yyyy-MM-dd HH:mm:ss"
AT_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def stamped(c: str):
    return F.date_format(c, AT)


@query("o41_latest_by_key", "select user_id, event_id, event_type, round(value, 6) as value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def latest_by_key(spark, d):
    return S.latest(events(spark, d), "user_id").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("o104_max_by_key", f"select user_id, max(event_id) last_id, {AT_SQL.format('max(ts)')} last_at from events group by user_id")
def max_by_key(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max("ts").alias("at")).select("user_id", "last_id", stamped("at").alias("last_at"))


HISTORY = "h as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) nth from events qualify nth <= {0})"


@query("o123_history", f"with {HISTORY.format(48)} select user_id, event_id, nth from h")
def history(spark, d):
    return S.history(events(spark, d), "user_id", 48).select("user_id", "event_id", "nth")


@query("o124_dropped", f"with {HISTORY.format(48)}, x as (select user_id, max(value) filter (nth = 1) newest, max(value) filter (nth > 1) best, count(*) n from h group by user_id) select user_id, round(newest, 6) newest, round(best, 6) best, n, best - newest >= 10 fell from x where n >= 3 and newest is not null and best is not null")
def dropped(spark, d):
    return S.dropped(events(spark, d), "user_id", 10.0).select("user_id", F.round("newest", 6).alias("newest"), F.round("best", 6).alias("best"), "n", "fell")


@query("o125_failing", f"with {HISTORY.format(3)} select user_id from h group by user_id having count(*) >= 3 and count(*) filter (coalesce(value, 0) < 30) = count(*)")
def failing(spark, d):
    return S.failing(events(spark, d), "user_id", 30.0)


@query("o131_islands", "with x as (select *, coalesce(value < 20, false) bad, sum(case when coalesce(value < 20, false) then 0 else 1 end) over (partition by user_id order by ts, event_id) g from events) select user_id, g as good_before, count(*) run from x where bad group by all")
def islands(spark, d):
    return S.islands(events(spark, d), "user_id", F.coalesce(F.col("value") < 20, F.lit(False)))


HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"


@query("o130_path_length", f"with p as (select user_id, event_id, 50 + (event_id % 100) * 0.001 lat, -1 + (event_id % 37) * 0.001 lon from events), s as (select *, lag(lat) over w a, lag(lon) over w o from p window w as (partition by user_id order by event_id)) select user_id, round(sum(coalesce({HAVERSINE.format('a', 'o', 'lat', 'lon')}, 0)), 1) metres, count(*) points from s group by user_id")
def path_length(spark, d):
    p = events(spark, d).select("user_id", "event_id", (F.lit(50) + (F.col("event_id") % 100) * F.lit(0.001)).alias("lat"), (F.lit(-1) + (F.col("event_id") % 37) * F.lit(0.001)).alias("lon"))
    return S.path_length(p, "user_id", "event_id", geo.haversine)


@query("o193_tumbling", f"select {AT_SQL.format(chr(39).join(['date_trunc(', 'hour', ', ts)']))} as start, event_type, count(*) n, round(avg(value), 6) as mean from events group by all")
def tumbling(spark, d):
    return S.tumbling(events(spark, d), "1 hour", "event_type").withColumn("start", stamped("start"))


@query("o194_sliding", f"with x as (select time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' as b, event_type, value from events, range(4) r(k)) select {AT_SQL.format('b')} as start, event_type, count(*) n, round(avg(value), 6) as mean from x group by all")
def sliding(spark, d):
    return S.tumbling(events(spark, d), "1 hour", "event_type", slide="15 minutes").withColumn("start", stamped("start"))


@query("o195_sessions", f"with x as (select *, case when ts < lag(ts) over w + interval '30 minutes' then 0 else 1 end b from events window w as (partition by user_id order by ts)), y as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) s from x) select user_id, {AT_SQL.format('min(ts)')} as start, count(*) n from y group by user_id, s")
def sessions(spark, d):
    return S.sessions(events(spark, d), "user_id", "30 minutes").withColumn("start", stamped("start"))


@query("o196_stream_distinct", "select event_type, count(distinct event_id) n from events group by event_type")
def stream_distinct(spark, d):
    """Rows of a stream that holds each event twice, once each."""
    rows = jobs.drained(jobs.distinct(jobs.events(spark, d, copies=2), ["event_id"], "2 hours"), "distinct")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("o197_streaks", "with x as (select *, sum(case when value < 20 then 0 else 1 end) over (partition by user_id order by ts, event_id) g from events), y as (select *, row_number() over (partition by user_id, g order by ts, event_id) r from x where value < 20) select user_id, event_id from y where r = 3")
def streaks(spark, d):
    return jobs.streaks_batch(events(spark, d), 20.0, 3)


@query("o198_retention", "select event_type, count(*) n from events where ts >= (select max(ts) from events) - interval '14 days' group by event_type")
def retention(spark, d):
    return S.retain(events(spark, d), 14).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# merges


def side(spark, d, status: str) -> DataFrame:
    """(key, at, v): a snapshot of customers by orders of a status; every seventh key has no time."""
    x = table(spark, d, "orders").filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("at"), F.count(F.lit(1)).alias("v"))
    return x.select("key", F.when(F.col("key") % 7 > 0, F.date_format("at", AT)).alias("at"), "v")


SIDES = """a as (select o_custkey as key, case when o_custkey % 7 > 0 then strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') end as at, count(*) v from orders where o_orderstatus = 'F' group by 1),
b as (select o_custkey as key, case when o_custkey % 7 > 0 then strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') end as at, count(*) v from orders where o_orderstatus = 'O' group by 1)"""


@query("o137_last_writer_wins", f'''with {SIDES}, u as (select *, false taken from a union all select *, true from b) select key, "at", v, taken from u qualify row_number() over (partition by key order by "at" desc nulls last, taken) = 1''')
def last_writer_wins(spark, d):
    return M.last_writer_wins(side(spark, d, "F"), side(spark, d, "O"), ["key"], "at")


@query("o138_append_absent", f"with {SIDES} select * from a union all select * from b where key not in (select key from a)")
def append_absent(spark, d):
    return M.append_absent(side(spark, d, "F"), side(spark, d, "O"), ["key"])


@query("o136_upsert", f"with {SIDES} select key, case when b.key is not null then b.v else a.v end v from a full join b using (key)")
def upsert(spark, d):
    return M.upsert(side(spark, d, "F").select("key", "v"), side(spark, d, "O"), ["key"], ["v"])


@query("o43_without_stale", f"with {SIDES} select key, key in (select key from b) stays from a")
def without_stale(spark, d):
    stays, gone = M.without_stale(side(spark, d, "F"), side(spark, d, "O"), ["key"])
    return stays.select("key", F.lit(True).alias("stays")).unionByName(gone.select("key", F.lit(False).alias("stays")))


@query("o139_keys_apart", f"with {SIDES} select key, case when b.v is null then 'a' when a.v is null then 'b' else 'both' end side from a full join b using (key)")
def keys_apart(spark, d):
    return L.keys_apart(side(spark, d, "F"), side(spark, d, "O"), ["key"])


@query("o18_export_restore", """select c_custkey as key, sha256(body) digest, length(body) chars from (select c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' body from customer)""")
def export_restore(spark, d):
    """Customers as canonical JSON, exported in pieces and restored from them."""
    names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    pieces = M.export(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), M.canonical_json(names).alias("payload")), 40)
    back = M.restore(pieces).filter("problem is null")
    return back.select("key", M.checksum(F.col("payload")).alias("digest"), F.char_length("payload").cast("long").alias("chars"))


# evaluation


def records(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_custkey") % 13 < 10, F.col("o_custkey") % 13 + 1)
    return o.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("set"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("group"), rank.alias("rank"), F.round("o_totalprice", 0).alias("latency"))


RECORDS = """r as (select o_orderkey qid, o_orderpriority as "set", case when o_orderstatus <> 'P' then o_orderstatus end as "group", case when o_custkey % 13 < 10 then o_custkey % 13 + 1 end as rank, round(o_totalprice, 0) latency from orders)"""
METRICS = """count(*) n, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) hit1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) hit3, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) hit5,
round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) hit10, round(avg(case when rank <= 10 then 1.0 / rank else 0.0 end), 6) mrr10, round(avg(case when rank <= 10 then ln(2) / ln(rank + 1) else 0.0 end), 6) ndcg10"""


@query("o109_ir_metrics", f"""with {RECORDS}, o as (select *, row_number() over (partition by "set" order by latency) i, count(*) over (partition by "set") c from r) select "set", {METRICS}, round(median(latency), 6) as median, round(max(latency) filter (i = ceil(0.95 * c)), 6) as p95 from o group by "set" """)
def ir_metrics(spark, d):
    out = records(spark, d).groupBy("set").agg(*E.metrics(F.col("rank"), "latency"))
    return out.withColumn("median", F.round("median", 6)).withColumn("p95", F.round("p95", 6))


@query("o110_rollup", f"""with {RECORDS} select case when grouping("set") = 1 then 'ALL' when grouping("group") = 1 then "set" else "set" || '/' || "group" end as label, {METRICS} from r group by grouping sets (("set"), ("set", "group"), ()) having grouping("group") = 1 or "group" is not null""")
def rollup(spark, d):
    return E.rollup(records(spark, d))


@query("o53_first_rank", "with g as (select distinct l_orderkey qid, l_partkey doc_id from lineitem where l_quantity < 10), h as (select qid, min(l_linenumber) as rank from g join lineitem on l_orderkey = qid and l_partkey = doc_id group by qid) select qid, h.rank from (select distinct qid from g) left join h using (qid)")
def first_rank(spark, d):
    l = table(spark, d, "lineitem")
    results = l.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    return E.first_rank(results, l.filter("l_quantity < 10").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id")))


@query("o54_compare_runs", """with a as (select o_orderkey qid, o_custkey % 17 + 1 ra from orders where o_orderkey % 9 > 0), b as (select o_orderkey qid, o_custkey % 19 + 1 rb from orders where o_orderkey % 11 > 0)
select qid, case when rb is null then 'only_a' when ra is null then 'only_b' when ra > 10 and rb <= 10 then 'rescued' when ra <= 10 and rb > 10 then 'regressed' when ra <= 10 and rb < ra then 'better' when ra <= 10 and rb > ra and rb <= 10 then 'worse' else 'same' end verdict from a full join b using (qid)""")
def compare_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), "o_custkey")
    a = o.filter("qid % 9 > 0").select("qid", (F.col("o_custkey") % 17 + 1).alias("rank"))
    return E.compare(a, o.filter("qid % 11 > 0").select("qid", (F.col("o_custkey") % 19 + 1).alias("rank")))


@query("o111_gates", """with x as (select year(o_orderdate) run, o_orderpriority metric, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as value from orders group by all)
select run, metric, value, coalesce(value >= case metric when '1-URGENT' then 0.33 when '5-LOW' then 0.3 end, true) passes, coalesce(lag(value) over (partition by metric order by run) - value <= 0.01, true) holds from x""")
def gates(spark, d):
    good = (F.col("o_orderstatus") == "F").cast("long")
    x = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("run"), F.col("o_orderpriority").alias("metric")).agg(E.rate(F.sum(good), F.count(F.lit(1))).alias("value"))
    return E.gates(x, {"1-URGENT": 0.33, "5-LOW": 0.3}, 0.01)


@query("o114_wins", """with p as (select o_orderpriority as "set", round(1.0 / (o_custkey % 5 + 1) - 1.0 / (o_orderkey % 5 + 1), 6) d from orders) select "set", round(avg(d), 6) diff, count(*) filter (d > 0) wins, count(*) filter (d < 0) losses, count(*) filter (d = 0) ties from p group by 1""")
def wins(spark, d):
    """The parts of the paired bootstrap that no random numbers touch."""
    pairs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("set"), (1.0 / (F.col("o_orderkey") % 5 + 1)).alias("a"), (1.0 / (F.col("o_custkey") % 5 + 1)).alias("b"))
    return E.paired_bootstrap(pairs).select("set", F.round("diff", 6).alias("diff"), "wins", "losses", "ties")


@query("o114_paired_bootstrap")
def paired_bootstrap(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("set"), (1.0 / (F.col("o_orderkey") % 5 + 1)).alias("a"), (1.0 / (F.col("o_custkey") % 5 + 1)).alias("b"))
    return E.paired_bootstrap(pairs)


GOLD = "g as (select distinct l_orderkey qid, l_partkey doc_id from lineitem where l_quantity < 25), w as (select qid, count(*) relevant from g group by qid), h as (select qid, count(*) found, sum(ln(2) / ln(l_linenumber + 1)) dcg from g join lineitem on l_orderkey = qid and l_partkey = doc_id where l_linenumber <= 4 group by qid)"


@query("o113_coverage", f"with {GOLD}, i as (select qid, sum(ln(2) / ln(k + 1)) ideal from w, range(1, 5) t(k) where k <= relevant group by qid) select qid, relevant, coalesce(found, 0) found, round(coalesce(found, 0) / relevant, 6) coverage, round(coalesce(dcg, 0) / ideal, 6) ndcg from w join i using (qid) left join h using (qid)")
def coverage(spark, d):
    l = table(spark, d, "lineitem")
    results = l.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    return E.covered(results, l.filter("l_quantity < 25").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id")), k=4)


@query("o115_percentiles", "select l_returnflag as kind, round(quantile_cont(l_discount, 0.05), 6) p5, round(quantile_cont(l_discount, 0.5), 6) p50, round(quantile_cont(l_discount, 0.95), 6) p95, count(*) n from lineitem group by 1")
def percentiles(spark, d):
    return E.profile(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_discount"), "kind", "l_discount")


@query("o116_share_by_kind", "with x as (select l_returnflag as kind, count(*) filter (l_linenumber = 1) one, count(*) filter (l_linenumber <= 10) ten, median(l_quantity) middle from lineitem group by 1) select kind, round(one / (select sum(one) from x), 6) top1, round(ten / (select sum(ten) from x), 6) top10, middle from x")
def share_by_kind(spark, d):
    return E.shares_by_kind(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("length")))


@query("o129_halves", "select o_orderkey qid, o_orderpriority as set, (row_number() over (partition by o_orderpriority order by o_orderkey) - 1) % 2 half from orders")
def halves(spark, d):
    return E.halves(table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("set")))


# catalogue, lookups and counts


def books(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("shelf"), F.col("p_retailprice").alias("popularity"))


BOOKS = "b as (select p_partkey id, p_name title, p_brand author, case when p_size % 5 > 0 then p_type end shelf, p_retailprice popularity from part)"


@query("o1_scan_equal_order", "select p_partkey, p_name from part where p_brand = 'Brand#2' and p_size = 11 order by p_retailprice, p_partkey")
def scan_equal(spark, d):
    return L.scan(table(spark, d, "part"), {"p_brand": "Brand#2", "p_size": 11}, ["p_retailprice", "p_partkey"]).select("p_partkey", "p_name")


@query("o35_catalogue_pages", f"with {BOOKS} select id, shelf, row_number() over w place, count(*) over (partition by shelf) total, (row_number() over w - 1) // 40 + 1 page from b where list_contains(regexp_extract_all(lower(title), '[a-z]+'), 'ring') window w as (partition by shelf order by popularity desc, id)")
def catalogue_pages(spark, d):
    found = L.chosen(books(spark, d), words="ring")
    return L.pages(found, "shelf", 40, [F.desc("popularity"), "id"]).select("id", "shelf", "place", "total", "page")


@query("o35_catalogue_first_page", f"with {BOOKS} select id, title from b where author = 'Brand#2' order by lower(title), id limit 40")
def catalogue_page(spark, d):
    return L.listing(books(spark, d), sort="title", author="Brand#2").select("id", "title")


@query("o102_shelf_counts", f"with {BOOKS} select shelf, count(*) n, row_number() over (order by count(*) desc, shelf) place from b where shelf is not null group by shelf")
def shelf_counts(spark, d):
    return L.shelves(books(spark, d))


@query("o103_scalar_counts", "select count(*) n, count(*) filter (p_size > 40) large from part")
def scalar_counts(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p_size") > 40).cast("long")).alias("large"))


@query("o39_distinct", "select distinct p_name, p_brand from part")
def distinct(spark, d):
    return table(spark, d, "part").select("p_name", "p_brand").distinct()


@query("o42_semi_join", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def semi_join(spark, d):
    wanted = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return L.among(table(spark, d, "orders"), wanted, "o_custkey").select("o_orderkey")


@query("o44_lookup_default", "select c_custkey, cast(coalesce(case c_mktsegment when 'BUILDING' then 1.6 when 'HOUSEHOLD' then 0.6 end, 1.0) as double) weight from customer")
def lookup_default(spark, d):
    weights = spark.createDataFrame([("BUILDING", 1.6), ("HOUSEHOLD", 0.6)], "c_mktsegment string, weight double")
    return L.looked_up(table(spark, d, "customer"), weights, "c_mktsegment", "weight", 1.0).select("c_custkey", "weight")


@query("o51_ticks", "select c_custkey, coalesce(n % 2 = 1, false) checked, last as updated from customer left join (select o_custkey, count(*) n, strftime(max(o_orderdate), '%Y-%m-%d') last from orders group by 1) on o_custkey = c_custkey")
def ticks(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count(F.lit(1)) % 2 == 1).alias("checked"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated"))
    return L.ticked(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"])


@query("o105_done_by_tier", "select c_mktsegment, count(*) filter (c_acctbal > 0) done, count(*) total from customer group by 1")
def done_by_tier(spark, d):
    return L.done_by(table(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal") > 0)


@query("o107_greatest", "select l_orderkey, l_linenumber, greatest(l_discount * 100, l_tax * 100, l_quantity) loudest from lineitem")
def greatest(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"), F.col("l_quantity").alias("c"))
    return L.strongest(x.withColumn("k", F.struct("l_orderkey", "l_linenumber")), "k", ["a", "b", "c"], "loudest").select("k.*", "loudest")


@query("o112_counts_by_kind", """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""")
def counts_by_kind(spark, d):
    return L.counted(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("o127_first_appearance", "select l_orderkey, l_suppkey, min(l_linenumber) pos from lineitem group by all")
def first_appearance(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("pos"))
    return L.first_appearances(x, ["l_orderkey"], ["l_suppkey"], "pos")


@query("o140_together", "select n_nationkey as id, n_name as name, n_regionkey as region from nation union all select r_regionkey, r_name, null from region")
def together(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return L.together(a, table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
