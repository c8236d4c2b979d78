"""Queries of the situation rules: customers are situations, their orders set the states of services, events are readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import rules as U
from ..session import table
from .registry import query
from .series import AT

SERVICES = {"1-URGENT": "power", "2-HIGH": "water", "3-MEDIUM": "mobile", "4-NOT SPECIFIED": "landline", "5-LOW": "heating"}
NOW = "2003-01-01 00:00:00"
#: (pos, rule, when, unless, after_s, target, to_state, bucket, rank, sets, open)
RULES = [
    (1, "store-water", {"power": ["off", "degraded"], "water": ["working", "degraded"]}, {"mobile": ["off"]}, 3600, "water", "off", "now", 2, {"lights": "low"}, ["page:water", "card:boil"]),
    (2, "boil", {"water": ["degraded"]}, None, 7200, "heating", "degraded", "hour", 1, {"water": "boil"}, ["card:boil"]),
    (3, "dark", {"power": ["off"]}, None, 0, "landline", "off", "now", 1, {"lights": "off"}, ["page:light", "page:water"]),
    (4, "call", {"landline": ["any"]}, {"landline": ["working"]}, 259200, "mobile", "off", "today", 1, {}, []),
    (5, "always", {}, None, 0, "water", "degraded", "week", 5, {"lights": "normal"}, ["page:start"]),
]
SCHEMA = "pos int, rule string, `when` map<string,array<string>>, unless map<string,array<string>>, after_s long, target string, to_state string, bucket string, `rank` int, sets map<string,string>, open array<string>"


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """(situation, id, state, source, since): the newest order of each customer and priority."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    named = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in SERVICES.items()])
    state = F.when(F.col("o_orderstatus") == "F", "working").when(F.col("o_orderstatus") == "O", "degraded").otherwise("off")
    source = F.when(F.col("o_orderkey") % 3 == 0, "manual").otherwise("default")
    return last.select(F.col("o_custkey").alias("situation"), named.alias("id"), state.alias("state"), source.alias("source"), F.col("o_orderdate").alias("since"))


def detected(spark, d) -> DataFrame:
    """(situation, id, state, at): what the newest event of a user says of the power."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("situation")).agg(F.max_by(F.struct("value", "ts"), "event_id").alias("e"))
    return e.select("situation", F.lit("power").alias("id"), F.when(F.coalesce("e.value", F.lit(0.0)) < 30, "off").otherwise("working").alias("state"), F.col("e.ts").alias("at"))


def hits(spark, d) -> DataFrame:
    maps = U.state_maps(U.effective(conditions(spark, d), detected(spark, d)))
    rules = spark.createDataFrame(RULES, SCHEMA)
    return U.applied(rules, maps.withColumn("now", F.to_timestamp(F.lit(NOW)).cast("timestamp_ntz")))


STATES = """c as (select o_custkey situation, case o_orderpriority when '1-URGENT' then 'power' when '2-HIGH' then 'water' when '3-MEDIUM' then 'mobile' when '4-NOT SPECIFIED' then 'landline' else 'heating' end id,
  case o_orderstatus when 'F' then 'working' when 'O' then 'degraded' else 'off' end state, o_orderkey % 3 = 0 manual, o_orderdate since from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1),
d as (select user_id situation, 'power' id, case when coalesce(value, 0) < 30 then 'off' else 'working' end state, ts as seen from events qualify row_number() over (partition by user_id order by event_id desc) = 1),
e as (select c.situation, c.id, case when d.state is not null and not manual then d.state else c.state end state, since from c left join d using (situation, id))"""
HITS = f"""{STATES},
s as (select situation, max(state) filter (id = 'power') p, max(state) filter (id = 'water') w, max(state) filter (id = 'mobile') m, max(state) filter (id = 'landline') l, max(state) filter (id = 'heating') h,
  max(since) filter (id = 'power' and state <> 'working') ps, max(since) filter (id = 'water' and state <> 'working') ws, max(since) filter (id = 'landline' and state <> 'working') ls from e group by 1),
r(pos, rule, after_s, target, to_state, bucket, rank) as (values (1, 'store-water', 3600, 'water', 'off', 'now', 2), (2, 'boil', 7200, 'heating', 'degraded', 'hour', 1), (3, 'dark', 0, 'landline', 'off', 'now', 1), (4, 'call', 259200, 'mobile', 'off', 'today', 1), (5, 'always', 0, 'water', 'degraded', 'week', 5)),
k as (select s.*, r.*, case pos when 1 then list_max([ps, ws]) when 2 then ws when 3 then ps when 4 then ls end began from s, r
  where case pos when 1 then p in ('off', 'degraded') and w in ('working', 'degraded') when 2 then w = 'degraded' when 3 then p = 'off' when 4 then l is not null else true end),
hit as (select *, coalesce(began, timestamp '{NOW}') + to_seconds(after_s) due, case pos when 1 then coalesce(m = 'off', false) when 4 then coalesce(l = 'working', false) else false end blocked from k)"""


@query("o183_effective", f"with {STATES} select situation, id, state from e")
def effective(spark, d):
    return U.effective(conditions(spark, d), detected(spark, d)).select("situation", "id", "state")


@query("o186_contradictions", f"with {STATES} select c.situation, c.id, d.state, strftime(seen, '%Y-%m-%d %H:%M:%S') due_at from c join d using (situation, id) where manual and c.state <> d.state and seen > since")
def contradictions(spark, d):
    x = U.contradictions(conditions(spark, d).withColumn("updated", F.col("since")), detected(spark, d))
    return x.withColumn("due_at", F.date_format("due_at", AT))


@query("o50_applied_rules", f"with {HITS} select situation, rule from hit")
def applied(spark, d):
    return hits(spark, d).select("situation", "rule")


@query("o184_triggers", f"with {HITS} select situation, rule, strftime(coalesce(began, timestamp '{NOW}'), '%Y-%m-%d %H:%M:%S') trigger from hit")
def triggers(spark, d):
    return hits(spark, d).select("situation", "rule", F.date_format("trigger", AT).alias("trigger"))


@query("o185_inferred", f"""with {HITS}, t as (select *, case target when 'water' then w when 'heating' then h when 'landline' then l else m end now_state from hit)
select situation, target, to_state, strftime(due, '%Y-%m-%d %H:%M:%S') due_at, rule from t where now_state is not null and now_state <> to_state and not (to_state = 'degraded' and now_state = 'off') and due <= timestamp '{NOW}'
qualify row_number() over (partition by situation, target order by case to_state when 'working' then 0 when 'degraded' then 1 else 2 end desc, due desc, pos) = 1""")
def inferred(spark, d):
    return U.inferred(hits(spark, d)).withColumn("due_at", F.date_format("due_at", AT))


@query("o187_forecast", f"with {HITS} select situation, rule, strftime(due, '%Y-%m-%d %H:%M:%S') due_at, due <= timestamp '{NOW}' passed, row_number() over (partition by situation order by due, rule) place from hit")
def forecast(spark, d):
    return U.forecast(hits(spark, d)).withColumn("due_at", F.date_format("due_at", AT))


@query("o188_tasks", f"with {HITS} select situation, rule, bucket, row_number() over (partition by situation order by case bucket when 'now' then 0 when 'hour' then 1 when 'today' then 2 else 3 end, rank, pos) place from hit where not blocked and due <= timestamp '{NOW}'")
def tasks(spark, d):
    return U.tasks(hits(spark, d))


@query("o190_modes", f"with {HITS}, x as (select situation, pos, case pos when 2 then 'water' else 'lights' end as key, case pos when 1 then 'low' when 2 then 'boil' when 3 then 'off' else 'normal' end as value from hit where pos <> 4) select situation, key, max_by(value, pos) as value from x group by all")
def modes(spark, d):
    return U.modes(hits(spark, d))


@query("o189_briefing", f"with {HITS}, o(pos, i, link) as (values (1, 0, 'page:water'), (1, 1, 'card:boil'), (2, 0, 'card:boil'), (3, 0, 'page:light'), (3, 1, 'page:water'), (5, 0, 'page:start')), m as (select situation, link, min(hit.pos * 10 + i) a from hit join o on o.pos = hit.pos group by all) select situation, link, row_number() over (partition by situation order by a) place from m")
def briefing(spark, d):
    return U.briefing(hits(spark, d))


@query("o191_flags", f"with {HITS} select situation, coalesce(p, 'working') <> 'off' as power, coalesce(m, 'working') <> 'off' or coalesce(l, 'working') <> 'off' as phones, situation % 2 = 0 as dark from s")
def flags(spark, d):
    maps = U.state_maps(U.effective(conditions(spark, d), detected(spark, d)))
    x = maps.select("situation", U.flags(F.col("states"), F.col("situation") % 2 == 0, F.lit(None).cast("string")).alias("f"))
    return x.select("situation", *[F.try_element_at("f", F.lit(k)).alias(k) for k in ("power", "phones", "dark")])


@query("o38_clause_match", f"with {HITS} select situation, coalesce(case when coalesce(array_position(['working', 'degraded', 'off'], coalesce(m, 'working')), 1) <= coalesce(array_position(['working', 'degraded', 'off'], coalesce(l, 'working')), 1) then coalesce(m, 'working') else coalesce(l, 'working') end in ('off', 'degraded'), false) and situation % 2 = 0 as holds from s")
def clause_match(spark, d):
    """A clause about what is derived from the states."""
    maps = U.state_maps(U.effective(conditions(spark, d), detected(spark, d)))
    more = U.derived(F.col("states"), F.col("situation") % 2 == 0, F.lit(False), F.lit(1), F.lit(None).cast("string"))
    lit = lambda *x: F.array(*map(F.lit, x))
    clause = F.create_map(F.lit("phones"), lit("off", "degraded"), F.lit("dark"), lit("true"), F.lit("season"), lit("winter"))
    return maps.select("situation", U.holds(clause, more).alias("holds"))


@query("o192_reports")
def reports(spark, d):
    h = hits(spark, d)
    return U.reports(U.effective(conditions(spark, d), detected(spark, d)), U.forecast(h), U.tasks(h))
