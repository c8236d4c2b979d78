"""Situation rules over service states: matching, inference, forecasts, tasks, modes.

A rule's clause is map<string, array<string>>: every key must hold, a list means any of its values, an unknown key
never holds, an empty clause always does. The state of a situation is map<string, string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import season

#: Severity of states, and buckets by urgency.
STATES = ("working", "degraded", "off")
BUCKETS = ("now", "hour", "today", "week")
RULES_MOST = 10_000  # rules are written by hand; a longer list meets its situations without a broadcast


def place(value: Column, of: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(value == x, i) for i, x in enumerate(of)], F.lit(len(of)))


def derived(states: Column, dark: Column, drill: Column, month: Column, scenario: Column) -> Column:
    """The states that clauses may ask for beside the services: phones (on if either telephone is), dark, drill, season, scenario."""
    working = lambda k: F.coalesce(F.try_element_at(states, F.lit(k)), F.lit("working"))
    better = F.when(place(working("mobile"), STATES) <= place(working("landline"), STATES), working("mobile")).otherwise(working("landline"))
    word = lambda c: F.when(c, "true").otherwise("false")
    more = F.create_map(F.lit("phones"), better, F.lit("dark"), word(dark), F.lit("drill"), word(drill), F.lit("season"), season(month))
    named = F.when(scenario.isNotNull(), F.create_map(F.lit("scenario"), scenario)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(states, lambda k, v: ~k.isin("phones", "dark", "drill", "season", "scenario")), more, named)


def flags(states: Column, dark: Column, scenario: Column, services: tuple[str, ...] = ("power", "water", "heating", "mobile", "landline")) -> Column:
    """What content may ask for: a service is on unless it is off; phones if either telephone is on; dark; the scenario."""
    on = {k: F.coalesce(F.try_element_at(states, F.lit(k)), F.lit("working")) != "off" for k in services}
    pairs = [x for k, v in on.items() for x in (F.lit(k), v)]
    own = F.create_map(*pairs, F.lit("phones"), on["mobile"] | on["landline"], F.lit("dark"), F.coalesce(dark, F.lit(False)))
    return F.when(scenario.isNull(), own).otherwise(F.map_concat(own, F.create_map(F.concat(F.lit("scenario:"), scenario), F.lit(True))))


def contradictions(conditions: DataFrame, detected: DataFrame) -> DataFrame:
    """Readings that disagree with what a person has set and are newer than it: (situation, id, state, due_at). conditions:
    (situation, id, state, source, updated); detected: (situation, id, state, at)."""
    d = detected.select("situation", "id", F.col("state").alias("read"), "at")
    x = conditions.filter("source = 'manual'").join(d, ["situation", "id"])
    newer = F.col("updated").isNull() | (F.col("at") > F.col("updated"))
    return x.filter((F.col("read") != F.col("state")) & newer).select("situation", "id", F.col("read").alias("state"), F.col("at").alias("due_at"))


def briefing(hits: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Per situation the links that its readings open, each once, in order of rules and within them; first (situation, link)
    comes before all. hits: (situation, pos, open array<string>)."""
    x = hits.select("situation", "pos", F.posexplode("open").alias("i", "link"))
    if first is not None:
        x = x.unionByName(first.select("situation", F.lit(-1).alias("pos"), F.lit(0).alias("i"), "link"))
    once = x.groupBy("situation", "link").agg(F.min(F.struct("pos", "i")).alias("at"))
    return once.select("situation", "link", F.row_number().over(Window.partitionBy("situation").orderBy("at")).cast("long").alias("place"))


def reports(states: DataFrame, forecasts: DataFrame, tasks_: DataFrame) -> DataFrame:
    """(situation, report): conditions, what is coming and tasks as Markdown. states (situation, id, state); forecasts and tasks
    as above."""
    lines = lambda rows, order, line: rows.groupBy("situation").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]).alias("l"))
    c = lines(states, ["id"], F.concat(F.lit("- **"), "id", F.lit("**: "), "state")).withColumnRenamed("l", "conditions")
    f = lines(forecasts, ["place"], F.concat(F.lit("- "), F.when(F.col("passed"), "PASSED ").otherwise("due "), F.date_format("due_at", "yyyy-MM-dd HH:mm"), F.lit(": "), "rule")).withColumnRenamed("l", "coming")
    t = lines(tasks_, ["place"], F.concat(F.lit("- [ ] "), "rule", F.lit(" ("), "bucket", F.lit(")"))).withColumnRenamed("l", "todo")
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(f"## {title}"), F.lit("")), c, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(F.array(F.lit("# Situation report"), F.lit("")), part("Conditions", F.col("conditions")), part("What is coming", F.col("coming")), part("Tasks", F.col("todo")))
    x = c.join(f, "situation", "left").join(t, "situation", "left")
    return x.select("situation", F.concat(F.regexp_replace(F.array_join(whole, "\n"), "\n+$", ""), F.lit("\n")).alias("report"))


def holds(clause: Column, states: Column) -> Column:
    entry = lambda e: F.coalesce(F.array_contains(e["value"], F.try_element_at(states, e["key"])) | (F.array_contains(e["value"], "any") & F.try_element_at(states, e["key"]).isNotNull()), F.lit(False))
    return F.forall(F.map_entries(F.coalesce(clause, F.create_map().cast("map<string,array<string>>"))), entry)


def effective(conditions: DataFrame, detected: DataFrame) -> DataFrame:
    """(situation, id, state, since): a reading counts unless a person has set the state."""
    d = detected.select("situation", "id", F.col("state").alias("read"))
    x = conditions.join(d, ["situation", "id"], "left")
    return x.select("situation", "id", F.when(F.col("read").isNotNull() & (F.col("source") != "manual"), F.col("read")).otherwise(F.col("state")).alias("state"), "since")


def state_maps(states: DataFrame) -> DataFrame:
    """A row a situation: the states, and the times since which services do not work."""
    since = F.map_from_entries(F.collect_list(F.when(F.col("state") != "working", F.struct("id", "since"))))
    return states.groupBy("situation").agg(F.map_from_entries(F.collect_list(F.struct("id", "state"))).alias("states"), since.alias("since"))


def applied(rules: DataFrame, situations: DataFrame) -> DataFrame:
    """Rules beside the situations in which they hold, with the time at which what they are about began: the latest of the services
    they name that do not work, else the situation's own time. Up to RULES_MOST rules every task reads them whole."""
    few = rules.limit(RULES_MOST + 1).count() <= RULES_MOST
    x = situations.join(F.broadcast(rules) if few else rules, holds(F.col("when"), F.col("states")))
    times = F.filter(F.transform(F.map_keys("when"), lambda k: F.try_element_at(F.col("since"), k)), lambda t: t.isNotNull())
    return x.withColumn("trigger", F.coalesce(F.array_max(times), F.col("now")))


def due(trigger: Column, after_s: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(trigger.cast("timestamp")) + after_s * 1_000_000).cast("long")).cast("timestamp_ntz")


def inferred(hits: DataFrame) -> DataFrame:
    """The strongest proposal for each service: off before degraded, then the later due time, then the rule's place."""
    now = F.try_element_at("states", F.col("target"))
    x = hits.withColumn("due_at", due(F.col("trigger"), F.col("after_s")))
    known = now.isNotNull() & (now != F.col("to_state")) & ~((F.col("to_state") == "degraded") & (now == "off"))
    x = x.filter(known & (F.col("due_at") <= F.col("now")))
    w = Window.partitionBy("situation", "target").orderBy(place(F.col("to_state"), STATES).desc(), F.desc("due_at"), "pos")
    return x.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("situation", "target", "to_state", "due_at", "rule")


def forecast(hits: DataFrame) -> DataFrame:
    x = hits.withColumn("due_at", due(F.col("trigger"), F.col("after_s")))
    w = Window.partitionBy("situation").orderBy("due_at", "rule")
    return x.select("situation", "rule", "due_at", (F.col("due_at") <= F.col("now")).alias("passed"), F.row_number().over(w).cast("long").alias("place"))


def tasks(hits: DataFrame) -> DataFrame:
    """Unblocked and due tasks, each once, by bucket, rank and place in the list."""
    x = hits.filter(~(F.col("unless").isNotNull() & holds(F.col("unless"), F.col("states"))) & (due(F.col("trigger"), F.col("after_s")) <= F.col("now")))
    once = x.withColumn("nth", F.row_number().over(Window.partitionBy("situation", "rule").orderBy("pos"))).filter("nth = 1")
    w = Window.partitionBy("situation").orderBy(place(F.col("bucket"), BUCKETS), "rank", "pos")
    return once.select("situation", "rule", "bucket", F.row_number().over(w).cast("long").alias("place"))


def with_checklist(tasks_: DataFrame, ticks: DataFrame) -> DataFrame:
    """Tasks and the items of checklists (situation, rule, bucket, place), each id once, tasks first; ticked ones are done.
    ticks: (situation, rule, done)."""
    w = Window.partitionBy("situation", "rule").orderBy("place")
    once = tasks_.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    return once.join(ticks.select("situation", "rule", F.col("done").alias("ticked")), ["situation", "rule"], "left").withColumn("done", F.coalesce("ticked", F.lit(False))).drop("ticked")


def modes(hits: DataFrame) -> DataFrame:
    """Per key the value that the last matching rule sets."""
    x = hits.select("situation", "pos", F.explode("sets").alias("key", "value"))
    return x.groupBy("situation", "key").agg(F.max_by("value", "pos").alias("value"))
