"""Queries of text functions, corpus preparation, times, places, household arithmetic and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import domain as D, geo as G, text as T, times as C
from ..operators import corpus as P, library as L, spatial as X, vectors as V
from ..session import table
from .registry import query
from .search import DISTINCT, batch, tok
from .series import AT, HAVERSINE


def part(spark, d) -> DataFrame:
    return table(spark, d, "part")


def pages(spark, d) -> DataFrame:
    return table(spark, d, "pages")


@query("o31_url_under_prefix", r"select page_id, u = p or starts_with(u, p || '/') or starts_with(u, p || '#') under from (select page_id, regexp_replace(url_decode(url), '/+$', '') u, regexp_extract(url, '^(https?://[^/]+)', 1) || '/fr' p from pages)")
def url_under_prefix(spark, d):
    prefix = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/fr/"))
    return pages(spark, d).select("page_id", T.url_matches(F.col("url"), prefix).alias("under"))


@query("o32_page_key", "select page_id, split_part(url || '#part-' || page_id, '#', 1) page from pages")
def page_key(spark, d):
    return pages(spark, d).select("page_id", T.page_key(F.concat("url", F.lit("#part-"), "page_id")).alias("page"))


@query("o33_section_of", "select p_partkey, upper(lower(p_name)[1]) || lower(p_name)[2:] section from part")
def section_of(spark, d):
    return part(spark, d).select("p_partkey", T.section_of(F.concat(F.lit("/m/x#"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")))).alias("section"))


@query("o142_slugify", "select p_partkey, rtrim(left(trim(regexp_replace(lower(p_name || ' & ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-'), 12), '-') slug from part")
def slugify(spark, d):
    return part(spark, d).select("p_partkey", T.slugify(F.concat("p_name", F.lit(" & "), "p_type", F.lit("!")), 12).alias("slug"))


@query("o143_strip_markdown", r"select p_partkey, 'Title ' || p_name || ' see ' || p_type || ' a b' as plain from part")
def strip_markdown(spark, d):
    md = F.concat(F.lit("# Title\n\n**"), "p_name", F.lit("** see ["), "p_type", F.lit("](http://x/y)\n|---|:--:|\n| a | b |"))
    return part(spark, d).select("p_partkey", T.strip_markdown(md).alias("plain"))


@query("o144_strip_tags", r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header|aside)[^>]*>.*?</(script|style|nav|footer|header|aside)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) as plain from pages""")
def strip_tags(spark, d):
    return pages(spark, d).select("page_id", T.strip_tags(F.col("html")).alias("plain"))


WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '')"


@query("o147_cap_words", f"select doc_id, array_to_string(({WORDS})[1:20], ' ') as start, (len({WORDS}) + 49) // 50 chunks from documents")
def cap_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cap_words(F.col("text"), 20).alias("start"), F.size(T.chunks(F.col("text"), 50)).cast("long").alias("chunks"))


@query("o153_token_estimate", f"select doc_id, len({WORDS}) * 13 // 10 + 1 tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("o133_trim_around", f"with w as (select doc_id, {WORDS} w from documents), p as (select doc_id, w, greatest(1, coalesce(list_position(list_transform(w, lambda x: lower(x)), 'the'), 0) - 6) s from w) select doc_id, array_to_string(w[s:s + 19], ' ') around from p")
def trim_around(spark, d):
    return table(spark, d, "documents").select("doc_id", T.trim_around(F.col("text"), F.lit("the"), 20).alias("around"))


@query("o149_fuzzy_rank", """with x as (select p_partkey, lower(p_name) t, string_split(lower(p_name), ' ') w, replace(lower(p_name), 'a', 'o') typed from part),
n as (select *, list_min(list_transform(generate_series(1, len(w)), lambda i: levenshtein(array_to_string(w[1:i], ' '), typed))) near, case when length(typed) >= 6 then 2 when length(typed) >= 4 then 1 else 0 end most from x)
select p_partkey, case when typed = t then 0 when near <= most then near + 1 end rank from n""")
def fuzzy_rank(spark, d):
    return part(spark, d).select("p_partkey", T.fuzzy_rank(F.replace(F.lower("p_name"), F.lit("a"), F.lit("o")), F.col("p_name")).alias("rank"))


@query("o150_query_variants", f"with b as (select item_id, {tok('text')} t from benchmark), v as (select item_id, [array_to_string(t, ' ')] || (case when len(t) > 1 then list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) else [] end) || list_filter(t, lambda x: length(x) >= 4) l from b) select item_id, array_to_string({DISTINCT.format('l')}, '|') variants from v")
def query_variants(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.query_variants(F.col("text")), "|").alias("variants"))


@query("o151_loose_stem", f"""with w as (select distinct unnest({tok('text')}) w from documents), s as (select w, case when ends_with(w, 'ies') and length(w) > 5 then left(w, -3) || 'y' when regexp_matches(w, '[xsz]es$') and length(w) > 4 then left(w, -2)
when ends_with(w, 's') and not ends_with(w, 'ss') and not (ends_with(w, 'ies') and length(w) > 5) and length(w) > 4 then left(w, -1) else w end s from w)
select w, case when ends_with(s, 'ing') and length(s) >= 7 then left(s, -3) when ends_with(s, 'ous') and length(s) >= 7 then left(s, -3) when ends_with(s, 'ed') and length(s) >= 6 then left(s, -2) else s end stem from s""")
def loose_stem(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.all_tokens(F.col("text"))).alias("w")).distinct()
    return w.select("w", T.loose_stem(F.col("w")).alias("stem"))


@query("o152_question_titles", """select p_partkey, p_partkey % 4 in (0, 2) question from part""")
def question_titles(spark, d):
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat("p_name", F.lit("?"))).when(k == 1, F.concat(F.lit("How to mend a "), "p_name")).when(k == 2, F.concat(F.lit("Why is a "), "p_name")).otherwise(F.col("p_name"))
    return part(spark, d).select("p_partkey", T.is_question(title).alias("question"))


@query("o154_longest_terms", f"with b as (select item_id, {tok('text')} t from benchmark), x as (select item_id, unnest({DISTINCT.format('t')}) w, generate_subscripts({DISTINCT.format('t')}, 1) i from b), r as (select *, row_number() over (partition by item_id order by length(w) desc, i) n from x) select item_id, string_agg(w, ' ' order by i) terms from r where n <= 5 group by item_id")
def longest_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.longest_terms(T.tokens(F.col("text")), 5), " ").alias("terms"))


@query("o155_citations", r"""with t as (select o_orderkey, 'see [' || o_custkey % 5 || ', ' || o_orderkey % 7 || '] and [' || o_orderkey % 3 || '][x]' t from orders), i as (select o_orderkey, flatten(list_transform(regexp_extract_all(t, '\[(\d+(?:, *\d+)*)\]', 1), lambda m: list_transform(string_split_regex(m, ', *'), lambda x: cast(x as int)))) i from t),
k as (select o_orderkey, list_filter(i, lambda x: x in (1, 2, 3, 4)) i from i) select o_orderkey, array_to_string(list_filter(i, lambda x, n: list_position(i, x) = n), ',') cited from k""")
def citations(spark, d):
    t = F.concat(F.lit("see ["), F.col("o_custkey") % 5, F.lit(", "), F.col("o_orderkey") % 7, F.lit("] and ["), F.col("o_orderkey") % 3, F.lit("][x]"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.citations(t, F.array(*map(F.lit, (1, 2, 3, 4)))).cast("array<string>"), ",").alias("cited"))


@query("o27_place_candidates", """select c_custkey, case c_custkey % 3 when 0 then 'near ' || n_name || '|' || n_name when 1 then n_name || ' IN' || '|' || n_name else n_name end places from customer join nation on c_nationkey = n_nationkey""")
def place_candidates(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    q = F.when(k == 0, F.concat(F.lit("near "), "n_name")).when(k == 1, F.concat("n_name", F.lit("  IN "))).otherwise(F.col("n_name"))
    return x.select("c_custkey", F.array_join(T.place_candidates(q), "|").alias("places"))


@query("o88_passage_text", "select p_partkey, p_name || '. Store ' || p_type || ' dry' as passage from part")
def passage_text(spark, d):
    body = F.concat(F.lit("What to do:\n Store {{x}} "), "p_type", F.lit("  [[call]] dry"))
    return part(spark, d).select("p_partkey", T.passage_text(F.col("p_name"), body, F.lit("/m/x#what-to-do")).alias("passage"))


@query("o145_badges", "select p_partkey, p_name as badge, case when length(p_name || ' ' || p_type) <= 22 then p_name || ' ' || p_type else regexp_replace(left(p_name || ' ' || p_type, 22), '\\s+\\S*$', '') || '…' end chip from part")
def badges(spark, d):
    return part(spark, d).select("p_partkey", T.badge_title(F.concat("p_name", F.lit(" (build, December 2025)"))).alias("badge"), T.chip_label(F.concat_ws(" ", "p_name", "p_type")).alias("chip"))


# corpus preparation


@query("o117_quality")
def quality(spark, d):
    return P.quality(table(spark, d, "documents"))


@query("o118_edge_lines", r"""with x as (select source, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), k as (select source, doc_id, [lower(trim(regexp_replace(l[1], '\d+', '#', 'g'))), lower(trim(regexp_replace(l[-1], '\d+', '#', 'g')))] k from x),
e as (select distinct source, doc_id, unnest(k) line from k), n as (select source, count(*) pages from x group by 1) select source, line, count(*) on_pages, pages from e join n using (source) where line <> '' group by source, line, pages having count(*) >= greatest(2, pages * 0.01)""")
def edge_lines(spark, d):
    return P.edge_lines(table(spark, d, "documents"), "source", "doc_id", "text", share=0.01, least=2)


@query("o126_seen_before", f"with r as (select source, doc_id, ({tok('text')})[1] line from documents) select doc_id, exists(select 1 from r y where y.source = x.source and y.line = x.line and y.doc_id between x.doc_id - 40 and x.doc_id - 1) as repeats from r x where line is not null")
def seen_before(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.get(T.all_tokens(F.col("text")), F.lit(0)).alias("line")).filter("line is not null")
    return P.seen_before(rows, "source", "doc_id", "line", 40).select("doc_id", "repeats")


@query("o128_chapters")
def chapters(spark, d):
    """Documents of a source as one book: each line a block, short lines its headings."""
    lines = P.lines(table(spark, d, "documents")).withColumn("words", F.size(T.words(F.col("line"))).cast("long")).filter("words > 0")
    return P.chapters(lines.withColumn("heading", F.col("words") <= 6).select("doc_id", "pos", "heading", "words"), "doc_id", 400, 60)


BLOCKS = f"""b as (select doc_id, i pos, w, list_filter(w, lambda x: x in ('the', 'of', 'and', 'de', 'la')) h, least(len(list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> '')) * 13 // 10 + 1, 60) cost
  from (select doc_id, i, line, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') w from (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 i from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)))),
p as (select *, sum(cost) over (partition by doc_id order by pos) e from b)"""


@query("o132_best_window", f"""with {BLOCKS}, r as (select a.doc_id, a.pos s, max(z.pos) t from p a join p z on z.doc_id = a.doc_id and z.pos >= a.pos and z.e - (a.e - a.cost) <= 60 group by all),
c as (select r.doc_id, s, t, sum(len(h)) hits from r join b on b.doc_id = r.doc_id and b.pos between s and t group by all), u as (select r.doc_id, s, count(distinct x) met from r join (select doc_id, pos, unnest(h) x from b) y on y.doc_id = r.doc_id and y.pos between s and t group by all),
f as (select c.doc_id, s, t, round(hits + 10 * coalesce(met, 0) - 0.001 * s, 6) score from c left join u using (doc_id, s)) select doc_id, s as start, t as stop, cast(score as double) score from f qualify row_number() over (partition by doc_id order by score desc, s) = 1""")
def best_window(spark, d):
    rows = P.lines(table(spark, d, "documents"))
    w = T.all_tokens(F.col("line"))
    hits = F.filter(w, lambda x: x.isin("the", "of", "and", "de", "la"))
    blocks = rows.select("doc_id", "pos", T.token_estimate(F.col("line")).alias("cost"), F.size(hits).alias("hits"), F.array_distinct(hits).alias("terms"))
    return P.best_window(blocks, "doc_id", 60)


@query("o148_sentence_chunks")
def sentence_chunks(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(P.sentence_chunks(F.col("text"))).alias("pos", "chunk"))
    return x.select("doc_id", "pos", F.char_length("chunk").alias("chars"))


@query("o162_links", r"""with h as (select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) root, regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']([^"''#]+)', 1) l from pages), a as (select page_id, list_filter(list_transform(l, lambda x: case when regexp_matches(x, '^https?://') then x when starts_with(x, '/') then root || x end), lambda x: x is not null) l from h),
u as (select page_id, list_filter(l, lambda x, i: list_position(l, x) = i) l from a) select page_id, unnest(l) link, generate_subscripts(l, 1) - 1 pos from u""")
def links(spark, d):
    return P.links(pages(spark, d), "page_id", "html", "url")


@query("o163_sections", "select p_partkey, cast(s as bigint) as section, case s when 1 then p_name when 2 then 'Then' end title, case s when 0 then 'intro' when 1 then '```' || chr(10) || '## no ' || p_type || chr(10) || '```' else 'end' end body from part, range(3) r(s)")
def sections(spark, d):
    md = F.concat(F.lit("intro\n## "), "p_name", F.lit("\n```\n## no "), "p_type", F.lit("\n```\n## Then\nend"))
    return P.sections(part(spark, d).select("p_partkey", md.alias("md")), "p_partkey", "md")


# times


@query("o166_duration", "select o_orderkey, case o_orderkey % 4 when 0 then (o_orderkey % 50) * 60.0 when 1 then (o_orderkey % 50) * 3600.0 when 2 then (o_orderkey % 50 + 0.5) * 86400.0 end as seconds from orders")
def duration(spark, d):
    k, n = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 50).cast("string")
    text = F.concat(n, F.when(k == 0, "m").when(k == 1, "h").when(k == 2, ".5d").otherwise(" weeks"))
    return table(spark, d, "orders").select("o_orderkey", C.duration_seconds(text).alias("seconds"))


@query("o167_phase", "select event_id, case when s < 43200 then 'first-hours' when s < 259200 then 'first-days' when s < 2592000 then 'first-weeks' else 'long-term' end phase from (select event_id, epoch_us(ts) / 1e6 - epoch(timestamp '2024-01-01') s from events)")
def phase(spark, d):
    elapsed = C.seconds(F.col("ts")) - F.lit(1704067200.0)
    return table(spark, d, "events").select("event_id", C.phase(elapsed).alias("phase"))


@query("o168_stale", "select event_id, coalesce(case when event_id % 3 = 0 then ts + interval '10 days' end, ts) < timestamp '2024-01-30' - interval '24 hours' stale from events")
def stale(spark, d):
    confirmed = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 10 days"))
    return table(spark, d, "events").select("event_id", C.is_stale(F.col("ts"), confirmed, F.to_timestamp(F.lit("2024-01-30 00:00:00"))).alias("stale"))


@query("o169_sun", """with x as (select o_orderkey, 2 * pi() / 365 * (dayofyear(o_orderdate) - 1) g, -70 + o_custkey % 141 lat, -180 + o_orderkey % 361 lon from orders),
y as (select *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) d from x),
z as (select *, cos(radians(90.833)) / (cos(radians(lat)) * cos(d)) - tan(radians(lat)) * tan(d) c from y), h as (select *, case when abs(c) <= 1 then degrees(acos(case when abs(c) <= 1 then c else 0 end)) * 4 end half, 720 - 4 * lon - eq noon from z)
select o_orderkey, round(noon - half, 3) sunrise, round(noon + half, 3) sunset from h""")
def sun(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", C.sun_minutes(F.to_date("o_orderdate"), (F.lit(-70) + F.col("o_custkey") % 141).cast("double"), (F.lit(-180) + F.col("o_orderkey") % 361).cast("double")).alias("s"))
    return x.select("o_orderkey", F.round("s.sunrise", 3).alias("sunrise"), F.round("s.sunset", 3).alias("sunset"))


@query("o170_moon_phase", "select o_orderkey, round(mod(mod((epoch(o_orderdate) - 947182440) / 86400, 29.530588853) + 29.530588853, 29.530588853) / 29.530588853, 5) phase from orders")
def moon_phase(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(C.moon_phase(F.col("o_orderdate")), 5).alias("phase"))


@query("o171_next_daily", "select event_id, strftime(case when ts < date_trunc('day', ts) + interval '7 hours' then date_trunc('day', ts) + interval '7 hours' when ts < date_trunc('day', ts) + interval '1110 minutes' then date_trunc('day', ts) + interval '1110 minutes' else date_trunc('day', ts) + interval '31 hours' end, '%Y-%m-%d %H:%M:%S') next_at from events")
def next_daily(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(C.next_daily(F.col("ts"), ["07:00", "18:30"], "UTC"), AT).alias("next_at"))


@query("o172_season_and_dates", "select o_orderkey, case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) <= 5 then 'spring' when month(o_orderdate) <= 8 then 'summer' else 'autumn' end season, strftime(o_orderdate, '%d/%m/%Y') uk from orders")
def season_and_dates(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", C.season(F.month("o_orderdate")).alias("season"), C.uk_date(F.col("o_orderdate")).alias("uk"), F.to_date("o_orderdate").alias("day"))
    return x.filter(C.iso_date(F.col("uk")) == F.col("day")).drop("day")


@query("o173_fallout", "select event_id, h as hours, ts + to_hours(h) <= timestamp '2024-01-10' reached, cast(greatest(0, ceil((epoch_us(ts) / 1e6) + h * 3600 - epoch(timestamp '2024-01-10'))) as bigint) left_s from events, (values (7), (49), (343)) v(h)")
def fallout(spark, d):
    x = table(spark, d, "events").select("event_id", F.explode(C.fallout(F.col("ts"), F.to_timestamp(F.lit("2024-01-10 00:00:00")))).alias("m"))
    return x.select("event_id", "m.hours", "m.reached", "m.left_s")


# places


def placed(df: DataFrame, key: str) -> DataFrame:
    """Rows with a place made of their key."""
    k = F.col(key)
    return df.withColumn("lat", F.lit(50) + (k * 7919 % 1000) * F.lit(0.00397171)).withColumn("lon", F.lit(-3) + (k * 104729 % 1000) * F.lit(0.00497313))


PLACE = "50 + ({0} * 7919 % 1000) * 0.00397171 lat, -3 + ({0} * 104729 % 1000) * 0.00497313 lon"


@query("o174_distance_bearing", f"""with p as (select c_custkey, {PLACE.format('c_custkey')} from customer), m as (select *, {HAVERSINE.format('51.5', '-0.12', 'lat', 'lon')} m, degrees(atan2(sin(radians(lon + 0.12)) * cos(radians(lat)), cos(radians(51.5)) * sin(radians(lat)) - sin(radians(51.5)) * cos(radians(lat)) * cos(radians(lon + 0.12)))) b from p),
w as (select *, case when b < 0 then b + 360 else b end deg from m) select c_custkey, round(m, 1) metres, round(deg, 3) bearing, (['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'])[cast(floor(deg / 22.5 + 0.5) as int) % 16 + 1] point, cast(greatest(1, ceil(m / 5000 * 60 + 12)) as bigint) as minutes from w""")
def distance_bearing(spark, d):
    p = placed(table(spark, d, "customer"), "c_custkey")
    here = (F.lit(51.5), F.lit(-0.12), F.col("lat"), F.col("lon"))
    m, b = G.haversine(*here), G.bearing(*here)
    return p.select("c_custkey", F.round(m, 1).alias("metres"), F.round(b, 3).alias("bearing"), G.compass(b).alias("point"), G.naismith_minutes(m, F.lit(120.0)).alias("minutes"))


@query("o175_tiles", f"with p as (select c_custkey, {PLACE.format('c_custkey')} from customer) select c_custkey, cast(floor((lon + 180) / 360 * 4096) as bigint) x, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) as bigint) y from p")
def tiles(spark, d):
    p = placed(table(spark, d, "customer"), "c_custkey")
    return p.select("c_custkey", G.tile(F.col("lat"), F.col("lon"), 12).alias("t")).select("c_custkey", "t.x", "t.y")


@query("o176_boxes", f"with p as (select c_custkey, {PLACE.format('c_custkey')} from customer) select c_custkey, lat between 51 and 52 and lon between -2.5 and -1 as inside, lon - 0.5 <= -1 and lon + 0.5 >= -2.5 and lat - 0.5 <= 52 and lat + 0.5 >= 51 as meets, 'N' || lpad(cast(floor(lat) as int)::varchar, 2, '0') || case when lon >= 0 then 'E' else 'W' end || lpad(abs(cast(floor(lon) as int))::varchar, 3, '0') tile from p")
def boxes(spark, d):
    p = placed(table(spark, d, "customer"), "c_custkey")
    box = F.struct(F.lit(-2.5).alias("west"), F.lit(51.0).alias("south"), F.lit(-1.0).alias("east"), F.lit(52.0).alias("north"))
    own = F.struct((F.col("lon") - 0.5).alias("west"), (F.col("lat") - 0.5).alias("south"), (F.col("lon") + 0.5).alias("east"), (F.col("lat") + 0.5).alias("north"))
    return p.select("c_custkey", G.box_holds(box, F.col("lat"), F.col("lon")).alias("inside"), G.boxes_meet(own, box).alias("meets"), G.height_tile(F.col("lat"), F.col("lon")).alias("tile"))


@query("o177_in_polygon", f"with p as (select c_custkey, {PLACE.format('c_custkey')} from customer), e(a, b, c, d) as (values (50.5, -2.5, 53.5, -2.0), (53.5, -2.0, 52.0, 1.5), (52.0, 1.5, 50.5, -2.5)) select c_custkey, count(*) filter (((a > lat) <> (c > lat)) and lon < (d - b) / (c - a) * (lat - a) + b) % 2 = 1 inside from p, e group by c_custkey")
def in_polygon(spark, d):
    p = placed(table(spark, d, "customer"), "c_custkey")
    return p.select("c_custkey", G.in_polygon(F.col("lat"), F.col("lon"), [(50.5, -2.5), (53.5, -2.0), (52.0, 1.5)]).alias("inside"))


@query("o178_grid", """with g as (select o_orderkey, (o_orderkey * 7919) % 700000 e, (o_orderkey * 104729) % 1300000 n from orders), l as (select *, e // 100000 x, n // 100000 y, 'ABCDEFGHJKLMNOPQRSTUVWXYZ' a from g)
select o_orderkey, substr(a, cast((4 - (y // 5 + 1)) * 5 + x // 5 + 2 + 1 as int), 1) || substr(a, cast((4 - y % 5) * 5 + x % 5 + 1 as int), 1) || ' ' || lpad(((e % 100000) // 100)::varchar, 3, '0') || ' ' || lpad(((n % 100000) // 100)::varchar, 3, '0') ref, cast(e // 100 * 100 as double) easting, cast(n // 100 * 100 as double) northing from l""")
def grid(spark, d):
    """References of points, and the points that are read from them."""
    x = table(spark, d, "orders").select("o_orderkey", G.grid_reference(F.col("o_orderkey") * 7919 % 700_000, F.col("o_orderkey") * 104_729 % 1_300_000).alias("ref"))
    return x.withColumn("p", G.parse_grid(F.col("ref"))).select("o_orderkey", "ref", "p.easting", "p.northing")


NEAR = f"c as (select c_custkey, {PLACE.format('c_custkey')} from customer), s as (select s_suppkey, s_nationkey % 3 as kind, {PLACE.format('(s_suppkey + 17)')} from supplier), d as (select c_custkey, s_suppkey, kind, {HAVERSINE.format('c.lat', 'c.lon', 's.lat', 's.lon')} m from c, s)"


@query("o48_nearest_features", f"with {NEAR} select c_custkey, s_suppkey, kind, round(m, 1) metres, row_number() over (partition by c_custkey, kind order by round(m, 0), s_suppkey) rank from d where m <= 20000 qualify rank <= 3")
def nearest_features(spark, d):
    a = placed(table(spark, d, "customer"), "c_custkey").select("c_custkey", "lat", "lon")
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") + 17)
    b = placed(s, "k").select("s_suppkey", (F.col("s_nationkey") % 3).alias("kind"), "lat", "lon")
    return X.nearest(a, b, 3, 20_000.0, "kind", "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", "kind", F.round("metres", 1).alias("metres"), "rank")


@query("o49_clusters", f"""with recursive p as (select s_suppkey id, s_nationkey % 2 as name, {PLACE.format('s_suppkey')} from supplier), e as (select a.id x, b.id y from p a join p b on a.name = b.name and {HAVERSINE.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15000),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on e.x = r.y) select x as id, min(y) cluster from r group by x""")
def clusters(spark, d):
    p = placed(table(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2).alias("name"), "lat", "lon")
    return X.clusters(p, 15_000.0, ["name"])


@query("o108_centroids", f"with p as (select c_mktsegment, c_nationkey, c_name, c_custkey, {PLACE.format('c_custkey')} from customer) select c_mktsegment, c_nationkey, round(avg(lat), 4) lat, round(avg(lon), 4) lon, min_by(c_name, c_custkey) c_name, count(*) n from p group by 1, 2")
def centroids(spark, d):
    x = X.centroids(placed(table(spark, d, "customer"), "c_custkey"), ["c_mktsegment", "c_nationkey"], "c_name", "c_custkey")
    return x.withColumns({"lat": F.round("lat", 4), "lon": F.round("lon", 4)})


# household arithmetic


@query("o28_classify_items", "select p_partkey, case when p_size > 40 then 'extended' when k = 0 then 'uk-official' when k = 1 then case when p_partkey % 2 = 0 then 'nhs' else 'medical' end when k = 2 then 'survival' else 'reference' end cls from (select *, p_partkey % 5 k from part)")
def classify_items(spark, d):
    k = F.col("p_partkey") % 5
    category = F.when(k == 0, "uk-official").when(k == 1, "medical").when(k == 2, "survival").when(k == 3, "reference").otherwise("other")
    item = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("nhs-"), "p_partkey")).otherwise(F.concat(F.lit("kit-"), "p_partkey"))
    return part(spark, d).select("p_partkey", D.source_class(F.when(F.col("p_size") > 40, "extended").otherwise("core"), category, item).alias("cls"))


@query("o26_postcodes", r"with c as (select c_custkey, case c_custkey % 5 when 0 then 'AB' || c_custkey % 30 || ' 1AA' when 1 then 'e' || c_custkey % 9 || 'w 2cd' when 2 then 'N' || c_custkey % 10 when 3 then c_name else 'AB123 1AA' end q from customer) select c_custkey, regexp_matches(q, '(?i)^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$') is_code, regexp_matches(q, '(?i)^[A-Z]{1,2}\d[A-Z\d]?$') is_district from c")
def postcodes(spark, d):
    k = F.col("c_custkey")
    q = F.when(k % 5 == 0, F.concat(F.lit("AB"), k % 30, F.lit(" 1AA"))).when(k % 5 == 1, F.concat(F.lit("e"), k % 9, F.lit("w 2cd"))).when(k % 5 == 2, F.concat(F.lit("N"), k % 10)).when(k % 5 == 3, F.col("c_name")).otherwise("AB123 1AA")
    return table(spark, d, "customer").select("c_custkey", D.is_postcode(q).alias("is_code"), D.is_district(q).alias("is_district"))


@query("o36_item_status", """select p_partkey, case when p_size <= 40 then 'Core' when p_partkey % 2 = 0 then 'External drive' else 'On external drive (not connected)' end drive,
case when p_partkey % 3 = 0 then null when p_partkey % 7 = 0 then 'build' when p_size > 40 and p_partkey % 2 = 1 then 'drive' else 'download' end as fetch, case when p_partkey % 3 = 0 then '/doc/' || p_partkey end reader, case when p_partkey % 3 = 0 then '/docs/' || case when p_size > 40 then 'extended' else 'core' end || '/' || p_partkey || '.pdf' end file from part""")
def item_status(spark, d):
    k = F.col("p_partkey")
    here, tier, on = k % 3 == 0, F.when(F.col("p_size") > 40, "extended").otherwise("core"), k % 2 == 0
    made = F.when(k % 7 == 0, "build").otherwise("url")
    dest, original = F.concat(F.lit("x/"), k, F.when(k % 2 == 0, ".pdf").otherwise(".epub")), F.concat(F.lit("y/"), k, F.lit(".pdf"))
    return part(spark, d).select(
        "p_partkey", L.drive_label(tier, on).alias("drive"), L.fetch_state(here, F.lit("pdf"), made, tier, on).alias("fetch"),
        L.reader_url(here, F.lit("pdf"), k.cast("string"), F.lit(None).cast("string")).alias("reader"), L.file_url(here, F.lit("pdf"), dest, original, tier).alias("file"),
    )


@query("o37_facilities", "select p_partkey, k in (0, 1) and p_size % 4 > 0 as emergency, k = 2 as pharmacy, k in (3, 4) as rest from (select *, p_partkey % 6 k from part)")
def facilities(spark, d):
    k = F.col("p_partkey") % 6
    amenity = F.when(k <= 1, "Hospital").when(k == 2, "pharmacy").when(k == 3, "shelter").otherwise("cafe")
    tags = F.create_map(F.lit("amenity"), amenity, F.lit("emergency"), F.when(k == 4, "assembly_point").when(F.col("p_size") % 4 == 0, "no").otherwise("yes"))
    x = part(spark, d).select("p_partkey", tags.alias("t"))
    return x.select("p_partkey", D.facility(F.col("t"), "emergency-department").alias("emergency"), D.facility(F.col("t"), "pharmacy").alias("pharmacy"), D.facility(F.col("t"), "rest-centre").alias("rest"))


@query("o179_kit_quantity", "select p_partkey, case p_partkey % 3 when 0 then p_size * 2 * 3 when 1 then p_size * 2 else p_size end * 1.0 total, case p_partkey % 3 when 0 then (p_size * 6) || ' l for 2 people over 3 days' when 1 then (p_size * 2) || ' l for 2 people' else p_size || ' l' end as text from part")
def kit_quantity(spark, d):
    per = F.when(F.col("p_partkey") % 3 == 0, "person-day").when(F.col("p_partkey") % 3 == 1, "person")
    return part(spark, d).select("p_partkey", D.kit_quantity(F.col("p_size"), F.lit("l"), per, F.lit(2), F.lit(3)).alias("k")).select("p_partkey", "k.total", "k.text")


@query("o180_supplies", """select l_orderkey, l_linenumber, round(case when l_tax > 0 then l_quantity / l_tax end, 6) generator, round(case when l_discount > 0 then l_extendedprice * 0.85 / (l_discount * 1000) end + 1e-9, 6) battery, round(l_quantity / (2 * 3), 6) as days,
cast(floor(l_quantity * 10 * (4 - 3.5 * a / 6) + 0.5) as bigint) low, cast(floor(l_quantity * 10 * (5 - 4.0 * a / 6) + 0.5) as bigint) high from (select *, least(abs(month(l_shipdate) - 6), 12 - abs(month(l_shipdate) - 6)) a from lineitem)""")
def supplies(spark, d):
    solar = D.solar_daily(F.col("l_quantity") * 10, F.month("l_shipdate"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(D.generator_hours(F.col("l_quantity"), F.col("l_tax")), 6).alias("generator"), F.round(D.battery_hours(F.col("l_extendedprice"), F.col("l_discount") * 1000) + 1e-9, 6).alias("battery"),
        F.round(D.ration_days(F.col("l_quantity"), F.lit(2), F.lit(3)), 6).alias("days"), solar["low"].alias("low"), solar["high"].alias("high"),
    )


DOSES = ", ".join(f"('{f}', {a}, {b}, '{x}')" for f, a, b, x, *_ in D.DOSES)


@query("o52_dose_bands", f"with b(form, low, high, amount) as (values {DOSES}), c as (select c_custkey, c_custkey % 230 as months, case c_nationkey % 3 when 0 then 'paracetamol liquid 120' when 1 then 'ibuprofen liquid 100' else 'ibuprofen tablet 200' end form from customer) select c_custkey, months, c.form, amount from c left join b on b.form = c.form and months >= low and months < high")
def dose_bands(spark, d):
    k = F.col("c_nationkey") % 3
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 230).alias("months"), F.when(k == 0, "paracetamol liquid 120").when(k == 1, "ibuprofen liquid 100").otherwise("ibuprofen tablet 200").alias("form"))
    return L.in_bands(c, D.doses(spark), "form", "months").select("c_custkey", "months", "form", "amount")


@query("o182_readings", """select event_id, case when event_id % 3 = 0 then case when value >= 1 then 'on' else 'off' end else regexp_replace(printf('%.1f', floor(value * 10 + 0.5) / 10), '\\.0$', '') || ' ppm' end as text, case when event_id % 3 = 0 then case when value >= 1 then 'ok' else 'danger' end when value >= 50 then 'danger' when value >= 10 then 'warn' else 'ok' end tone from events where value is not null""")
def readings(spark, d):
    unit = F.when(F.col("event_id") % 3 == 0, "on").otherwise("ppm")
    return table(spark, d, "events").filter("value is not null").select("event_id", D.reading_text(F.col("value"), unit).alias("text"), D.reading_tone(F.lit("co_ppm"), F.col("value"), unit).alias("tone"))


@query("o159_wording", "select p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' works' as words, 'Mon to Fri 08:00-' || (10 + p_size % 10) || ':00; bank holidays closed' as hours, 'Ireland – ' || p_name || ' – 1' as pack from part")
def wording(spark, d):
    tag = F.concat(F.lower("p_type"), F.lit("_works"))
    hours = F.concat(F.lit("Mo-Fr 08:00-"), (F.lit(10) + F.col("p_size") % 10).cast("string"), F.lit(":00;PH off"))
    return part(spark, d).select("p_partkey", D.humanise(tag).alias("words"), D.opening_hours(hours).alias("hours"), D.pack_title(F.concat(F.lit("Ireland_"), "p_name", F.lit("_1"))).alias("pack"))


# vectors


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def asked(spark, d) -> DataFrame:
    """Every vector whose id is divisible by 20, against all."""
    return vectors(spark, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


UNIT = "u as (select vec_id, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double))))) v from embeddings)"


@query("o85_exact_topk", f"with {UNIT}, c as (select q.vec_id qid, u.vec_id, round(list_dot_product(q.v, u.v), 6) cos from u q, u where q.vec_id % 20 = 0) select qid, vec_id, cos, row_number() over (partition by qid order by cos desc, vec_id) rank from c qualify rank <= 10")
def exact_topk(spark, d):
    return V.topk(vectors(spark, d), asked(spark, d), 10)


@query("o86_approximate_topk")
def approximate_topk(spark, d):
    return V.approximate(vectors(spark, d), asked(spark, d), 10)


@query("o87_vector_problems", "select vec_id, case when vec_id % 4 = 0 then 'dims' when vec_id % 4 = 1 then 'zero' end problem, round(case when vec_id % 4 > 1 then sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double)))) end, 5) norm from embeddings")
def vector_problems(spark, d):
    k, e = F.col("vec_id") % 4, F.col("embedding")
    odd = F.when(k == 0, F.slice(e, 1, 3)).when(k == 1, F.transform(e, lambda x: x * 0)).otherwise(e)
    x = vectors(spark, d).select("vec_id", odd.alias("v"), F.size(e).alias("n"))
    return x.select("vec_id", V.problem(F.col("v"), F.col("n")).alias("problem"), F.round(F.when(k > 1, V.norm(F.col("v"))), 5).alias("norm"))


@query("o98_truncated", "with t as (select vec_id, list_transform(embedding[1:8], lambda x: cast(x as double)) t from embeddings) select vec_id, round(t[1] / sqrt(list_sum(list_transform(t, lambda y: y * y))), 5) as first, len(t) dims from t")
def truncated(spark, d):
    t = vectors(spark, d).select("vec_id", V.truncate(F.col("embedding"), 8).alias("t"))
    return t.select("vec_id", F.round(F.get("t", F.lit(0)), 5).alias("first"), F.size("t").cast("long").alias("dims"))


@query("o99_pooled", "with w as (select user_id, list(round(value, 3) order by event_id)[1:5] c from events where value is not null group by 1), s as (select user_id, c, list_reverse_sort(c) r from w) select user_id, round(list_max(c), 6) as max, round(list_avg(c), 6) as mean, round(list_avg(r[1:2]), 6) as top2 from s")
def pooled(spark, d):
    c = F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.round("value", 3).alias("v")))), lambda x: x["v"])
    w = table(spark, d, "events").filter("value is not null").groupBy("user_id").agg(c.alias("c"))
    return w.select("user_id", V.pooled(F.col("c"), 5).alias("p")).select("user_id", F.round("p.max", 6).alias("max"), "p.mean", "p.top2")


@query("o47_rerank", "with q as (select vec_id qid, embedding q from embeddings where vec_id % 20 = 0), h as (select qid, q, (qid + k * 37) doc_id from q, range(5) r(k)) select qid, doc_id, case when embedding is not null then round(list_dot_product(cast(q as double[]), cast(embedding as double[])), 5) end cos from h left join embeddings on vec_id = doc_id")
def rerank(spark, d):
    h = asked(spark, d).select("qid", F.col("embedding").alias("q"), F.explode(F.array(*[F.col("qid") + k * 37 for k in range(5)])).alias("doc_id"))
    return V.rerank(h, vectors(spark, d)).select("qid", "doc_id", "cos")
