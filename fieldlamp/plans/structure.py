"""Queries of structure: blocks of printed lines, paragraphs of pages, directives, marks, grid projections; and of what is kept on disk: the index, builds, generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo as G, text as T
from ..operators import builds as U, corpus as P, directives as D, index as X, pages as H, reflow as R, vectors as V
from ..session import new_path, table
from ..sources import files
from ..streaming import jobs
from . import series  # noqa: F401  its SQL is used here
from .registry import ORACLES, query
from .search import batch, stem_sql
from .texts import UNIT, vectors

WORDS_A_LINE, LINES_A_PAGE = 8, 40


def printed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, page, line): documents as a printer sets them, so many words a line and lines a page."""
    wrapped = F.regexp_replace(F.coalesce("text", F.lit("")), rf"((?:\S+ ){{{WORDS_A_LINE}}})", "$1\n")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(wrapped, "\n")).alias("n", "raw"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.floor(F.col("n") / LINES_A_PAGE).alias("page"), R.tidy(F.col("raw")).alias("line"))


def has(pattern: str, c: str = "line") -> str:
    return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"


LETTERS, CAPITALS = r"length(regexp_replace(line, '[^\p{L}]', '', 'g'))", r"length(regexp_replace(line, '[^\p{Lu}]', '', 'g'))"
TITLE = f"""case when length(line) > 90 or {has('[.,;]$')} or {has(R.MARKED_ITEM)} or {LETTERS} < 3 then ''
  when {has(R.DIVISION)} or ({CAPITALS} > 0.85 * {LETTERS} and {LETTERS} >= 4) then 'h1'
  when {has(R.NUMBERED_TITLE)} and len(regexp_split_to_array(line, '\\s+')) <= 12 then 'h2' else '' end"""
PRINTED = rf"""
set_ as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '((?:\S+ ){{{WORDS_A_LINE}}})', '\1' || chr(10), 'g'), chr(10)) l from documents),
raw as (select doc_id, unnest(l) raw, generate_subscripts(l, 1) - 1 n from set_),
lines as (select doc_id, n, n // {LINES_A_PAGE} page, trim(regexp_replace(raw, '\s+', ' ', 'g')) line from raw)"""


@query("o156_line_kinds", f"""with {PRINTED}, k as (select doc_id, {TITLE} title, {has(R.CAPTION)} and length(line) < 90 caption, {has(R.ITEM)} item,
  line <> '' and ({has(R.PAGE_NUMBER)} or {has(R.RULE)} or (length(line) <= 12 and len(regexp_split_to_array(line, '\\s+')) <= 4 and len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}{{3,}}$'))) = 0)) noise,
  {has(R.LEADER)} leader from lines where line <> '')
select doc_id, count_if(title = 'h1') h1, count_if(title = 'h2') h2, count_if(caption) captions, count_if(item) items, count_if(noise) noise, count_if(leader) leaders from k group by doc_id""")
def line_kinds(spark, d):
    line = F.col("line")
    x = printed(spark, d).filter("line <> ''").withColumn("title", R.heading_kind(line))
    caption = line.rlike(R.CAPTION) & (F.char_length(line) < R.LONGEST_HEADING)
    return x.groupBy("doc_id").agg(
        F.count_if(F.col("title") == "h1").alias("h1"), F.count_if(F.col("title") == "h2").alias("h2"), F.count_if(caption).alias("captions"), F.count_if(line.rlike(R.ITEM)).alias("items"),
        F.count_if(R.is_noise(line)).alias("noise"), F.count_if(line.rlike(R.LEADER)).alias("leaders"),
    )


@query("o157_prose_and_windows", r"""with t as (select doc_id, coalesce(text, '') text from documents), p as (select doc_id, unnest(string_split(text, chr(10))) line from t),
s as (select doc_id, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) words, length(regexp_replace(line, '[^\p{L}]', '', 'g')) letters, length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) upper,
  length(line) n, regexp_matches(line, '[a-z]{3,} [a-z]{2,} [a-z]{2,}') runs, len(regexp_extract_all(line, '[.!?]')) stops, len(regexp_extract_all(line, ',')) commas, len(regexp_extract_all(line, '\b(?:CHAPTER|Chapter|PART)\b')) heads from p),
c as (select doc_id, count_if(words >= 30 and letters >= 0.7 * n and upper <= 0.25 * letters and runs and (stops >= 2 or commas >= 2) and heads < 3) prose from s group by doc_id),
w as (select doc_id, k, substr(text, cast(floor(length(text) * (k + 0.5) / 3) as int) + 1, 600) whole from t, range(3) r(k)),
x as (select doc_id, k, substr(whole, length(regexp_extract(substr(whole, 1, 300), '(?s)^(.*?[.!?] )[A-Z"''“‘]', 1)) + 1, 200) cut from w),
y as (select doc_id, k, cut, length(cut) - length(list_last(string_split(cut, ' '))) - 1 space from x),
z as (select doc_id, string_agg(trim(case when space > 0.7 * 200 then substr(cut, 1, space) else cut end, ' '), '|' order by k) windows from y group by doc_id)
select doc_id, prose, windows from c join z using (doc_id)""")
def prose_and_windows(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prose = x.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count_if(R.is_prose(F.col("line"))).alias("prose"))
    return x.select("doc_id", F.array_join(R.spread_windows(F.col("text"), 3, 200), "|").alias("windows")).join(prose, "doc_id").select("doc_id", "prose", "windows")


CLOSED = f"(p.n is null or (p.ends and length(p.line) < {R.SHORT} * p.width) or case when p.page <> page then p.ends or (p.gap and not captioned) else p.gap and not captioned and not ends_with(p.line, '-') end)"
NEIGHBOURS = """{0} as (select *, last_value(case when line <> '' and not caption then {{'n': n, 'page': page, 'line': line, 'width': width, 'title': {2}, 'numbered': numbered, 'ends': ends,
   'gap': coalesce(next_blank, false)}} end ignore nulls) over (w rows between unbounded preceding and 1 preceding) p,
  coalesce(last_value(case when caption then n end ignore nulls) over (w rows between unbounded preceding and 1 preceding), -1) cap,
  coalesce(first_value(case when line <> '' then numbered end ignore nulls) over (w rows between 1 following and unbounded following), false) then_numbered
  from {1} window w as (partition by doc_id order by n)),
{0}_ as (select * replace (coalesce(cap > p.n, false) as cap) from {0})"""


def reflow_sql() -> str:
    dangling = ", ".join(f"'{w}'" for w in R.DANGLING)
    first = NEIGHBOURS.format("a", "l1", "raw_title")
    second = NEIGHBOURS.format("b", "l2", "title")
    closed = CLOSED.replace("captioned", "cap")
    return f"""with {PRINTED},
wid as (select doc_id, page, (list_sort(list(length(line))))[count(*) // 2 + 1] width from lines where line <> '' group by all),
l1 as (select lines.*, width, {TITLE} raw_title, {has(R.CAPTION)} and length(line) < 90 caption, {has(R.NUMBERED_ITEM)} numbered, {has(R.TERMINAL)} ends,
  lead(line = '') over w and lead(page) over w = page next_blank from lines left join wid using (doc_id, page) window w as (partition by doc_id order by n)),
{first},
l2 as (select doc_id, n, page, line, width, caption, numbered, ends, next_blank, case when ({closed} or p.ends or coalesce(p.title, '') <> '') and not (numbered and raw_title = 'h2' and (then_numbered or coalesce(p.numbered, false))) then raw_title else '' end title from a_),
{second},
st as (select *, case when caption then 'caption'
  when title <> '' and p.title = title and not p.gap and p.page = page then '+' when title <> '' then title
  when {has(R.ITEM)} and not ({has('^[-–—]')} and not {closed} and not coalesce(p.ends, false)) then 'li'
  when p.n is null or p.title <> '' then 'p' when {has(r'^\p{Ll}')} then '+' when {closed} or ({has(R.RUN_IN)} and p.ends) then 'p'
  when {has(r'^\p{Lu}')} and length(p.line) < {R.ITEM_SHORT} * width and lower(list_last(string_split(p.line, ' '))) not in ({dangling}) then '?' else '+' end step from b_ where line <> ''),
g as (select *, count_if(step in ('h1', 'h2', 'li', 'p')) over (partition by doc_id order by n) g from st),
o as (select *, step in ('h1', 'h2', 'li', 'p') or (step = '?' and first_value(step) over (partition by doc_id, g order by n) = 'li' and count_if(step = '?') over (partition by doc_id, g order by n) = 1) opens from g),
bl as (select *, count_if(opens) over (partition by doc_id order by n) block from o),
pieces as (select doc_id, block, case when step = 'caption' then n end cap, n, case when opens then case step when '?' then 'p' else step end end kind,
  case when step = 'caption' then line else case when opens then '' when {has(r'(^| )[^ -]*\p{L}-$', 'p.line')} and {has(r'^\p{Ll}')} then chr(8) when ends_with(p.line, '-') then '' else ' ' end || case when step = 'li' then regexp_replace(line, '{R.ITEM}', '') else line end end s from bl),
whole as (select doc_id, block, cap, coalesce(max(kind), 'caption') kind, replace(string_agg(s, '' order by n), '-' || chr(8), '') text from pieces group by all)
select doc_id, row_number() over (partition by doc_id order by block, cap nulls first) block, kind, text from whole"""


@query("o158_reflow_blocks", reflow_sql())
def reflow_blocks(spark, d):
    return R.blocks(printed(spark, d))


def attr_sql(name: str) -> str:
    found = rf"""regexp_extract(s, '(?i)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 0)"""
    return rf"""regexp_replace(regexp_replace({found}, '(?i)^\s{name}\s*=\s*', ''), '^["'']|["'']$', '', 'g')"""


def names_sql(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


BEFORE = "over (partition by page_id order by pos rows between unbounded preceding and 1 preceding)"
RAW_REGION = """{0} as (select * replace (hidden or (coalesce(last_value(case when name = '{2}' and not hidden then not ending end ignore nulls) """ + BEFORE + """, false) and coalesce(name <> '{2}', true)) as hidden) from {1})"""
PARAGRAPHS = rf"""
k0 as (select page_id, regexp_extract_all(coalesce(html, ''), '{H.TOKEN}') l from pages), k1 as (select page_id, unnest(l) s, generate_subscripts(l, 1) pos from k0),
k2 as (select *, case when regexp_matches(s, '^</?[A-Za-z]') then lower(regexp_extract(s, '^</?([A-Za-z][^\s/>]*)', 1)) end as name, regexp_matches(s, '^</[A-Za-z]') ending from k1),
k3 as (select *, coalesce(last_value(case s when '<!--' then true when '-->' then false end ignore nulls) {BEFORE}, false) hidden from k2),
{RAW_REGION.format('k4', 'k3', 'script')}, {RAW_REGION.format('k5', 'k4', 'style')},
k6 as (select page_id, pos, s, name, name is not null and name not in ({names_sql(H.VOID)}) and not ends_with(s, '/>') counted, ending from k5 where not hidden and s not in ('<!--', '-->') and not regexp_matches(s, '^<[!?].*>$')),
k7 as (select *, sum(case when counted then case when ending then -1 else 1 end else 0 end) over (partition by page_id, name order by pos) total from k6),
k8 as (select *, least(0, min(total) over (partition by page_id, name order by pos)) low, least(0, coalesce(min(total) over (partition by page_id, name order by pos rows between unbounded preceding and 1 preceding), 0)) low_before from k7),
k9 as (select *, case when counted and not ending then total - low when counted and total >= low_before then total - low + 1 end level from k8),
e as (select *, case when counted and not ending then coalesce(lead(pos) over (partition by page_id, name, level order by pos), 1 << 30) end over_at,
  counted and not ending and (name in ({names_sql(H.DROPPED)}) or {attr_sql('role')} = 'navigation' or {" or ".join(f"contains({attr_sql('class')}, '{c}')" for c in H.DROPPED_CLASSES)}) drops from k9),
f as (select *, coalesce(max(case when drops then over_at end) {BEFORE} > pos, false) gone from e),
g as (select *, counted and not ending and not gone and not drops and (name = 'main' or {attr_sql('id')} = 'maincontent') mains from f),
h as (select *, coalesce(max(case when mains then over_at end) {BEFORE} > pos, false) in_main, max(mains) over (partition by page_id) has_main, count_if(coalesce(name in ({names_sql(H.BLOCKS)}), false)) over (partition by page_id order by pos) para from g),
raw as (select page_id, para, string_agg(s, '' order by pos) r from h where name is null and not gone and (in_main or not has_main) group by all),
t as (select page_id, para, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(r, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{{A0}}]+', ' ', 'g')) text from raw)"""


@query("o161_page_paragraphs", f"with {PARAGRAPHS} select page_id, row_number() over (partition by page_id order by para) nth, text from t where length(text) >= 2")
def page_paragraphs(spark, d):
    return H.paragraphs(table(spark, d, "pages"))


MARK_STEM = stem_sql("w")


@query("o146_title_marks", rf"""with t as (select doc_id, left(coalesce(text, ''), 60) title, lower(substr(coalesce(text, ''), 20, 40)) q from documents),
a0 as (select doc_id, unnest(regexp_split_to_array(q, '\s+')) w from t), a1 as (select doc_id, regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') w from a0),
a as (select doc_id, {MARK_STEM} a from a1 where length(w) >= 2),
p0 as (select doc_id, regexp_extract_all(title, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') l from t where title <> ''),
p1 as (select doc_id, unnest(l) s, generate_subscripts(l, 1) i from p0), p2 as (select doc_id, s, i, lower(s) w from p1), p as (select doc_id, s, i, {MARK_STEM} b from p2),
h as (select doc_id, s, i, regexp_matches(s, '^[\p{{L}}\p{{N}}]') and exists (select 1 from a where a.doc_id = p.doc_id and (a = b or (length(a) >= 3 and starts_with(b, a) and length(b) - length(a) <= 3) or (length(b) >= 3 and starts_with(a, b) and length(a) - length(b) <= 3))) hit from p),
j as (select doc_id, s, i, hit or (regexp_matches(s, '^\s+$') and coalesce(lag(hit) over w, false) and coalesce(lead(hit) over w, false)) hit from h window w as (partition by doc_id order by i)),
k as (select *, coalesce(lag(hit) over w <> hit, true) as fresh from j window w as (partition by doc_id order by i)),
m as (select *, count_if(fresh) over (partition by doc_id order by i) run from k),
r as (select doc_id, run, string_agg(s, '' order by i) s, any_value(hit) hit from m group by all)
select doc_id, coalesce(string_agg(case when hit then '[' || s || ']' else s end, '' order by run), '') marked, count_if(hit) marks from t left join r using (doc_id) group by doc_id""")
def title_marks(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(60)).alias("title"), F.substr(F.coalesce("text", F.lit("")), F.lit(20), F.lit(40)).alias("q"))
    x = x.withColumn("parts", T.marks(F.col("title"), F.col("q")))
    shown = F.transform("parts", lambda p: F.when(p["match"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"]))
    return x.select("doc_id", F.array_join(shown, "").alias("marked"), F.size(F.filter("parts", lambda p: p["match"])).cast("long").alias("marks"))


FOUR = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')"


def conditional(spark, d) -> DataFrame:
    """(doc_id, text): four words of each document under nested conditions."""
    first = r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++)?" + r"(?:[^\p{L}\p{N}]++([\p{L}\p{N}]++))?" * 3  # looks no further than the fourth word
    word = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), first, i + 1), F.lit("")), F.lit("-"))
    made = F.concat(F.lit("{{#if even}}"), word(0), F.lit(" {{#unless long}}"), word(1), F.lit("{{else}}"), word(2), F.lit("{{/unless}}{{else}}"), word(3), F.lit("{{/if}} [[call "), F.col("doc_id").cast("string"), F.lit("]]"))
    return table(spark, d, "documents").select("doc_id", "n_chars", made.alias("text"))


SHOWN = "case when even then w0 || ' ' || case when not long then w1 else w2 end else w3 end || ' ' || case when phones then 'call ' || doc_id else 'find help in person (' || doc_id || ')' end"
FOUR_WORDS = f"f as (select doc_id, n_chars, {FOUR} l from documents), g as (select doc_id, n_chars, coalesce(l[1], '-') w0, coalesce(l[2], '-') w1, coalesce(l[3], '-') w2, coalesce(l[4], '-') w3 from f)"


@query("o164_directives", f"with {FOUR_WORDS}, h as (select *, doc_id % 2 = 0 even, n_chars > 500 as long, doc_id % 3 <> 0 phones from g) select doc_id, {SHOWN} as text from h")
def resolved_directives(spark, d):
    x = conditional(spark, d)
    flags = F.create_map(F.lit("even"), F.col("doc_id") % 2 == 0, F.lit("long"), F.col("n_chars") > 500, F.lit("phones"), F.col("doc_id") % 3 != 0)
    return D.resolved(x.select("doc_id", "text"), x.select("doc_id", F.explode(flags).alias("flag", "value")))


@query("o165_branches", f"with {FOUR_WORDS}, b(v) as (values (true), (false)), h as (select g.*, x.v as even, y.v as long, z.v as phones from g, b x, b y, b z) select doc_id, 'even=' || even || ',long=' || long || ',phones=' || phones flags, {SHOWN} as text from h")
def directive_branches(spark, d):
    x = D.branches(conditional(spark, d).select("doc_id", "text"))
    return x.select("doc_id", F.array_join(F.transform(F.map_entries("flags"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("flags"), "text")


@query("o55_bm25_from_index", ORACLES["o55_bm25_topk"])
def bm25_from_index(spark, d):
    """The same ranking, from an index that is written first."""
    path = new_path(spark, "index")
    X.build(table(spark, d, "documents"), path)
    return X.Index(spark, path).top(batch(spark, d), 10).select("qid", "doc_id", "score", "rank")


@query("o101_resumable_build", f"with {UNIT} select vec_id, round(v[1], 5) as first, len(v) dims from u")
def resumable_build(spark, d):
    """Unit vectors, built from half of the rows first, then brought up to date and published."""
    path, root = new_path(spark, "build"), new_path(spark, "collection")
    rows, identity = vectors(spark, d).select("vec_id", "embedding"), {"what": "unit vectors"}
    step = lambda part: part.select("vec_id", V.unit(F.col("embedding")).alias("v"))
    U.build(rows.filter("vec_id % 2 = 0"), "vec_id", step, path, identity, ranges=8, wave=4)
    U.build(rows, "vec_id", step, path, identity, ranges=8, wave=4)
    U.publish(rows, "vec_id", path, root, "1", ranges=8)
    return files.current(spark, root).select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.size("v").cast("long").alias("dims"))


@query("o16_generations", "select doc_id, source, length(text) n from documents where doc_id % 2 = 1")
def generations(spark, d):
    """Two generations, of which readers see the second."""
    root, docs = new_path(spark, "generations"), table(spark, d, "documents").select("doc_id", "source", F.char_length("text").cast("long").alias("n"))
    for generation, rest in (("even", 0), ("odd", 1)):
        files.publish(docs.filter(F.col("doc_id") % 2 == rest), root, generation)
    return files.current(spark, root)


@query("o197_streaks_stream", ORACLES["o197_streaks"])
def streaks_stream(spark, d):
    """The detector over a stream of files in order of time, stopped after two of three parts and started again from its checkpoint."""
    events = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).select("user_id", "event_id", "value", "at")
    folder, out, state = new_path(spark, "events"), new_path(spark, "streaks"), new_path(spark, "streaks-state")
    low, high = events.select(F.percentile_approx(F.unix_micros("at"), [0.33, 0.66])).first()[0]
    at = F.unix_micros("at")
    for k, part in enumerate((at < low, (at >= low) & (at < high), at >= high)):
        events.filter(part).write.mode("append").parquet(folder)
        if k:
            jobs.drained_once(jobs.streaks(spark.readStream.schema(events.schema).parquet(folder), 20.0, 3), out, state)
    return spark.read.schema("user_id long, event_id long").parquet(out)


def grid_sql(grid: str, lat: str, lon: str) -> str:
    """SELECT lists, one after the other, from degrees on WGS 84 (lat, lon) to east and north; DuckDB lets a column use those before it."""
    g, (a, b) = G.GRIDS[grid], G.WGS84
    dx, dy, dz, rx, ry, rz, s = g["shift"]
    e2, f2 = f"({a * a - b * b} / {a * a})", f"({g['a'] ** 2 - g['b'] ** 2} / {g['a'] ** 2})"
    cols = [f"radians({lat}) la", f"radians({lon}) lo", f"{a} / sqrt(1 - {e2} * sin(la) ** 2) nu", f"(nu * cos(la) * cos(lo) - {dx}) / {1 + s / 1e6} x0", f"(nu * cos(la) * sin(lo) - {dy}) / {1 + s / 1e6} y0", f"(nu * (1 - {e2}) * sin(la) - {dz}) / {1 + s / 1e6} z0"]
    turn = {n: f"radians({v} / 3600.0)" for n, v in (("rx", rx), ("ry", ry), ("rz", rz))}
    cols += [f"x0 + {turn['rz']} * y0 - {turn['ry']} * z0 x", f"y0 - {turn['rz']} * x0 + {turn['rx']} * z0 y", f"z0 + {turn['ry']} * x0 - {turn['rx']} * y0 z", "sqrt(x * x + y * y) pp", f"atan2(z, pp * (1 - {f2})) b0"]
    cols += [f"atan2(z + {f2} * {g['a']} / sqrt(1 - {f2} * sin(b{i}) ** 2) * sin(b{i}), pp) b{i + 1}" for i in range(6)]
    n, at = (g["a"] - g["b"]) / (g["a"] + g["b"]), f"radians({g['lat']})"
    cols += [f"{g['a'] * g['scale']} / sqrt(1 - {f2} * sin(b6) ** 2) v", f"{g['a'] * g['scale']} * (1 - {f2}) / (1 - {f2} * sin(b6) ** 2) ** 1.5 r", "v / r - 1 h2", "tan(b6) ** 2 t2", f"atan2(y, x) - radians({g['lon']}) dl", f"b6 - {at} dm", f"b6 + {at} sm"]
    cols += [f"{g['b'] * g['scale']} * ({1 + n + 1.25 * n**2 + 1.25 * n**3} * dm - {3 * n + 3 * n**2 + 21 / 8 * n**3} * sin(dm) * cos(sm) + {15 / 8 * (n**2 + n**3)} * sin(2 * dm) * cos(2 * sm) - {35 / 24 * n**3} * sin(3 * dm) * cos(3 * sm)) m"]
    cols += [f"m + {g['north']} + v / 2 * sin(b6) * cos(b6) * dl ** 2 + v / 24 * sin(b6) * cos(b6) ** 3 * (5 - t2 + 9 * h2) * dl ** 4 + v / 720 * sin(b6) * cos(b6) ** 5 * (61 - 58 * t2 + t2 * t2) * dl ** 6 north"]
    cols += [f"{g['east']} + v * cos(b6) * dl + v / 6 * cos(b6) ** 3 * (v / r - t2) * dl ** 3 + v / 120 * cos(b6) ** 5 * (5 - 18 * t2 + t2 * t2 + 14 * h2 - 58 * t2 * h2) * dl ** 5 east"]
    return ", ".join(cols)


PLACED = "select c_custkey, 49.9 + (c_custkey * 37 % 1000) / 100.0 lat, -7.5 + (c_custkey * 91 % 1000) / 100.0 lon from customer"


@query("o178_projection", " union all ".join(f"(with c as ({PLACED}), x as (select c_custkey, lat, lon, {grid_sql(g, 'lat', 'lon')} from c) select '{g}' grid, c_custkey, round(east, 2) east, round(north, 2) north, round(lat, 5) lat, round(lon, 5) lon from x)" for g in G.GRIDS))
def projection(spark, d):
    """Points of the islands on both grids, and back again."""
    c = table(spark, d, "customer").select("c_custkey", (49.9 + F.col("c_custkey") * 37 % 1000 / 100.0).alias("lat0"), (-7.5 + F.col("c_custkey") * 91 % 1000 / 100.0).alias("lon0"))
    out = None
    for grid in G.GRIDS:
        x = G.from_grid(G.to_grid(c, "lat0", "lon0", grid), "east", "north", grid)
        x = x.select(F.lit(grid).alias("grid"), "c_custkey", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
        out = x if out is None else out.unionByName(x)
    return out


@query("o163_tasks", r"""with l as (select doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) l from documents), r as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 i from l),
t as (select doc_id, i, trim(line) task from r where i % 3 < 2 and trim(line) <> '')
select doc_id, row_number() over (partition by doc_id order by i) nth, t.i % 3 = 1 done, task from t""")
def tasks(spark, d):
    """Lines of documents as items of task lists, open and done ones in turn, every third line as it is."""
    split = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n")
    made = F.transform(split, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("- [ ] "), x)).when(i % 3 == 1, F.concat(F.lit("* [x] "), x)).otherwise(x))
    return P.tasks(table(spark, d, "documents").select("doc_id", F.array_join(made, "\n").alias("md")), "doc_id", "md")
