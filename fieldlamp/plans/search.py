"""Queries of tokenising, retrieval and ranking over documents, with benchmark passages as the batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import injury_words as W, text as T
from ..operators import intent as I, ranking as R, retrieval as S
from ..session import table, written
from .registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: DuckDB twins of the text functions.
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def tok(c):
    return TOK.format(c)


def stem_sql(w):
    cases = []
    for s in T.SUFFIXES:
        cut = f"left({w}, length({w}) - {len(s)})" + (" || 'y'" if s in ("ies", "ied") else "")
        cases.append(f"when ends_with({w}, '{s}') and length({w}) - {len(s)} >= 3 then {cut}")
    return f"case {' '.join(cases)} else {w} end"


def batch(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """A query an item: its n first content terms of five letters or more."""
    terms = F.slice(F.filter(T.content_terms(F.col("text")), lambda x: F.char_length(x) >= 5), 1, n)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), terms.alias("terms")).filter("size(terms) > 0")


BATCH = f"""
bt as (select item_id, {tok('text')} t from benchmark),
bd as (select item_id, {DISTINCT.format('t')} t from bt),
bc as (select item_id, t, list_filter(t, lambda x: x not in ({STOP})) c from bd),
batch as (select item_id qid, (list_filter(case when len(c) > 0 then c else t end, lambda x: length(x) >= 5))[1:4] terms from bc),
q as (select qid, len(terms) n_terms, unnest(terms) term from batch where len(terms) > 0)"""
POSTS = f"""
dt as (select doc_id, {tok('text')} t from documents),
occ as (select doc_id, len(t) dl, unnest(t) term from dt),
posts as (select doc_id, term, dl, count(*) tf from occ group by all)"""
BM25 = """
stat as (select count(*) n, avg(dl) a from (select doc_id, len(t) dl from dt)),
hit as (select * from posts where term in (select term from q)),
dfs as (select term, count(*) df from hit group by term),
scored as (
  select qid, h.doc_id, round(sum(ln(1 + (stat.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / stat.a))), 6) score, count(*) found, any_value(n_terms) n_terms
  from hit h join dfs using (term) join q using (term), stat group by qid, h.doc_id)"""


def terms_of(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode("terms").alias("term"))


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, postings of their terms, BM25 scores). One pass over the documents."""
    q = batch(spark, d)
    posts = written(S.wanted_postings(table(spark, d, "documents"), terms_of(q)), "postings")
    return q, posts, S.bm25(posts, q, *S.lengths(posts))


@query("o20_tokens_distinct", f"with a as (select doc_id, {tok('text')} t from documents) select doc_id, array_to_string({DISTINCT.format('t')}, ' ') as tokens from a")
def tokens_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("o21_content_terms", f"with a as (select item_id, {tok('text')} t from benchmark), b as (select item_id, {DISTINCT.format('t')} t from a), c as (select *, list_filter(t, lambda x: x not in ({STOP})) c from b) select item_id, array_to_string(case when len(c) > 0 then c else t end, ' ') terms from c")
def content_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms"))


STOP_ALL = ", ".join(f"'{w}'" for w in sorted(W.STOPWORDS))


@query("o21_content_terms_all", f"with a as (select item_id, {tok('text')} t from benchmark), b as (select item_id, {DISTINCT.format('t')} t from a), c as (select *, list_filter(t, lambda x: x not in ({STOP_ALL})) c from b) select item_id, array_to_string(case when len(c) > 0 then c else t end, ' ') terms from c")
def content_terms_all(spark, d):
    """With the reference's whole list of stopwords."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.content_terms(F.col("text"), sorted(W.STOPWORDS)), " ").alias("terms"))


@query("o23_boolean_and", f"with {BATCH}, {POSTS} select qid, doc_id from posts join q using (term) group by qid, doc_id, n_terms having count(distinct term) = n_terms")
def boolean_and(spark, d):
    q = batch(spark, d)
    return S.boolean(S.wanted_postings(table(spark, d, "documents"), terms_of(q)), q, "and")


@query("o23_boolean_or", f"with {BATCH}, {POSTS} select distinct qid, doc_id from posts join q using (term)")
def boolean_or(spark, d):
    q = batch(spark, d)
    return S.boolean(S.wanted_postings(table(spark, d, "documents"), terms_of(q)), q, "or")


@query("o24_prefix_match", f"with {BATCH}, {POSTS}, p as (select qid, left(min(term), 4) pre from q group by qid) select qid, doc_id, cast(sum(tf) as bigint) n from posts join p on starts_with(term, pre) group by qid, doc_id")
def prefix_match(spark, d):
    p = batch(spark, d).select("qid", F.left(F.array_min("terms"), F.lit(4)).alias("prefix"))
    return S.prefix(S.prefix_postings(table(spark, d, "documents"), p), p)


@query("o25_phrase_match", f"with p as (select item_id qid, {tok('text')} t from benchmark), pairs as (select qid, t[1] a, t[2] b from p where len(t) > 1), dt as (select doc_id, {tok('text')} t from documents), pos as (select doc_id, unnest(t) term, generate_subscripts(t, 1) pos from dt) select qid, x.doc_id, count(*) n from pos x join pairs on x.term = a join pos y on y.doc_id = x.doc_id and y.pos = x.pos + 1 and y.term = b group by all")
def phrase_match(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.all_tokens(F.col("text")).alias("t")).filter("size(t) > 1")
    return S.phrases_in(table(spark, d, "documents"), t.select("qid", F.posexplode(F.slice("t", 1, 2)).alias("ord", "term")))


@query("o25_phrase_match_all", f"with p as (select item_id qid, {tok('text')} p from benchmark), dt as (select doc_id, {tok('text')} t from documents), pos as (select doc_id, t, unnest(generate_series(1, len(t))) s from dt) select qid, doc_id, count(*) n from pos join p on t[s] = p[1] where t[s:s + len(p) - 1] = p group by all")
def phrase_match_all(spark, d):
    """Whole passages."""
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(T.all_tokens(F.col("text"))).alias("ord", "term"))
    return S.phrases_in(table(spark, d, "documents"), t)


@query("o55_bm25_topk", f"with {BATCH}, {POSTS}, {BM25} select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from scored qualify rank <= 10")
def bm25_topk(spark, d):
    return S.top(scored(spark, d)[2], 10)


WEIGHTED = f"""
dt as (select doc_id, {tok('text')} t from documents),
occ as (select doc_id, len(t) dl, unnest(t) term, generate_subscripts(t, 1) pos from dt),
posts as (select doc_id, term, dl, sum(case when pos <= 8 then 5 else 1 end) tf from occ group by doc_id, term, dl)"""


@query("o55_bm25_weighted_fields", f"with {BATCH}, {WEIGHTED}, {BM25} select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from scored qualify rank <= 10")
def bm25_weighted(spark, d):
    q = batch(spark, d)
    posts = written(S.wanted_postings(table(spark, d, "documents"), terms_of(q), title_words=8, title_weight=5), "postings")
    return S.top(S.bm25(posts, q, *S.lengths(posts)), 10)


@query("o56_and_then_or", f"""with {BATCH}, {POSTS}, {BM25},
n as (select qid, count(*) filter (found = n_terms) n from scored group by qid),
u as (select qid, doc_id, score, case when found = n_terms then 0 else 1 end tier from scored join n using (qid) where found = n_terms or n < 10)
select qid, doc_id, tier, row_number() over (partition by qid order by tier, score desc, doc_id) rank from u qualify rank <= 20""")
def and_then_or(spark, d):
    q, posts, s = scored(spark, d)
    s = written(s, "scores")
    strict = s.join(S.boolean(posts, q, "and"), ["qid", "doc_id"], "left_semi")
    return S.and_then_or(strict, s, 10, 20).select("qid", "doc_id", "tier", "rank")


@query("o57_split_budgets", f"with {BATCH}, {POSTS}, {BM25}, x as (select s.qid, s.doc_id, score, source = 'src0' as own from scored s join documents using (doc_id)) select qid, doc_id, own, row_number() over (partition by qid, own order by score desc, doc_id) rank from x qualify rank <= case when own then 15 else 3 end")
def split_budgets(spark, d):
    s = scored(spark, d)[2].join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    s = s.withColumn("own", F.col("source") == "src0")
    w = Window.partitionBy("qid", "own").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= F.when(F.col("own"), 15).otherwise(3)).select("qid", "doc_id", "own", "rank")


@query("o58_light_stem", f"with a as (select distinct unnest({tok('text')}) w from documents) select w, {stem_sql('w')} as stem from a")
def light_stem(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.all_tokens(F.col("text"))).alias("w")).distinct()
    return w.select("w", T.stem(F.col("w")).alias("stem"))


SHARE = f"""
ds as (select doc_id, list_transform({tok('text')}, lambda w: {stem_sql('w')}) st from documents),
qs as (select qid, n_terms, {stem_sql('term')} s from q),
top5 as (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from scored qualify rank <= 10)"""


@query("o59_term_share", f"""with {BATCH}, {POSTS}, {BM25}, {SHARE}
select t.qid, t.doc_id, round(sum(case when list_contains(st, s) or (length(s) >= 4 and len(list_filter(st, lambda w: starts_with(w, s))) > 0) then 1.0 else 0.0 end) / any_value(n_terms), 6) as share
from top5 t join ds using (doc_id) join qs on qs.qid = t.qid group by t.qid, t.doc_id""")
def term_share(spark, d):
    q, _, s = scored(spark, d)
    hits = S.top(s, 10).join(q, "qid").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    groups = F.transform("terms", lambda t: F.array(t))
    return hits.select("qid", "doc_id", F.round(T.term_share(groups, F.col("text")), 6).alias("share"))


RANKED = "ranked as (select s.qid, s.doc_id, score bm25, row_number() over (partition by s.qid order by score desc, s.doc_id) rank from scored s qualify rank <= 40)"
RELEVANT = f"""
{RANKED},
titled as (select r.*, source, lang, (dt.t)[1:8] title, dt.t body from ranked r join documents using (doc_id) join dt using (doc_id)),
ev as (
  select t.qid, t.doc_id, any_value(rank) rank, any_value(source) source, any_value(n_terms) ideas,
    sum(case when list_contains(title, term) then 1.0 else 0.0 end) / any_value(n_terms) it, sum(case when list_contains(body, term) then 1.0 else 0.0 end) / any_value(n_terms) ib
  from titled t join q using (qid) group by t.qid, t.doc_id),
rel as (
  select *, round(1.0 / (5 + rank) * (1 + 1.2 * it + 0.5 * ib) * case when it = 0 and ib = 0 then 0.45 when ib = 0 and it <= 0.5 and ideas >= 2 then 0.6 else 1.0 end, 6) score from ev)"""


def relevant(spark, d, limit: int | None = 40) -> DataFrame:
    """(qid, doc_id, source, rank, score) of the ``limit`` best by BM25 of each query, of every scored document without
    one, rescored by evidence."""
    return evidence(spark, d, limit).select("qid", "doc_id", "source", "rank", "score")


def evidence(spark, d, limit: int | None = 40) -> DataFrame:
    """``relevant`` with the shares of its query's terms in title and body. A posting knows its first place, so evidence comes
    from the postings that BM25 reads, and no text meets a query."""
    q = batch(spark, d)
    posts = written(S.wanted_postings(table(spark, d, "documents"), terms_of(q), carry=("source",)), "postings")
    share = lambda n: n / F.first("n_terms")
    also = (F.first("n_terms").alias("ideas"), share(F.count_if(F.col("first") <= 8)).alias("title"), share(F.count(F.lit(1))).alias("body"))
    hits = S.top(S.bm25(posts, q, *S.lengths(posts), carry=("source",), also=also), limit)
    score = R.rank_score(F.lit(1.0), F.col("rank")) * R.relevance(F.col("title"), F.col("body"), F.lit(False), F.col("ideas"))
    return hits.select("qid", "doc_id", "source", "rank", F.round(score, 6).alias("score"), "title", "body")


BASE = f"with {BATCH}, {POSTS}, {BM25}, {RELEVANT}"
BASE_ALL = BASE.replace(RANKED, RANKED.replace(" qualify rank <= 40", ""))


def ranking(name: str, sql: str):
    """NAME works on the 40 best by BM25, as its SQL does; NAME_all on every scored document, so that only limits which
    are the query's own feature cut."""

    def add(f):
        query(f"{name}_all", sql.replace(BASE, BASE_ALL))(lambda spark, d: f(spark, d, None))
        return query(name, sql)(f)

    return add


@ranking("o63_relevance_multiplier", f"{BASE} select qid, doc_id, source, rank, score from rel")
def relevance_multiplier(spark, d, limit: int | None = 40):
    return relevant(spark, d, limit)


@ranking("o69_dedupe_best", f"{BASE} select qid, doc_id, source, score from rel qualify row_number() over (partition by qid, source order by score desc, doc_id) = 1")
def dedupe_best(spark, d, limit: int | None = 40):
    return R.dedupe(relevant(spark, d, limit), ["qid", "source"]).drop("rank")


@ranking("o70_dedupe_titles", f"""{BASE}, k as (select rel.*, array_to_string(title, ' ') title from rel join titled using (qid, doc_id))
select qid, doc_id, source, score from k qualify row_number() over (partition by qid, source, title order by score desc, doc_id) = 1""")
def dedupe_titles(spark, d, limit: int | None = 40):
    titles = table(spark, d, "documents").select("doc_id", F.array_join(F.slice(T.all_tokens(F.col("text")), 1, 8), " ").alias("title"))
    return R.dedupe(relevant(spark, d, limit).join(titles, "doc_id"), ["qid", "source", "title"]).select("qid", "doc_id", "source", "score")


DIVERSE = "div as (select qid, doc_id, source, round(score * case when nth > 3 then power(0.85, nth - 3) else 1 end, 6) score from (select *, row_number() over (partition by qid, source order by score desc, doc_id) nth from rel))"


@ranking("o71_diversify_decay", f"{BASE}, {DIVERSE} select qid, doc_id, source, score from div")
def diversify_decay(spark, d, limit: int | None = 40):
    return R.diversify(relevant(spark, d, limit), ["qid"]).drop("rank")


@ranking("o72_facet_counts", f"{BASE} select qid, source, count(*) n from rel group by all")
def facet_counts(spark, d, limit: int | None = 40):
    return R.facets(relevant(spark, d, limit), ["qid"])


@ranking("o74_rescue_cap", f"""{BASE}, r as (select *, source = 'src3' k, row_number() over (partition by qid order by score desc, doc_id) place, row_number() over (partition by qid, source = 'src3' order by score desc, doc_id) own from rel)
select qid, doc_id, place from r where place <= 10 or (k and own <= 2)""")
def rescue_cap(spark, d, limit: int | None = 40):
    rows = relevant(spark, d, limit).drop("rank")
    return R.rescue(rows, ["qid"], F.col("source") == "src3", c=R.RankConfig(limit=10, rescued=2)).select("qid", "doc_id", F.col("rank").alias("place"))


@ranking("o73_source_filter_limit", f"{BASE}, {DIVERSE} select qid, doc_id, row_number() over (partition by qid order by score desc, doc_id) place from div where source in ('src0', 'src1', 'src2') qualify place <= 5")
def source_filter(spark, d, limit: int | None = 40):
    rows = R.diversify(relevant(spark, d, limit), ["qid"]).drop("rank").filter(F.col("source").isin("src0", "src1", "src2"))
    return S.top(rows, 5).select("qid", "doc_id", F.col("rank").alias("place"))


@ranking("o75_zero_evidence_drop", f"{BASE} select qid, doc_id from rel where it > 0")
def zero_evidence(spark, d, limit: int | None = 40):
    return evidence(spark, d, limit).filter("title > 0").select("qid", "doc_id")


SUGGEST = """with p as (select distinct left(lower(p_name), 3) pre from part where p_partkey % 50 = 0), c as (select pre, p_partkey as id, lower(p_name) title, 1 kind from p join part on starts_with(lower(p_name), pre) union all select pre, s_suppkey, lower(s_name), 2 from p join supplier on starts_with(lower(s_name), pre)),
u as (select *, row_number() over (partition by pre, title order by kind, id) nth from c) select pre, title, row_number() over (partition by pre order by kind, length(title), title) place from u where nth = 1 qualify place <= 10"""


@query("o76_suggest_prefix", SUGGEST)
def suggest(spark, d, some: str = "p_partkey % 50 = 0"):
    part, sup = table(spark, d, "part"), table(spark, d, "supplier")
    p = part.filter(some).select(F.left(F.lower("p_name"), F.lit(3)).alias("pre")).distinct()
    names = part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("title"), F.lit(1).alias("kind")).unionByName(sup.select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("title"), F.lit(2).alias("kind")))
    c = names.withColumn("pre", F.left("title", F.lit(3))).join(p, "pre")
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("pre", "title").orderBy("kind", "id"))).filter("nth = 1")
    w = Window.partitionBy("pre").orderBy("kind", F.char_length("title"), "title")
    return c.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 10").select("pre", "title", "place")


@query("o76_suggest_prefix_all", SUGGEST.replace(" where p_partkey % 50 = 0", ""))
def suggest_all(spark, d):
    """For the prefixes of all parts."""
    return suggest(spark, d, "true")


@ranking("o78_interleave", f"{BASE}, l as (select qid, doc_id, source, row_number() over (partition by qid, source order by score desc, doc_id) r from rel) select qid, doc_id, row_number() over (partition by qid order by r, source) place from l")
def interleave(spark, d, limit: int | None = 40):
    w = Window.partitionBy("qid", "source").orderBy(F.desc("score"), "doc_id")
    rows = relevant(spark, d, limit).drop("rank").withColumn("rank", F.row_number().over(w))
    return R.interleave(rows, ["qid"], "source").select("qid", "doc_id", "place")


@query("o22_expand_groups", """with recursive v(qid, t) as (values (1, ['power', 'cut', 'water']), (2, ['water', 'power', 'cut', 'cut']), (3, ['heart', 'power'])),
e(qid, i, ord, g) as (
  select qid, 1, 0, cast(null as varchar) from v
  union all
  select e.qid, e.i + case when v.t[e.i] = 'power' and v.t[e.i + 1] = 'cut' then 2 else 1 end, e.ord + 1,
    case when v.t[e.i] = 'power' and v.t[e.i + 1] = 'cut' then 'power cut|blackout|outage' when v.t[e.i] = 'water' then 'water|drinking' else v.t[e.i] end
  from e join v using (qid) where e.i <= len(v.t))
select qid, cast(ord as bigint) ord, g from e where ord > 0""")
def expand_groups(spark, d):
    q = spark.sql("select * from values (1, array('power', 'cut', 'water')), (2, array('water', 'power', 'cut', 'cut')), (3, array('heart', 'power')) v(qid, terms)")
    phrases = {("power", "cut"): ["power cut", "blackout", "outage"]}
    return T.expand(q, phrases, {"water": ["drinking"]}).select("qid", F.posexplode("groups").alias("i", "x")).select("qid", (F.col("i") + 1).cast("long").alias("ord"), F.array_join("x", "|").alias("g"))


@query("o64_norm_title", r"""select n_nationkey, trim(regexp_replace(lower(regexp_replace(n_name || '  - NHS ', '(?i)\s*[-–—]\s*NHS\s*$', '')), '\s+', ' ', 'g')) title from nation""")
def norm_title(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.norm_title(F.concat("n_name", F.lit("  - NHS "))).alias("title"))


@query("o68_place_exact", "with q as (select c_custkey qid, lower(n_name) place from customer join nation on c_nationkey = n_nationkey where c_custkey % 20 = 0), p as (select n_nationkey id, lower(n_name) nm, 1 rank from nation union all select r_regionkey, lower(r_name), 2 from region) select qid, id, rank from q join p on place = nm qualify row_number() over (partition by qid order by rank, id) = 1")
def place_exact(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    q = table(spark, d, "customer").filter("c_custkey % 20 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("qid"), F.lower("n_name").alias("nm"))
    p = nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("nm"), F.lit(1).alias("rank")).unionByName(region.select(F.col("r_regionkey").alias("id"), F.lower("r_name").alias("nm"), F.lit(2).alias("rank")))
    return q.join(p, "nm").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).filter("nth = 1").select("qid", "id", "rank")


@query("o66_snippet_window", f"""with dt as (select doc_id, {tok('text')} t from documents), w as (select doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 13))) s from dt where len(t) > 0),
h as (select doc_id, s, len(list_filter(t[s:s + 13], lambda x: x in ('of', 'and', 'the'))) hits, t from w)
select doc_id, array_to_string(list_transform(t[s:s + 13], lambda x: case when x in ('of', 'and', 'the') then '<b>' || x || '</b>' else x end), ' ') snippet from h qualify row_number() over (partition by doc_id order by hits desc, s) = 1""")
def snippet_window(spark, d):
    """The 14 tokens with most hits, the first of equals; all on a document's own array."""
    x = table(spark, d, "documents").select("doc_id", T.all_tokens(F.col("text")).alias("t")).filter("size(t) > 0")
    return x.select("doc_id", F.array_join(T.best_window(F.col("t"), ["of", "and", "the"], 14), " ").alias("snippet"))


@query("o67_opening_snippet", r"""with a as (select doc_id, trim(regexp_replace(regexp_replace(text, '\[\[[^\]]*\]\]|\{\{[^}]*\}\}', ' ', 'g'), '\s+', ' ', 'g')) t from documents) select doc_id, case when length(t) <= 220 then t else regexp_replace(left(t, 220), ' [^ ]*$', '') || '…' end snippet from a""")
def opening_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet_of(F.col("text")).alias("snippet"))


@query("o28_classify", "select p_partkey, case when p_size > 40 then 'extended' when p_brand like '%1' then 'official' when p_type like 'S%' then 'medical' else 'reference' end cls from part")
def classify(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "extended").when(F.col("p_brand").like("%1"), "official").when(F.col("p_type").like("S%"), "medical").otherwise("reference").alias("cls"))


@query("o26_postcode_predicate", r"""select c_custkey, regexp_matches('AB' || cast(c_custkey % 30 as varchar) || ' 1AA', '(?i)^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$') is_code from customer""")
def postcode(spark, d):
    code = F.concat(F.lit("AB"), (F.col("c_custkey") % 30).cast("string"), F.lit(" 1AA"))
    return table(spark, d, "customer").select("c_custkey", code.rlike(r"(?i)^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$").alias("is_code"))


def texts_of(spark, d) -> DataFrame:
    """(kind, id, text) of every passage and document."""
    items = table(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text")
    return items.unionByName(table(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text"))


def rows_sql(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: Word classes of the tests, as DuckDB's twin knows them: one table of (class, word).
CLASSES = {
    "wound": W.WOUND, "maybe": W.MAYBE_WOUND, "blood": W.BLOOD, "haemorrhage": W.HAEMORRHAGE, "heavy": W.HEAVY_BLEEDING, "negation": W.NEGATION, "illness": W.BLEEDING_OF_ILLNESS,
    "scald": W.SCALD, "burn": W.BURN, "heat": W.HEAT_SOURCE, "hot": W.HOT, "liquid": W.LIQUID, "spill": W.SPILL, "fracture": W.FRACTURE, "breaking": W.BREAKING, "sprain": W.SPRAIN,
    "strain": W.STRAIN, "joint": W.JOINT, "knock": W.KNOCK, "eye": W.EYE_TROUBLE, "bite": W.BITE, "animal": W.ANIMAL, "venom": W.VENOMOUS, "care": W.CARE, "qualifier": W.QUALIFIER,
    "alone": W.INJURY_ALONE, "emergency": W.OTHER_EMERGENCY, "book": W.BOOK, "lookup": W.LOOKUP, "self": W.REFLEXIVE, "nosebleed": ("nosebleed", "nosebleeds"), "concussion": ("concussion", "concussed"),
    "spine": I.SPINE, "injured": ("injury", "injured"), "back": ("back",), "stop": ("stop", "stopping"), "bleeding": ("bleeding", "bleed"), "bleeds": ("bleeding", "bleed", "bleeds", "bled"),
    "burning": ("burning",), "bit": ("bit",), "bitten": ("bitten", "stung"), "gash": ("cut", "cuts", "gash", "gashes"),
}
HARMLESS = "|".join(p.replace(" ", "  ") for p in sorted(W.HARMLESS_PHRASES, key=lambda p: (-len(p), p)))
FREE = r"""regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '[''’]', '', 'g'), '[\p{{L}}\p{{N}}]+')"""
WHOLE = f"list_filter(string_split(regexp_replace(' ' || array_to_string(r, '  ') || ' ', ' (?:{HARMLESS}) ', ' ', 'g'), ' '), lambda x: x <> '')"
LIMBS = ", ".join(f"'{p}'" for p in W.BODY_PARTS if p not in I.NO_LIMB)


def intent_sql(texts: str) -> str:
    """CTEs that end in intents (kind, id, conditions, locations, modifiers, confidence, purpose) of texts (kind, id, text)."""
    h = lambda *c: "(" + " or ".join(f"list_contains(c, '{x}')" for x in c) + ")"
    at = lambda *p: "(" + " or ".join(f"list_contains(p, '{x}')" for x in p) + ")"
    return f"""
v(cls, word) as (values {rows_sql((c, w) for c, words in CLASSES.items() for w in words)}),
body(part, word) as (values {rows_sql((p, w) for w, p in I.PART_OF.items())}),
txt as ({texts}),
r0 as (select kind, id, {FREE.format('text')} r from txt),
r1 as (select kind, id, r, {WHOLE} w from r0),
tok as (select kind, id, unnest(w) word, generate_subscripts(w, 1) pos from r1),
cl as (select kind, id, list(distinct cls) c from tok join v using (word) group by all),
pa as (select kind, id, list(part order by pos) p from (select kind, id, part, min(pos) pos from tok join body using (word) group by all) group by all),
mo as (select kind, id, list(word order by pos) m from (select kind, id, word, min(pos) pos from tok where word in (select word from v where cls = 'qualifier') group by all) group by all),
s0 as (select kind, id, r, coalesce(c, []) c, coalesce(p, []) p, coalesce(m, []) m, array_to_string(w, ' ') says,
  len(list_filter(r, lambda x: x not in ({STOP_ALL}))) = 1 single
  from r1 left join cl using (kind, id) left join pa using (kind, id) left join mo using (kind, id)),
s1 as (select *, {h('self')} or len(list_filter(p, lambda x: x not in ('bone', 'muscle', 'ligament'))) > 0 bodily,
  {h('nosebleed')} or contains(says, 'nose bleed') or ({at('nose')} and {h('blood', 'haemorrhage')}) nosebleed,
  {at('eye')} and {h('eye', 'wound', 'maybe', 'burn')} eye_injury,
  {h('concussion')} or contains(says, 'knocked out') or ({at('head')} and {h('knock')}) head_injury,
  {h('spine')} or ({h('breaking', 'injured')} and ({at('neck')} or {h('back')})) spinal_injury,
  {h('fracture')} or contains(says, 'wrong way') or ({at('bone')} and contains(says, 'sticking out')) or ({h('breaking')} and (list_has_any(p, [{LIMBS}]) or {at('bone')})) fracture,
  not {h('venom')} and (({h('bit')} and {h('animal')}) or ({h('bite')} and ({h('animal', 'bitten', 'self')} or len(list_filter(p, lambda x: x not in ('bone', 'muscle', 'ligament'))) > 0))) bite_sting,
  {h('blood')} and not {h('illness')} or {h('breaking', 'bite', 'maybe')} or ({h('bit')} and {h('animal')}) or ({h('burn')} and not {h('scald')}) unclear from s0),
s2 as (select *, not nosebleed and not {h('illness')} and ({h('haemorrhage')} or ({h('blood')} and ({h('heavy')} or ({h('stop')} and {h('negation')}))) or ({h('bleeding')} and single) or ({h('bleeds')} and bodily)) bleeding,
  {h('scald')} or ({h('burn', 'burning')} and {h('heat')}) or ({h('burn')} and ({h('care')} or single or (bodily and not {at('chest')}))) or ({h('hot')} and {h('liquid')} and ({h('spill')} or bodily)) burn,
  {h('sprain')} or (not fracture and {h('strain')} and ({h('joint')} or list_has_any(p, [{", ".join(f"'{x}'" for x in W.JOINT)}]))) sprain from s1),
s3 as (select *, ({h('wound')} or ({h('maybe')} and (bodily or {h('care')} or ({h('qualifier')} and {h('gash')}) or ({h('alone')} and single))) or (bleeding and bodily and {h('blood')})) and not (eye_injury and not {h('wound')}) open_wound from s2),
s4 as (select *, list_filter([{", ".join(f"case when {c} then '{c}' end" for c in W.CONDITIONS)}], lambda x: x is not null) conditions from s3),
intents as (select kind, id, conditions, p locations, m modifiers,
  case when len(conditions) > 0 and not {h('emergency')} and not contains(says, 'not breathing') and not contains(says, 'cant breathe') then 'confirmed' when len(conditions) > 0 or unclear then 'possible' else 'none' end confidence,
  case when {h('book')} then 'book' when {h('lookup')} or array_to_string(r[1:2], ' ') in ('who is', 'who was') then 'lookup' else 'care' end purpose from s4)"""


TEXTS_SQL = "select 'benchmark' kind, item_id id, text from benchmark union all select 'documents', doc_id, text from documents"
SURE = "confidence = 'confirmed' and purpose = 'care' and len(conditions) > 0"
ALSO = [(t, [t, *(x for x in also if x != t)]) for t, also in W.SYNONYMS.items()] + [(p, list(words)) for p, words in W.PHRASES.items()]
ALL_TERMS = f"""t0 as (select kind, id, {tok('text')} t from txt), t1 as (select kind, id, {DISTINCT.format('t')} t from t0), t2 as (select kind, id, t, list_filter(t, lambda x: x not in ({STOP_ALL})) c from t1),
terms as (select kind, id, case when len(c) > 0 then c else t end t from t2)"""


@query("o22_expand_groups_all", f"""with {intent_sql(TEXTS_SQL)}, {ALL_TERMS},
dict(head, words, gentle) as (values {rows_sql((k, "|".join(x), "|".join(y for y in x if y == k or y not in W.MACHINE_SENSES)) for k, x in ALSO)}),
e0 as (select kind, id, unnest(t) term, generate_subscripts(t, 1) pos from terms),
e1 as (select *, term || ' ' || lead(term) over (partition by kind, id order by pos) pair from e0),
e2 as (select kind, id, term, pos, pair, pair in (select head from dict where head like '% %') opens from e1),
e3 as (select *, coalesce(lag(opens) over (partition by kind, id order by pos), false) follows from e2),
e4 as (select kind, id, case when coalesce(opens, false) then pair else term end head, row_number() over (partition by kind, id order by pos) ord from e3 where not follows)
select kind, id, ord, coalesce(case when {SURE} then gentle else words end, head) g from e4 join intents using (kind, id) left join dict using (head)""")
def expand_groups_all(spark, d):
    x = texts_of(spark, d).withColumn("key", F.struct("kind", "id"))
    return I.expanded(x, "key").select("key.*", "ord", "g")


@query("o30_intent_flags_all", f"with {intent_sql(TEXTS_SQL)} select kind, id, conditions, locations, modifiers, confidence, purpose from intents")
def intent_flags_all(spark, d):
    x = texts_of(spark, d).withColumn("key", F.struct("kind", "id"))
    return I.flags(x, "key").select("key.*", "conditions", "locations", "modifiers", "confidence", "purpose")


STRONG = [(c, w) for c, (strong, _) in W.CONDITION_TEXT.items() for w in strong.split()]
WEAK = [(c, w) for c, (_, weak) in W.CONDITION_TEXT.items() for w in weak.split()]
EVIDENCE = f"""
strong(condition, word) as (values {rows_sql(STRONG)}), weak(condition, word) as (values {rows_sql(WEAK)}), context(word) as (values {rows_sql((w,) for w in sorted({*W.MEDICAL_CONTEXT}))}),
said as (select distinct id, word from tok where kind = 'documents'),
near as (select distinct id from said join context using (word)),
proof as (select distinct id, condition from said join strong using (word) union select distinct id, condition from said join near using (id) join weak using (word))"""
HOLDS = f"exists (select 1 from stemmed s where s.id = h.doc_id and (s.stem = {stem_sql('x')} or (length({stem_sql('x')}) >= 4 and starts_with(s.stem, {stem_sql('x')}))))"


@query("o82_condition_coverage_all", f"""with {BATCH}, {POSTS}, {BM25}, {intent_sql(TEXTS_SQL)}, {ALL_TERMS}, {EVIDENCE},
syn(term, also) as (values {rows_sql((t, w) for t, also in W.SYNONYMS.items() for w in also)}),
hurt as (select id qid, conditions, locations, modifiers, list_filter(t, lambda x: x not in ({", ".join(f"'{w}'" for w in sorted(I.OF_INJURY))})) others from intents join terms using (kind, id) where kind = 'benchmark' and {SURE}),
h as (select s.doc_id, hurt.* from scored s join hurt using (qid)),
stemmed as (select distinct id, {stem_sql('word')} stem from said where id in (select doc_id from h)),
asked as (select qid, doc_id, unnest(others) x from h),
also as (select qid, doc_id, asked.x term, syn.also x from asked join syn on syn.term = asked.x),
one as (select qid, doc_id, x term from asked h where {HOLDS}),
two as (select distinct qid, doc_id, term from also h where {HOLDS} and not exists (select 1 from one where one.qid = h.qid and one.doc_id = h.doc_id and one.term = h.term)),
credit as (select qid, doc_id, sum(n) n from (select qid, doc_id, 1.0 n from one union all select qid, doc_id, 0.5 from two) group by all),
known as (select h.qid, h.doc_id, count(*) n from h join proof on proof.id = h.doc_id and list_contains(h.conditions, proof.condition) group by all),
places as (select h.qid, h.doc_id, count(distinct part) n from h join said on said.id = h.doc_id join body using (word) where list_contains(h.locations, part) group by all),
mods as (select h.qid, h.doc_id, count(*) n from h join said on said.id = h.doc_id where list_contains(h.modifiers, word) group by all),
shares as (select qid, doc_id, coalesce(known.n, 0) k, (4.0 * coalesce(known.n, 0) + coalesce(places.n, 0) + 0.5 * coalesce(mods.n, 0) + coalesce(credit.n, 0)) / (4.0 * len(conditions) + len(locations) + len(others) + 0.5 * len(modifiers)) share
  from h left join known using (qid, doc_id) left join places using (qid, doc_id) left join mods using (qid, doc_id) left join credit using (qid, doc_id))
select qid, doc_id, cast(round(share, 6) as double) coverage, cast(round(case when k > 0 then 1 else 0.25 end * share, 6) as double) score from shares""")
def condition_coverage_all(spark, d):
    """Of passages that describe an injury, in every document that BM25 scores for them."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("raw"))
    hits = scored(spark, d)[2].join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return I.covered(hits, items)


@ranking("flagship_hybrid_search", f"""{BASE}, {DIVERSE},
seed as (select qid, doc_id v from rel where rank = 1),
e as (select vec_id, embedding e from embeddings),
qs as (select qid, vec_id own, e from seed join e on vec_id = v),
cs as (select qid, e.vec_id doc_id, round(list_dot_product(cast(qs.e as double[]), cast(e.e as double[])), 6) cos from qs, e),
near as (select qid, doc_id, cos, row_number() over (partition by qid order by cos desc, doc_id) near_rank from cs qualify near_rank <= 20),
f as (select coalesce(w.qid, n.qid) qid, coalesce(w.doc_id, n.doc_id) doc_id, score, case when cos >= case when score is not null then 0.25 else 0.3 end then 2.0 / (5 + near_rank) * case when score is not null then 0.5 else 1 end else 0 end bonus from div w full join near n on w.qid = n.qid and w.doc_id = n.doc_id),
g as (select qid, doc_id, round(coalesce(score, 0) + coalesce(bonus, 0), 6) fused from f where score is not null or bonus > 0)
select qid, doc_id, fused, row_number() over (partition by qid order by fused desc, doc_id) rank from g qualify rank <= 20""")
def hybrid_search(spark, d, limit: int | None = 40):
    """Keywords by BM25, evidence and diversity; neighbours of each query's best document; fused by rank."""
    from ..operators import vectors as V

    rel = written(relevant(spark, d, limit), "relevant")
    words = R.diversify(rel, ["qid"]).select("qid", "doc_id", "score")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    seed = rel.filter("rank = 1").join(vec, "doc_id").select("qid", "embedding")
    near = V.topk(vec, seed, 20, key="doc_id")
    return S.top(R.fuse_ranks(words, near, floors=(0.25, 0.3)), 20, by="fused").select("qid", "doc_id", "fused", "rank")
