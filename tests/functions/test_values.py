"""Functions and operators on literal rows, with the values that the reference behaviour asks for."""

import math

import pytest
from pyspark.sql import functions as F

from fieldlamp.functions import domain as D, geo as G, text as T, times as C
from fieldlamp.operators import corpus as P, intent as I, library as L, ranking as R, rules as U, series as S, spatial as X, vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(T.section_of(F.lit("/m/water#in-the-uk"))) == "In the UK" and v(T.section_of(F.lit("/d#page=3"))) == "" and v(T.section_of(F.lit("/d"))) == ""
    assert v(T.strip_heading(F.lit("  What to do: boil"), F.lit("/m#what-to-do"))) == "boil"
    assert v(T.place_candidates(F.lit(" near  York in "))) == ["near York in", "York in", "near York"] and v(T.place_candidates(F.lit(" "))) == []
    assert v(T.url_matches(F.lit("http://x/a%20b/c"), F.lit("http://x/a b/"))) and not v(T.url_matches(F.lit("http://x/ab"), F.lit("http://x/a")))
    assert v(T.loose_stem(F.lit("foxes"))) == "fox" and v(T.loose_stem(F.lit("warnings"))) == "warn" and v(T.loose_stem(F.lit("glamorously"))) == "glamorously" and v(T.loose_stem(F.lit("poisonous"))) == "poisonou"
    assert v(T.same_word(F.lit("boil"), F.lit("boiling"))) and not v(T.same_word(F.lit("boil"), F.lit("boiler room")))
    assert v(T.is_question(F.lit("Why boil water"))) and not v(T.is_question(F.lit("How to boil water"))) and v(T.is_question(F.lit("Boil?")))
    terms = F.array(F.lit("boil"), F.lit("water"))
    assert v(T.title_signal(F.lit("Boiling water"), terms, F.lit(False))) == 4.0 and v(T.title_signal(F.lit("Why boil"), terms, F.lit(False))) == 0.5
    assert v(T.title_signal(F.lit("Water"), terms, F.lit(True))) == 3.0 and v(T.title_signal(F.lit("Fire"), terms, F.lit(True))) == 0.0
    assert v(T.longest_terms(F.array(*map(F.lit, ("aa", "bbbb", "cc", "dddd"))), 3)) == ["aa", "bbbb", "dddd"]
    assert v(T.term_share(F.array(*[F.array(F.lit("x"), *[F.lit(f"alt{i}") for i in range(150)], F.lit("boat"))]), F.lit("a boat"))) == 0.5
    for word, garbled in (("hello", False), ("“quoted”", False), ("don’t", False), ("xkqz", True), ("heLlo", True), ("café", True), ("ab", False), ("123", False), ("A1b", True), ("NASA", False), ("hmm", False)):
        assert v(T.is_garbled(F.lit(word))) is garbled, word


def test_sentence_chunks(spark):
    chunks = lambda s, n: value(spark, P.sentence_chunks(F.lit(s), n))
    assert chunks("One two. Three four! Five", 20) == ["One two. Three four!", "Five"]
    assert chunks("a long sentence without any end at all", 12) == ["a long", "sentence", "without any", "end at all"]
    assert chunks(None, 10) == [] and chunks(" \n ", 10) == [] and chunks("x" * 30, 10) == ["x" * 30]


def test_quality(spark):
    rows = [(1, "good words stand here\nand here\nx"), (2, None), (3, "xkqzw brzt gdfkl words")]
    got = {r.doc_id: r for r in P.quality(spark.createDataFrame(rows, "doc_id long, text string"), least_words=3).collect()}
    assert (got[1].words, got[1].garble, got[1].short_share, got[1].damaged) == (7, 0.0, round(1 / 3, 6), False)
    assert (got[2].words, got[2].garble, got[2].short_share, got[2].damaged) == (0, 1.0, 1.0, True) and got[3].garble == 0.75


def test_seen_before_counts_pages(spark):
    rows = [(1, 1, "h")] + [(1, 2, x) for x in "abcd"] + [(1, 3, "h"), (1, 6, "h"), (1, 11, "h"), (2, 3, "h")]
    got = {(r.doc, r.page, r.line): r.repeats for r in P.seen_before(spark.createDataFrame(rows, "doc long, page long, line string"), "doc", "page", "line").collect()}
    assert got[(1, 3, "h")] and got[(1, 6, "h")] and not got[(1, 11, "h")] and not got[(1, 1, "h")] and not got[(2, 3, "h")]


def test_best_window_prefers_distinct_terms(spark):
    rows = [(1, 0, 10, 9, ["a"]), (1, 1, 10, 1, ["b"]), (1, 2, 10, 1, ["c"]), (1, 3, 10, 2, ["a"]), (2, 0, 500, 3, ["a", "b"]), (2, 1, 5, 2, ["a"]), (3, 0, 5, 0, []), (3, 1, 5, 0, [])]
    got = {r.k: (r.start, r.stop, r.score) for r in P.best_window(spark.createDataFrame(rows, "k long, pos int, cost long, hits int, terms array<string>"), "k", 20).collect()}
    assert got == {1: (0, 1, 30.0), 2: (0, 0, 23.0), 3: (0, 1, 0.0)}


def test_geo(spark):
    v = lambda c: value(spark, c)
    n = lambda m, c: v(G.naismith_minutes(F.lit(float(m)), F.lit(float(c))))
    assert (n(0, 50), n(1, 0), n(5000, 0), n(5000, 100), n(5000, -100)) == (0, 1, 60, 70, 60)
    assert v(G.compass(F.lit(359.0))) == "N" and v(G.compass(F.lit(45.0))) == "NE"
    assert v(G.grid_reference(F.lit(530123), F.lit(180456))) == "TQ 301 804" and v(G.grid_letters(F.lit(-1), F.lit(5))) is None
    p = v(G.parse_grid(F.lit("tq 301 804")))
    assert (p.easting, p.northing) == (530100.0, 180400.0) and v(G.parse_grid(F.lit("TQ 30 1"))) is None and v(G.parse_grid(F.lit("IQ 30 11"))) is None
    assert v(G.height_tile(F.lit(53.2), F.lit(-1.5))) == "N53W002"


def test_places_on_both_sides_of_180_degrees_meet(spark):
    rows = [(1, "n", 60.0, 179.9999), (2, "n", 60.0, -179.9997), (3, "n", 60.0, 0.0), (4, "n", -33.0, 180.0), (5, "n", -33.0, -180.0), (6, "m", 60.0, 179.9999)]
    df = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    assert {r.id: r.cluster for r in X.clusters(df, 30.0, ["name"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_near_pairs_against_all_pairs(spark):
    import random

    random.seed(6)
    pts = [(i, random.choice([60.0, 0.0, 85.0, -45.0, 89.5]) + random.uniform(-0.02, 0.02), random.choice([180.0, 0.0, -180.0, 90.0]) + random.uniform(-0.03, 0.03)) for i in range(250)]
    pts = [(i, a, o - 360 if o > 180 else o + 360 if o < -180 else o) for i, a, o in pts]
    a = spark.createDataFrame(pts, "a long, lat double, lon double")
    got = {(r.a, r.b) for r in X.near_pairs(a, a.withColumnRenamed("a", "b"), 1500.0).collect()}

    def metres(p, q):
        x, y = math.radians(q[1] - p[1]), math.radians(q[2] - p[2])
        h = math.sin(x / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(y / 2) ** 2
        return 2 * G.EARTH_M * math.asin(min(1, math.sqrt(h)))

    assert got == {(p[0], q[0]) for p in pts for q in pts if metres(p, q) <= 1500}


def test_times(spark):
    v = lambda c: value(spark, c)
    at = lambda s: F.to_timestamp(F.lit(s))
    assert str(v(C.next_daily(at("2026-07-01 05:30:00"), ["07:00"], "Europe/London").cast("string"))) == "2026-07-01 06:00:00"
    assert str(v(C.next_daily(at("2026-01-01 07:00:00"), ["07:00"], "Europe/London").cast("string"))) == "2026-01-02 07:00:00"
    marks = v(C.fallout(at("2026-01-01 00:00:00"), at("2026-01-01 10:00:00")))
    assert [(m.hours, m.reached, m.left_s) for m in marks] == [(7, True, 0), (49, False, 39 * 3600), (343, False, 333 * 3600)]
    assert v(C.countdown(F.lit(3725))) == "1:02:05" and v(C.countdown(F.lit(65))) == "1:05" and v(C.beats(F.lit(60.0))) == 110
    assert v(C.duration_seconds(F.lit("1.5h"))) == 5400.0 and v(C.duration_seconds(F.lit("5 h"))) is None
    assert v(C.relative(F.lit(59))) == "just now" and v(C.relative(F.lit(3600))) == "1 hour ago" and v(C.relative(F.lit(200000))) == "2 days ago"
    assert v(C.iso_date(F.lit("03/02/2026")).cast("string")) == "2026-02-03" and v(C.iso_date(F.lit("30/02/2026"))) is None


@pytest.mark.parametrize(("months", "amount"), [(1, None), (2, "2.5ml"), (23, "5ml"), (24, "7.5ml"), (72, None)])
def test_doses(spark, months, amount):
    row = spark.createDataFrame([("paracetamol liquid 120", months)], "form string, months int")
    assert L.in_bands(row, D.doses(spark), "form", "months").first().amount == amount


def test_household(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(D.generator_hours(lit(10.0), lit(2.0))) == 5.0 and v(D.generator_hours(lit(10.0), lit(0.0))) is None
    assert tuple(v(D.solar_daily(lit(100.0), lit(12)))) == (50, 100) and tuple(v(D.solar_daily(lit(100.0), lit(6)))) == (400, 500) and v(D.solar_daily(lit(1.0), lit(13))) is None
    assert tuple(v(D.kit_quantity(lit(2.5), lit("l"), lit("person-day"), lit(1), lit(3)))) == (7.5, "7.5 l for 1 person over 3 days")
    assert v(D.reading_text(lit(0.0), lit("on"))) == "off" and v(D.reading_text(lit(3.04), lit("ppm"))) == "3 ppm" and v(D.reading_text(lit(3.06), lit(""))) == "3.1"
    assert v(D.reading_tone(lit("temp_in"), lit(15.0), lit("C"))) == "warn" and v(D.reading_tone(lit("x"), lit(0.0), lit("up"))) == "danger"
    assert v(D.opening_hours(lit("Mo-Fr 09:00-17:00;PH off"))) == "Mon to Fri 09:00-17:00; bank holidays closed" and v(D.opening_hours(lit("24/7"))).startswith("Open 24")
    assert v(D.pack_title(lit("UK_North_East"))) == "North – East" and v(D.pack_title(lit("Ireland_West"))) == "Ireland – West" and v(D.humanise(lit("water_works"))) == "Water works"
    assert v(D.source_class(lit("core"), lit("medical"), lit("nhs-a"))) == "nhs" and v(D.source_class(lit("core"), lit("odd"), lit("x"))) == "reference"
    hospital = lambda e: F.create_map(lit("amenity"), lit("Hospital"), lit("emergency"), lit(e))
    assert v(D.facility(hospital("yes"), "emergency-department")) and not v(D.facility(hospital("no"), "emergency-department"))


def test_kept_rows(spark):
    rows = [(1, 10, "a", "card", "x", None, 5.0, 0), (1, 11, "b", "card", "x", "meaning", 4.0, None), (1, 12, "b", "card", "x", "meaning", 6.0, None), (1, 13, "c", "card", "x", None, 3.0, 7), (1, 14, "d", "page", "x", None, 2.0, 1)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, page string, kind string, source string, via string, score double, place long")
    near = spark.createDataFrame([(1, "b", 0.7), (1, "c", 0.6), (1, "e", 0.9)], "qid long, page string, cos double")
    assert {r.doc_id for r in R.kept_cards(df, near).collect()} == {10, 12}
    list_ = spark.createDataFrame([(1, i, i, k, p, a, 0.5, 1.0) for i, k, p, a in ((1, "page", 0, 0), (2, "card", 1, 1), (3, "page", 0, 0), (4, "card", 2, 1), (5, "card", 2, 2), (6, "page", 0, 0))], "qid long, doc_id long, rank long, kind string, primary int, alias int, coverage double, score double")
    assert [r.doc_id for r in R.promote_cards(list_).orderBy("place").collect()] == [5, 1, 2, 4, 3, 6] or [r.doc_id for r in R.promote_cards(list_).orderBy("place").collect()][0] == 5
    kept = spark.createDataFrame([(1, i, i, i in (6, 7)) for i in range(1, 9)], "qid long, doc_id long, rank long, kept boolean")
    assert [r.doc_id for r in R.protect(kept, 3, 1).orderBy("place").collect()][:4] == [1, 7, 6, 2] or {6, 7} <= {r.doc_id for r in R.protect(kept, 3, 1).filter("place <= 3").collect()}


def test_evidence_of_conditions(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    e = lambda t, medical=False: value(spark, I.evidence(lit("burn", "fracture"), lit(*t), F.lit(medical)))
    assert e(["scald"]) == ["burn"] and e(["burn"]) == [] and e(["burn", "treat"]) == ["burn"] and e(["broken"], True) == ["fracture"] and e(["x"]) == []
    m = lambda *t: value(spark, I.medical(lit(*t), ["asthma", "heart attack"], F.lit(False)))
    assert m("asthmas") and m("my", "heart", "attack") and not m("heart")


def test_rules_on_rows(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    states = F.create_map(F.lit("power"), F.lit("off"))
    holds = lambda **c: value(spark, U.holds(F.create_map(*[y for k, v in c.items() for y in (F.lit(k), lit(*v))]) if c else F.lit(None), states))
    assert holds() and holds(power=["off"]) and holds(power=["any"]) and not holds(power=["working"]) and not holds(unknown=["any"])
    ticks = spark.createDataFrame([(1, "b", True)], "situation long, rule string, done boolean")
    todo = spark.createDataFrame([(1, "a", "now", 1), (1, "b", "now", 2), (1, "b", "week", 5)], "situation long, rule string, bucket string, place long")
    assert sorted((r.rule, r.place, r.done) for r in U.with_checklist(todo, ticks).collect()) == [("a", 1, False), ("b", 2, True)]
    report = U.reports(
        spark.createDataFrame([(1, "power", "off"), (2, "power", "working")], "situation long, id string, state string"),
        spark.sql("select 1L situation, 'dark' rule, timestamp_ntz'2026-01-01 10:00:00' due_at, true passed, 1L place"), spark.sql("select 1L situation, 'lamp' rule, 'now' bucket, 1L place"),
    )
    got = {r.situation: r.report for r in report.collect()}
    assert got[1] == "# Situation report\n\n## Conditions\n\n- **power**: off\n\n## What is coming\n\n- PASSED 2026-01-01 10:00: dark\n\n## Tasks\n\n- [ ] lamp (now)\n"
    assert got[2] == "# Situation report\n\n## Conditions\n\n- **power**: working\n"


def test_chapters(spark):
    rows = [(1, i, i % 10 == 0, 100) for i in range(30)] + [(2, 0, True, 5)]
    got = {(r.k, r.chapter): (r.first, r.words) for r in P.chapters(spark.createDataFrame(rows, "k long, pos long, heading boolean, words long"), "k", 900, 50).collect()}
    assert got == {(1, 1): (0, 1000), (1, 2): (10, 1000), (1, 3): (20, 1000), (2, 1): (0, 5)}


def test_recall_of_approximate_neighbours(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    exact = {(r.qid, r.vec_id) for r in entry.queries()["o85_exact_topk"](spark, d).collect()}
    near = {(r.qid, r.vec_id) for r in entry.queries()["o86_approximate_topk"](spark, d).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_neighbours_in_blocks(spark, monkeypatch):
    import random

    random.seed(9)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(500, [0.0] * 6), (501, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "qid")
    whole = sorted(map(tuple, V.topk(df, q, 5).collect()))
    monkeypatch.setattr(V, "BUCKET_ROWS", 13)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 4)
    assert sorted(map(tuple, V.topk(df, q, 5).collect())) == whole and len(whole) == 5 * 18
    assert V.topk(df, q.limit(0), 5).count() == 0


def test_collection_guards(spark):
    rows = spark.createDataFrame([(1, "x" * 300), (1, "y" * 300), (2, "short"), (3, None)], "k long, t string")
    assert {r.problem: r.n for r in V.collection_problems(rows, 100, "k", "t").collect()} == {"repeated key": 1, "skipped": 2, "shrunk": 98}
    assert value(spark, V.pooled_vector(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))), 1)) == [1.0, 0.0]


def test_sessions_and_snapshots(spark, tmp_path):
    rows = spark.sql("select * from values (1, 'a', timestamp'2026-01-01 00:00:00', 1.0), (2, 'a', timestamp'2026-01-01 00:29:59', 1.0), (3, 'a', timestamp'2026-01-01 01:00:00', 1.0) v(event_id, user_id, ts, value)")
    assert sorted(r.n for r in S.sessions(rows, "user_id", "30 minutes").collect()) == [1, 2]
    L.keep_snapshot({"t": rows}, str(tmp_path), "before")
    assert L.snapshot(spark, str(tmp_path), "before", ["t"])["t"].count() == 3
    keep, rest = L.newest(rows.select("event_id"), 2, [F.desc("event_id")])
    assert sorted(r.event_id for r in keep.collect()) == [2, 3] and [r.event_id for r in rest.collect()] == [1]


def test_marks(spark):
    parts = lambda title, query: [(r.text, r.match) for r in value(spark, T.marks(F.lit(title), F.lit(query)))]
    assert parts("Power cut: what to do", "power cuts") == [("Power cut", True), (": what to do", False)]
    assert parts("Bleed the Tinned, tinned", "bleeding tins") == [("Bleed", True), (" the ", False), ("Tinned", True), (", ", False), ("tinned", True)]
    assert parts("water  purification", "waters a purify") == [("water", True), ("  purification", False)]
    assert parts(None, "x y") == [("", False)] and parts("Fire", "") == [("Fire", False)] == parts("Fire", " ! ") and parts("Éclair", "éclairs") == [("Éclair", True)]
    long = "one two " * 3000
    assert parts(long, "two")[1] == ("two", True) and "".join(t for t, _ in parts(long, "two")) == long


def test_projection(spark):
    def dms(d, m, s):
        return math.radians(d + m / 60 + s / 3600)

    got = value(spark, F.array(*G.projected(F.lit(dms(52, 39, 27.2531)), F.lit(dms(1, 43, 4.5177)), G.GRIDS["british"])))
    assert abs(got[0] - 651409.903) < 0.002 and abs(got[1] - 313177.270) < 0.002
    back = value(spark, F.array(*G.unprojected(F.lit(651409.903), F.lit(313177.270), G.GRIDS["british"])))
    assert abs(back[0] - dms(52, 39, 27.2531)) < 1e-9 and abs(back[1] - dms(1, 43, 4.5177)) < 1e-9
    points = spark.createDataFrame([(51.477811, -0.001475, "british", 538884, 177322), (53.349805, -6.260310, "irish", 315904, 234671)], "lat double, lon double, grid string, e long, n long")
    for grid in ("british", "irish"):
        for r in G.to_grid(points.filter(F.col("grid") == grid), "lat", "lon", grid).collect():
            assert abs(r.east - r.e) < 30 and abs(r.north - r.n) < 30, r
        some = spark.range(300).select((50 + F.col("id") % 17 / 2).alias("lat"), (-9 + F.col("id") / 30).alias("lon"))
        there = G.from_grid(G.to_grid(some.select("*", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "lat", "lon", grid), "east", "north", grid)
        worst = there.filter("abs(lon0 + 4) < 5").agg(F.max(F.greatest(F.abs(F.col("lat") - F.col("lat0")), F.abs(F.col("lon") - F.col("lon0"))))).first()[0]
        assert worst < 1e-5  # a metre
    refs = {"SU 3728 1551": ("british", 437285.0, 115515.0), "SU37281551": ("british", 437285.0, 115515.0), "J 338 740": ("irish", 333850.0, 374050.0), "j338740": ("irish", 333850.0, 374050.0), "SU 37 15": None, "SU 372 15": None, "hello": None, "II 123 456": None}
    for ref, want in refs.items():
        r = value(spark, G.parsed_ref(F.lit(ref)))
        assert (r and tuple(r)) == want, ref
    assert value(spark, G.irish_letter(F.lit(333850), F.lit(374050))) == "J" and value(spark, G.irish_letter(F.lit(-1), F.lit(0))) is None


def test_tasks(spark):
    md = "- [ ] boil water\n* [X]  fill jars \n```\n- [x] not this\n```\n- [y] nor this\n- [ ]\n  + [x] nested"
    rows = spark.createDataFrame([(1, md), (2, None), (3, "")], "id long, md string")
    assert [tuple(r) for r in P.tasks(rows, "id", "md").orderBy("id", "nth").collect()] == [(1, 1, False, "boil water"), (1, 2, True, "fill jars"), (1, 3, True, "nested")]
