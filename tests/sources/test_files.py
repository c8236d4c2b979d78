import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldlamp.sources import files as S


def write(path, text, gz=False):
    with (gzip.open if gz else open)(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_gazetteer(spark, tmp_path):
    text = "name,kind,lat,lon,region,postcode\nYork,city,53.96,-1.08,North,YO1\nNowhere,town,x,1,,\n\"Ash, Surrey\",village,51.25,-0.72,South,GU12\n,town,1,2,,\n"
    for gz in (False, True):
        rows = S.gazetteer(spark, write(tmp_path / f"p.csv{'.gz' * gz}", text, gz)).collect()
        assert sorted((r.name, r.lat, r.lon) for r in rows) == [("Ash, Surrey", 51.25, -0.72), ("York", 53.96, -1.08)]
    path = str(tmp_path / "p.csv")
    same, now = S.unchanged(spark, path, None)
    assert not same and S.unchanged(spark, path, now) == (True, now)
    write(path, text + "Leeds,city,53.8,-1.55,North,LS1\n")
    assert not S.unchanged(spark, path, now)[0]


def test_gold_with_problems(spark, tmp_path):
    good = {"id": "q1", "query": "water", "set": "a", "group": "g", "tags": ["t"], "expected": [{"url": "/m/water"}]}
    lines = ["# a comment", "", json.dumps(good), json.dumps({**good, "id": "q2", "expected": []}), json.dumps({**good, "id": None}), "{broken", json.dumps({**good, "id": "q3", "query": ""})]
    rows, problems = S.gold(spark, write(tmp_path / "gold.jsonl", "\n".join(lines)))
    assert [(r.id, r.expected[0].url) for r in rows.collect()] == [("q1", "/m/water")]
    assert sorted(r.problem for r in problems.collect()) == ["no id", "no id", "no query", "nothing expected"]


def test_manifests_in_order(spark, tmp_path):
    for name, ids in (("b.json", ["x"]), ("a.json", ["y", "z"])):
        write(tmp_path / name, json.dumps({"items": [{"id": i, "title": i.upper(), "tier": "core", "priority": 3} for i in ids]}, indent=2))
    got = S.manifests(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r.file, r.pos, r.id, r.title, r.priority) for r in got] == [("a.json", 0, "y", "Y", 3), ("a.json", 1, "z", "Z", 3), ("b.json", 0, "x", "X", 3)]


def test_rules_as_json(spark, tmp_path):
    write(tmp_path / "rules.yaml", json.dumps({"readings": [{"id": "r1"}], "modes": {"a": 1}}))
    assert [(r.entry, json.loads(r.value)) for r in S.rules(spark, str(tmp_path)).collect()] == [("readings", [{"id": "r1"}]), ("modes", {"a": 1})]


def test_catalogue_in_a_script(spark):
    script = 'var books = [["T1","A","s","id1"],["T2","B","s","id2","more"],["short"]]; render(books);'
    got = S.catalogue(texts(spark, script)).orderBy("id").collect()
    assert [(r.title, r.author, r.id, r.popularity) for r in got] == [("T1", "A", "id1", 2), ("T2", "B", "id2", 1)]
    assert S.catalogue(texts(spark, "nothing here", None)).count() == 0


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>/a</link><description>d</description></item><item><title>B</title><link>/b</link></item></channel></rss>"
    assert [(r.pos, r.title, r.link) for r in S.search_feed(texts(spark, rss)).orderBy("pos").collect()] == [(0, "A", "/a"), (1, "B", "/b")]
    opds = "<feed><entry><id>1</id><title>Book</title><updated>2025</updated><summary>s</summary></entry></feed>"
    assert [(r.id, r.title) for r in S.open_catalogue(texts(spark, opds)).collect()] == [("1", "Book")]


def test_features(spark, tmp_path):
    point = {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [1.5, 50]}, "properties": {"name": "x"}}
    area = {"type": "Feature", "id": "q", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2], [0, 2]]]}, "properties": {}}
    bad = {"type": "Feature", "id": "r", "geometry": None, "properties": {}}
    seq = write(tmp_path / "s.geojsonseq", "\n".join("\x1e" + json.dumps(f) for f in (point, area, bad)) + "\n{not json\n")
    whole = write(tmp_path / "w.geojson", json.dumps({"type": "FeatureCollection", "features": [point, area, bad]}, indent=1))
    for rows in (S.features(spark, seq), S.feature_collections(spark, whole)):
        at = rows.select("id", "props", S.representative_point(F.col("geom_type"), F.col("coordinates")).alias("at")).orderBy("id").collect()
        assert [(r.id, r["at"].lat, r["at"].lon) for r in at] == [("p", 50.0, 1.5), ("q", 1.0, 2.0)] and at[0].props == {"name": "x"}


def test_spectrum(spark):
    rows = texts(spark, "2026-01-01, 00:00:00, 100, 130, 10, 1, -50, -40, -30", "2026-01-01, 00:01:00, 100, 130, 10", "2026-01-01, 00:02:00, 100, 130, 10, 1, x, -40, -30")
    bins = S.spectrum(rows)
    assert [(r.hz, r.db) for r in bins.orderBy("hz").collect()] == [(105.0, -50.0), (115.0, -40.0), (125.0, -30.0)]
    assert [r.db for r in S.band_mean(bins, 110, 130).collect()] == [-35.0] and S.band_mean(bins, 500, 600).count() == 0


def test_pages_of_a_text(spark):
    df = spark.createDataFrame([(1, "one\ftwo\n\f\f \n"), (2, None), (3, "\fonly")], "id long, text string")
    got = sorted((r.id, r.page_no, r.page) for r in S.text_pages(df, "id", "text").collect())
    assert got == [(1, 1, "one"), (1, 2, "two"), (2, 1, ""), (3, 1, ""), (3, 2, "only")]


def test_markdown_with_front_matter(spark, tmp_path):
    write(tmp_path / "a.md", "---\ntitle: Water\norder: 3\n---\n# Head\nbody\n")
    write(tmp_path / "b.md", "no front matter\n---\nx\n")
    got = {r.file: (r.meta, r.body) for r in S.markdown_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ({"title": "Water", "order": "3"}, "# Head\nbody\n"), "b.md": ({}, "no front matter\n---\nx\n")}


def test_epub_spine(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package><manifest><item id="x" href="x.html"/><item href="y.html" id="y"/><item id="css" href="s.css"/></manifest><spine><itemref idref="y"/><itemref idref="x"/><itemref idref="gone"/></spine></package>')
        z.writestr("OEBPS/x.html", "<p>x</p>")
        z.writestr("OEBPS/y.html", "<p>y</p>")
    assert [(r.file, r.pos, r.html) for r in S.epub_texts(spark, str(tmp_path)).orderBy("pos").collect()] == [("b.epub", 0, "<p>y</p>"), ("b.epub", 1, "<p>x</p>")]


def test_generations(spark, tmp_path):
    import os

    root = str(tmp_path / "index")
    for g in ("1", "2", "3"):
        S.publish(spark.createDataFrame([(g,)], "g string"), root, g)
        assert [r.g for r in S.current(spark, root).collect()] == [g]
    assert sorted(x for x in os.listdir(root) if x.startswith("gen=")) == ["gen=2", "gen=3"]


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 500), (2, "short")], "id long, note string")
    S.write_json(df, str(tmp_path / "a"), most_bytes=100, text="note")
    got = {r.id: len(r.note) for r in spark.read.json(str(tmp_path / "a")).collect()}
    assert got[2] == 5 and 50 < got[1] <= 100


@pytest.mark.parametrize("text", ["", "[]", "[1,2]"])
def test_odd_catalogues_are_empty(spark, text):
    assert S.catalogue(texts(spark, text)).count() == 0
