"""Readers of the files that knowledge collections come in. Each takes a path (or folder, or pattern) that Spark opens, and
returns a DataFrame with a declared schema; malformed rows are dropped or listed, never guessed."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAZETTEER = "name string, kind string, lat string, lon string, region string, postcode string"
GOLD = "id string, query string, `set` string, `group` string, tags array<string>, expected array<struct<url:string,item:string,path:string>>"
ITEM = "id string, title string, kind string, tier string, category string, search_weight double, priority int, size_bytes bigint"
ITEM_FIELDS = ",".join(x.replace(" ", ":") for x in ITEM.split(", "))
GEOJSON = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places from CSV or gzipped CSV; rows whose coordinates are no numbers are dropped."""
    rows = spark.read.option("header", True).schema(GAZETTEER).csv(path)
    rows = rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("lat", "lon")})
    return rows.filter("lat is not null and lon is not null and name is not null")


def gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, problems (file, number, line, problem)) of JSONL files of queries with what they should find; lines are numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    raw = whole.filter("trim(value) <> '' and not startswith(trim(value), '#')").withColumn("number", (F.col("at") + 1).cast("long"))
    x = raw.select("file", "number", "value", F.from_json("value", GOLD, {"mode": "PERMISSIVE"}).alias("r")).select("file", "number", "value", "r.*")
    problem = (
        F.when(F.col("id").isNull(), "no id").when(F.coalesce("query", F.lit("")) == "", "no query").when(F.col("set").isNull(), "no set")
        .when(F.coalesce(F.size("expected"), F.lit(0)) <= 0, "nothing expected")
    )
    x = x.withColumn("problem", problem)
    return x.filter("problem is null").drop("file", "number", "value", "problem"), x.filter("problem is not null").select("file", "number", F.col("value").alias("line"), "problem")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON manifests {"items": [...]}, with their file and place."""
    whole = spark.read.option("multiLine", True).schema(f"items array<struct<{ITEM_FIELDS}>>").json(path)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode("items").alias("pos", "item")).select("file", "pos", "item.*")


def catalogue_script(text: Column) -> Column:
    """Rows of a catalogue inside a script: what stands between the first [ and the last ], rows of four fields or more."""
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.filter(F.from_json(inner, "array<array<string>>"), lambda r: F.size(r) >= 4)


def catalogue(texts: DataFrame, text: str = "value") -> DataFrame:
    rows = texts.select(catalogue_script(F.col(text)).alias("rows")).select(F.size("rows").alias("n"), F.posexplode("rows").alias("pos", "r"))
    return rows.select(F.col("r")[0].alias("title"), F.col("r")[1].alias("author"), F.col("r")[2].alias("shelf"), F.col("r")[3].alias("id"), (F.col("n") - F.col("pos")).cast("long").alias("popularity"))


def search_feed(texts: DataFrame, text: str = "value") -> DataFrame:
    """Items of RSS results: title, link, description."""
    item = "channel struct<item:array<struct<title:string,link:string,description:string>>>"
    return texts.select(F.posexplode(F.from_xml(F.col(text), item)["channel"]["item"]).alias("pos", "i")).select("pos", "i.*")


def open_catalogue(texts: DataFrame, text: str = "value") -> DataFrame:
    """Entries of an OPDS feed."""
    entry = "entry array<struct<id:string,title:string,updated:string,summary:string>>"
    return texts.select(F.posexplode(F.from_xml(F.col(text), entry)["entry"]).alias("pos", "e")).select("pos", "e.*")


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON sequences, one a line (a record separator may begin it): id, type, coordinates, props."""
    one = F.from_json(F.regexp_replace("value", "^\x1e", ""), GEOJSON)
    lines = spark.read.text(path).select(one.alias("f")).filter("f.geometry is not null and f.type = 'Feature'")
    return lines.select("f.id", F.col("f.geometry.type").alias("geom_type"), "f.geometry.coordinates", F.col("f.properties").alias("props"))


def feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole GeoJSON collections, each file one collection; files may break lines anywhere."""
    whole = spark.read.option("multiLine", True).schema(f"type string, features array<{GEOJSON}>").json(path)
    one = whole.filter("type = 'FeatureCollection'").select(F.explode("features").alias("f")).filter("f.geometry is not null and f.type = 'Feature'")
    return one.select("f.id", F.col("f.geometry.type").alias("geom_type"), "f.geometry.coordinates", F.col("f.properties").alias("props"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, value): the entries of small YAML files of rules, kits or places, as JSON. JSON is YAML too, so files of
    JSON need no parser; others need the yaml package."""
    rows = []
    for r in spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").orderBy("file").collect():
        try:
            whole = json.loads(r.value)
        except ValueError:
            import yaml

            whole = yaml.safe_load(r.value)
        rows += [(r.file, str(k), json.dumps(v, sort_keys=True)) for k, v in (whole.items() if isinstance(whole, dict) else enumerate(whole or []))]
    return spark.createDataFrame(rows, "file string, entry string, value string")


def unchanged(spark: SparkSession, path: str, signature: str | None) -> tuple[bool, str]:
    """Whether files have the signature (names, sizes and times) of an earlier load, and their signature now."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    now = files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "path", "length", "at")))), 256)).first()[0]
    return now == signature, now


def write_json(df: DataFrame, path: str, most_bytes: int | None = None, text: str | None = None) -> None:
    """Rows as JSON lines. With most_bytes, a text that makes its row longer is cut to what is left for it."""
    if most_bytes:
        rest = F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c != text])))
        df = df.withColumn(text, F.left(text, F.greatest(F.lit(0), F.lit(most_bytes) - rest)))
    df.write.mode("overwrite").json(path)


def representative_point(geom_type: Column, coordinates: Column) -> Column:
    """A point itself, or the mean of a polygon's outer vertices, as (lat, lon)."""
    point = F.from_json(coordinates, "array<double>")
    ring = F.when(geom_type == "Polygon", F.from_json(coordinates, "array<array<array<double>>>")[0]).otherwise(F.from_json(coordinates, "array<array<double>>"))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    at = lambda k: F.when(geom_type == "Point", point[k]).otherwise(mean(k))
    return F.struct(at(1).alias("lat"), at(0).alias("lon"))


def spectrum(texts: DataFrame, text: str = "value") -> DataFrame:
    """Bins of ragged sweeps (date, time, low, high, step, samples, dB...): short or non-numeric rows are left out."""
    p = F.transform(F.split(F.col(text), ","), F.trim)
    n = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    rows = texts.select(p.alias("p")).filter(F.size("p") >= 7)
    rows = rows.select(F.concat_ws(" ", F.col("p")[0], F.col("p")[1]).alias("at"), n(2).alias("low"), n(4).alias("step"), F.transform(F.slice("p", F.lit(7), F.size("p")), lambda x: x.try_cast("double")).alias("db"))
    rows = rows.filter(F.col("low").isNotNull() & F.col("step").isNotNull() & F.forall("db", lambda x: x.isNotNull()))
    return rows.select("at", "low", "step", F.posexplode("db").alias("bin", "db")).select("at", (F.col("low") + F.col("bin") * F.col("step") + F.col("step") / 2).alias("hz"), "db")


def band_mean(bins: DataFrame, low: float, high: float) -> DataFrame:
    """Mean power of a band, to two places; no row without a bin."""
    return bins.filter(F.col("hz").between(low, high)).groupBy("at").agg(F.round(F.avg("db"), 2).alias("db"))


def text_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pages of a text with form feeds, from 1; blank ones at the end go."""
    p = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\f\s]+$", ""), "\f")
    return docs.select(key, F.posexplode(p).alias("pos", "page")).select(key, (F.col("pos") + 1).alias("page_no"), "page")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, meta, body): the front matter between --- lines as a map of its plain keys, and what follows."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    front = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    pairs = F.transform(F.filter(F.split(front, "\r?\n"), lambda s: s.rlike(r"^[\w-]+:")), lambda s: F.struct(F.regexp_extract(s, r"^([\w-]+):", 1).alias("k"), F.trim(F.regexp_replace(s, r"^[\w-]+:\s*", "")).alias("v")))
    return x.select("file", F.map_from_entries(pairs).alias("meta"), F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "").alias("body"))


def epub_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, html) of the spine of every EPUB: one file at a time, which is read whole by its format."""

    def spine(batches):
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    container = z.read("META-INF/container.xml").decode("utf-8", "replace")
                    opf = re.search(r'full-path="([^"]+)"', container)[1]
                    text = z.read(opf).decode("utf-8", "replace")
                    base = opf.rpartition("/")[0]
                    hrefs = {}
                    for tag in re.findall(r"<item\b[^>]*>", text):
                        name_of, place = re.search(r'\bid="([^"]+)"', tag), re.search(r'\bhref="([^"]+)"', tag)
                        if name_of and place:
                            hrefs[name_of[1]] = place[1]
                    docs = [hrefs[i] for i in re.findall(r'<itemref\b[^>]*\bidref="([^"]+)"', text) if i in hrefs]
                    pages = [z.read(f"{base}/{d}" if base else d).decode("utf-8", "replace") for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages)), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.string())], ["file", "pos", "html"])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInArrow(spine, "file string, pos int, html string")


def _folder(spark: SparkSession, path: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, Path = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(Path(path))) if fs.exists(Path(path)) else []


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: it is written beside its place and renamed."""
    fs, Path = _folder(spark, path)
    out = fs.create(Path(f"{path}.new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(Path(f"{path}.new"), Path(path)):
        raise FileExistsError(path)


def read_notes(spark: SparkSession, path: str) -> dict[str, str]:
    """Small files (a file, or those of a folder) by name."""
    fs, Path = _folder(spark, path)
    if not fs.exists(Path(path)):
        return {}
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return {r.name: r.value for r in rows if not r.name.endswith(".new")}


def remove(spark: SparkSession, path: str) -> None:
    fs, Path = _folder(spark, path)
    fs.delete(Path(path), True)


def publish(df: DataFrame, root: str, generation: str, keep: int = 2) -> str:
    """Write a generation beside the others, point to it, and remove all but the ``keep`` that were pointed to last. Pointers are numbered; readers
    follow the newest, so there is one at every moment."""
    spark, root = df.sparkSession, root.rstrip("/")
    path = f"{root}/gen={generation}"
    df.write.mode("overwrite").parquet(path)
    point(spark, root, generation, keep)
    return path


def point(spark: SparkSession, root: str, generation: str, keep: int = 2) -> None:
    pointers = [x for x in names_in(spark, root) if x.startswith("CURRENT-") and not x.endswith(".new")]
    number = int(pointers[-1].removeprefix("CURRENT-")) + 1 if pointers else 1
    write_note(spark, f"{root}/CURRENT-{number:012d}", generation)
    held = {x: read_notes(spark, f"{root}/{x}")[x] for x in [*pointers, f"CURRENT-{number:012d}"]}
    stay: list[str] = []
    for x in sorted(held, reverse=True):
        if held[x] not in stay and len(stay) < keep:
            stay.append(held[x])
        elif held[x] not in stay:
            remove(spark, f"{root}/{x}")
    for name in names_in(spark, root):
        if name.startswith("gen=") and name.removeprefix("gen=") not in stay:
            remove(spark, f"{root}/{name}")


def newest(spark: SparkSession, root: str) -> str:
    """The path of the generation that is pointed to."""
    root = root.rstrip("/")
    pointer = [x for x in names_in(spark, root) if x.startswith("CURRENT-") and not x.endswith(".new")][-1]
    return f"{root}/gen={read_notes(spark, f'{root}/{pointer}')[pointer]}"


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(newest(spark, root))
