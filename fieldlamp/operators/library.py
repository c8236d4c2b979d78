"""Catalogues, lookups, ticks, counts, snapshots and sets of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import save


def scan(rows: DataFrame, equal: dict[str, object], order: list[str]) -> DataFrame:
    """Rows whose columns have the given values, in order; the values reach the scan."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.orderBy(*order)


def chosen(books: DataFrame, author: str | None = None, shelf: str | None = None, words: str | None = None) -> DataFrame:
    """Books of an author and a shelf with all the words in title or author."""
    if author:
        books = books.filter(F.col("author") == author)
    if shelf:
        books = books.filter(F.col("shelf") == shelf)
    if words:
        have = T.tokens(F.concat_ws(" ", "title", "author"))
        books = books.filter(F.size(F.array_except(T.content_terms(F.lit(words)), have)) == 0)
    return books


def listing(books: DataFrame, sort: str = "popular", size: int = 40, page: int = 1, **filters: str | None) -> DataFrame:
    """One page of the chosen books."""
    order = [F.lower("title").asc(), "id"] if sort == "title" else [F.desc("popularity"), "id"]
    return chosen(books, **filters).orderBy(*order).offset((page - 1) * size).limit(size)


def pages(books: DataFrame, by: str, size: int, order: list) -> DataFrame:
    """All pages of every shelf at once: place, page and the shelf's total."""
    w = Window.partitionBy(by)
    x = books.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    return x.withColumn("page", (F.floor((F.col("place") - 1) / size) + 1).cast("long"))


def shelves(books: DataFrame, shelf: str = "shelf") -> DataFrame:
    """(shelf, n, place) of shelves, most books first, then by name; books without a shelf don't count."""
    n = books.filter(F.col(shelf).isNotNull()).groupBy(shelf).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), shelf)).cast("long"))  # a row a shelf


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def newest(rows: DataFrame, n: int, order: list) -> tuple[DataFrame, DataFrame]:
    """(the first n rows by an order that ends in a key, all others)."""
    keep = rows.orderBy(*order).limit(n)
    return keep, rows.join(keep, rows.columns, "left_anti")


def looked_up(rows: DataFrame, weights: DataFrame, key: str, value: str, default: float) -> DataFrame:
    return rows.join(weights.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def ticked(items: DataFrame, ticks: DataFrame, key: list[str]) -> DataFrame:
    """Items with whether they are checked, and when; those never touched are not."""
    return items.join(ticks.select(*key, "checked", "updated"), key, "left").withColumn("checked", F.coalesce("checked", F.lit(False)))


def done_by(items: DataFrame, by: str, done: Column) -> DataFrame:
    return items.groupBy(by).agg(F.sum(F.coalesce(done, F.lit(False)).cast("long")).alias("done"), F.count(F.lit(1)).alias("total"))


def in_bands(rows: DataFrame, bands: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the band (key, low, high, ...) of their key that holds their value: low <= value < high; null without one."""
    b = bands.withColumnRenamed(key, f"{key}_of")
    same = (F.col(key) == F.col(f"{key}_of")) & (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))
    return rows.join(b, same, "left").drop(f"{key}_of")


def counted(rows: DataFrame, by: str, flag: str, values: list[str]) -> DataFrame:
    """Counts by kind and flag, a column a flag."""
    return rows.groupBy(by).pivot(flag, values).agg(F.count(F.lit(1))).fillna(0)


def strongest(rows: DataFrame, by: str, names: list[str], out: str) -> DataFrame:
    """The greatest of several readings, nulls aside."""
    return rows.select(by, F.greatest(*names).alias(out))


def first_appearances(rows: DataFrame, part: list[str], key: list[str], pos: str) -> DataFrame:
    """Each key once, at the place of its first appearance."""
    w = Window.partitionBy(*part, *key).orderBy(pos)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def keys_apart(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): keys of a alone, of b alone, of both."""
    x = a.select(*key).distinct().withColumn("in_a", F.lit(True)).join(b.select(*key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    return x.select(*key, F.when(F.col("in_b").isNull(), "a").when(F.col("in_a").isNull(), "b").otherwise("both").alias("side"))


def together(*collections: DataFrame) -> DataFrame:
    """All features; properties that a collection lacks are null."""
    out = collections[0]
    for x in collections[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def keep_snapshot(tables: dict[str, DataFrame], root: str, name: str) -> None:
    for t, df in tables.items():
        save(df, f"{root}/{name}/{t}")


def snapshot(spark: SparkSession, root: str, name: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{root}/{name}/{t}") for t in tables}


def drive_label(tier: Column, connected: Column) -> Column:
    """Where an item lives, in words."""
    return F.when(tier != "extended", "Core").when(connected, "External drive").otherwise("On external drive (not connected)")


def fetch_state(available: Column, kind: Column, source_type: Column, tier: Column, connected: Column) -> Column:
    """How an item that is not here gets here; null when it is, or when nothing can be done."""
    return (
        F.when(available, F.lit(None).cast("string")).when(kind == "dir", "own").when(source_type == "build", "build")
        .when((tier == "extended") & ~connected, "drive").when(source_type.isin("kiwix", "url"), "download")
    )


def reader_url(available: Column, kind: Column, item: Column, home: Column, catalogues: tuple[str, ...] = ()) -> Column:
    """The page that shows an item; null if there is none or the item isn't here."""
    inside = F.concat(F.lit("/read/"), item, F.lit("/"), F.regexp_replace(F.coalesce(home, F.lit("")), "^/+", ""))
    archive = F.when(item.isin(*catalogues), "/library/books").otherwise(inside) if catalogues else inside
    return F.when(available & (kind == "zim"), archive).when(available & kind.isin("pdf", "epub"), F.concat(F.lit("/doc/"), item))


def file_url(available: Column, kind: Column, dest: Column, original: Column, tier: Column) -> Column:
    """Where the file itself is; a PDF that has become an EPUB is its original."""
    path = F.when((kind == "pdf") & F.endswith(dest, F.lit(".epub")) & original.isNotNull(), original).otherwise(F.coalesce(dest, F.lit("")))
    name = F.substring_index(path, "/", -1)
    folder = F.when(tier == "extended", "/docs/extended/").otherwise("/docs/core/")
    return F.when(available & kind.isin("pdf", "epub") & (name != ""), F.concat(folder, name))
