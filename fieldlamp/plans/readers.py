"""Queries of the readers of files: files are written from the given tables, with rows that a reader has to leave out, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path, table
from ..sources import files
from .registry import query


@query("o02_gazetteer", "select c_name as name, cast(c_custkey % 90 as double) lat, cast(c_nationkey as double) lon from customer where c_custkey % 7 <> 0")
def gazetteer(spark, d):
    """Compressed CSV; every seventh row has no latitude."""
    path = new_path(spark, "gazetteer")
    lat = F.when(F.col("c_custkey") % 7 == 0, "north").otherwise((F.col("c_custkey") % 90).cast("string"))
    rows = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("town").alias("kind"), lat.alias("lat"), F.col("c_nationkey").cast("string").alias("lon"), F.lit("").alias("region"), F.lit("").alias("postcode"))
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return files.gazetteer(spark, path).select("name", "lat", "lon")


GOLD_ROW = "case when o_orderkey % 5 = 0 then 'no query' when o_orderkey % 11 = 0 then 'nothing expected' end"


@query("o03_gold_problems", f"select {GOLD_ROW} problem, count(*) n, cast(null as bigint) ids from orders where {GOLD_ROW} is not null group by 1 union all select null, count(*), cast(sum(o_orderkey) as bigint) from orders where {GOLD_ROW} is null")
def gold_problems(spark, d):
    """JSONL; what is wrong with the lines, and what is good."""
    path, key = new_path(spark, "gold"), F.col("o_orderkey")
    expected = F.when(key % 11 == 0, F.array().cast("array<struct<url:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("/m/"), "o_orderstatus").alias("url"))))
    row = F.struct(key.cast("string").alias("id"), F.when(key % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("query"), F.col("o_orderpriority").alias("set"), expected.alias("expected"))
    table(spark, d, "orders").select(F.to_json(row).alias("value")).write.text(path)
    good, problems = files.gold(spark, path)
    wrong = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).withColumn("ids", F.lit(None).cast("long"))
    return wrong.unionByName(good.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids")).withColumn("problem", F.lit(None).cast("string")))
