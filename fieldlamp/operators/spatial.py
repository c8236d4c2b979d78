"""Places: nearest features, clusters of near points, centroids. Rows carry lat and lon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..session import written


def near_pairs(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Rows of a beside rows of b within a distance, by an equi-join of grid cells: each row of b is laid into its cell
    and the eight around it; cells go round the globe, so places on both sides of 180 degrees meet. Columns must differ but for lat and lon, which become alat, alon, blat, blon."""
    degrees = metres / 111_195.0 * 1.001
    # columns of the grid are as wide as the distance at the row's own latitude band, so high latitudes need no more neighbours
    band = lambda lat: F.floor(lat / degrees)
    def column(lon: Column, y: Column) -> Column:
        edge = F.least(F.abs(y), F.abs(y + 1)) * degrees
        widest = F.greatest(edge, F.greatest(F.abs(y), F.abs(y + 1)) * degrees)
        wide = degrees / F.greatest(F.cos(F.radians(F.least(widest, F.lit(89.0)))), F.lit(math.cos(math.radians(89.0))))
        return F.floor((lon + 180) / wide), F.greatest(F.lit(1), F.floor(F.lit(360.0) / wide))  # the last cell is wider
    def own(lon: Column, y: Column) -> Column:
        at, n = column(F.pmod(lon + 180, F.lit(360.0)) - 180, y)
        return F.least(at, n - 1)

    def around(lon: Column, y: Column) -> Column:
        n = column(lon, y)[1]
        return F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(own(lon, y) + d, n)))

    x = a.withColumnsRenamed({"lat": "alat", "lon": "alon"}).withColumn("cy", band(F.col("alat")))
    x = x.withColumn("cx", own(F.col("alon"), F.col("cy")))
    y = b.withColumnsRenamed({"lat": "blat", "lon": "blon"}).withColumn("cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band(F.col("blat")) + d)))
    y = y.withColumn("cx", F.explode(around(F.col("blon"), F.col("cy"))))
    d = geo.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return x.join(y, ["cy", "cx"]).withColumn("metres", d).filter(F.col("metres") <= metres).drop("cy", "cx")


def nearest(origins: DataFrame, features: DataFrame, n: int, metres: float, kind: str, origin: str, feature: str) -> DataFrame:
    """The n nearest features of each kind within a distance of every origin. Origins at one place have the same features, and of one kind's features at
    one place only the first n can be among them, so places are compared, not rows; the origins come back by their place."""
    first = Window.partitionBy("lat", "lon", kind).orderBy(feature)
    some = features.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= n).drop("nth")
    w = Window.partitionBy("alat", "alon", kind).orderBy(F.round("metres", 0), feature)
    near = near_pairs(origins.select("lat", "lon").distinct(), some, metres).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    return origins.withColumnsRenamed({"lat": "alat", "lon": "alon"}).join(near, ["alat", "alon"])


def clusters(points: DataFrame, metres: float, by: list[str], key: str = "id") -> DataFrame:
    """(key, cluster) of all points: the smallest key reachable over points of the same name within a distance.
    Labels take their neighbours' smallest and then jump; every round is written to the shared folder."""
    a = points.select(F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in by], "lat", "lon")
    b = points.select(F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in by], "lat", "lon")
    near = near_pairs(a, b, metres)
    for c in by:
        near = near.filter(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
    edges = written(near.filter("a <> b").select("a", "b"), "near-points")
    labels = points.select(F.col(key).alias("a"), F.col(key).alias("cluster"))
    while True:
        low = edges.join(labels.select(F.col("a").alias("b"), F.col("cluster").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(low, "a", "left").select("a", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"), F.col("cluster").alias("before"))
        jump = step.select(F.col("a").alias("cluster"), F.col("cluster").alias("further"))
        new = written(step.join(jump, "cluster").select("a", F.col("further").alias("cluster"), "before"), "clusters")
        labels = new.select("a", "cluster")
        if not new.filter("cluster <> before").limit(1).count():
            return labels.withColumnRenamed("a", key)


def centroids(points: DataFrame, by: list[str], first: str, order: str) -> DataFrame:
    """Mean place of each group, with the first value (in the order of the input) of a column."""
    return points.groupBy(*by).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.min_by(first, order).alias(first), F.count(F.lit(1)).alias("n"))
