"""Nearest neighbours and distance pairs on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meguri.functions.cells import haversine_m, valid
from meguri.operators.spatial import within_distance


def wkt_point(text: Column) -> Column:
    """``POINT(lng lat)`` as a struct of lat and lng; null if it is none."""
    pattern = r"(?i)^\s*POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)\s*$"
    number = lambda n: F.expr("double(null)") if n is None else F.regexp_extract(text, pattern, n).try_cast("double")
    return F.when(text.rlike(pattern), F.struct(number(2).alias("lat"), number(1).alias("lng")))


def usable_position(at: Column) -> Column:
    """A struct of lat and lng, null if it is no position on the globe."""
    return F.when(valid(at["lat"], at["lng"]), F.struct(at["lat"].alias("lat"), at["lng"].alias("lng")))


def first_position(**chain: Column) -> Column:
    """The first position of a chain of fallbacks that is not null, as a struct of lat, lng and precision, the name of its link."""
    where = F.coalesce(*chain.values())
    precision = F.coalesce(*[F.when(at.isNotNull(), F.lit(name)) for name, at in chain.items()], F.lit("none"))
    return F.struct(where["lat"].alias("lat"), where["lng"].alias("lng"), precision.alias("precision"))


def grid_pairs(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """``(left_key, right_key, distance_m)`` within ``radius_m``, of tables ``(key, lat, lng)``, at every latitude and over the date line."""
    at = lambda df: df.select("key", F.struct("lat", "lng").alias("at"))
    return within_distance(at(left), at(right), radius_m, "key", "key", "at", "at")


def nearest(pairs: DataFrame, k: int = 1) -> DataFrame:
    """Of each left key the ``k`` nearest right keys with their rank; ties by the right key."""
    order = Window.partitionBy("left_key").orderBy("distance_m", "right_key")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_centroid(points: DataFrame, centroids: DataFrame, most_m: float = 30_000.0, most_centroids: int = 5000) -> DataFrame:
    """``(key, centroid)`` of the nearest of few centroids, null beyond ``most_m``.

    The centroids are broadcast, so their number is checked; more of them
    belong into :func:`grid_pairs`.
    """
    if centroids.limit(most_centroids + 1).count() > most_centroids:
        raise ValueError(f"more than {most_centroids} centroids; use grid_pairs")
    c = centroids.select(F.col("key").alias("centroid"), F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    d = points.crossJoin(F.broadcast(c)).withColumn("d", haversine_m(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng")))
    best = d.groupBy("key").agg(F.min(F.struct("d", "centroid")).alias("b"))
    return best.select("key", F.when(F.col("b.d") <= most_m, F.col("b.centroid")).alias("centroid"))


def walk_minutes(distance_m: Column, metres_a_minute: float = 80.0) -> Column:
    """Minutes on foot, halves to the even number."""
    return F.bround(distance_m / metres_a_minute).cast("int")
