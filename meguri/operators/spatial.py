"""Points near other points: disc covers by cell ranges, range join on sorted codes, exact refinement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meguri.functions.cells import BITS, EARTH_M, grid_x, grid_y, haversine_m, interleave, level_for, valid


def points(df: DataFrame, key: str, coordinates: str, prefix: str) -> DataFrame:
    """Distinct ``(key, lat, lng)`` of the usable positions of ``df``, under prefixed names."""
    at = F.col(f"`{coordinates}`")
    out = df.select(F.col(f"`{key}`").alias(f"{prefix}_key"), at["lat"].cast("double").alias(f"{prefix}_lat"), at["lng"].cast("double").alias(f"{prefix}_lng"))
    return out.filter(valid(F.col(f"{prefix}_lat"), F.col(f"{prefix}_lng")) & F.col(f"{prefix}_key").isNotNull()).distinct()


#: Discs wider than this many cells, those beside a pole, are joined by rows of cells instead.
WIDEST = 64


def bounds(discs: DataFrame, prefix: str, radius_m: float, level: int) -> DataFrame:
    """``discs`` with the first and last cell, of ``2**level`` grid steps, of their bounding boxes: ``x0 x1 y0 y1``.

    The box wraps at the date line (``x`` beyond the turn) and takes the whole
    turn where the disc holds a pole.
    """
    lat, lng = F.col(f"{prefix}_lat"), F.col(f"{prefix}_lng")
    angle = radius_m / EARTH_M * (1 + 1e-9) + 1e-12
    dlat = math.degrees(angle)
    # The widest longitude difference of a disc of this angle; near a pole, everything.
    ratio = F.lit(math.sin(angle)) / F.cos(F.radians(lat))
    polar = (F.abs(lat) + dlat >= 90.0) | (ratio >= 1.0)
    dlng = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    column = lambda x: F.floor((x + 180.0) / 360.0 * float(2**BITS) / 2**level).cast("long")
    x0 = column(lng - dlng)
    x1 = F.least(column(lng + dlng), x0 + 2 ** (BITS - level) - 1)
    return discs.withColumns({"x0": x0, "x1": x1, "y0": F.shiftright(grid_y(lat - dlat), level), "y1": F.shiftright(grid_y(lat + dlat), level)})


def cover(boxes: DataFrame, level: int) -> DataFrame:
    """``boxes`` with one row per covering cell range ``lo`` to ``hi`` of Z-order codes; runs of cells that follow each other on the curve are one range."""
    span, size = 2 ** (BITS - level), 4**level
    cells = F.transform(F.sequence("x0", "x1"), lambda x: F.transform(F.sequence(F.col("y0"), F.col("y1")), lambda y: interleave(F.pmod(x, F.lit(span)), y)))
    runs = F.aggregate(
        F.array_sort(F.array_distinct(F.flatten(cells))),
        F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
        lambda acc, c: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == c - 1) & (F.shiftright(F.element_at(acc, -1)["a"], 2) == F.shiftright(c, 2)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), c.alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(c.alias("a"), c.alias("b"))))),
    )
    return boxes.withColumn("_run", F.explode(runs)).select("*", (F.col("_run.a") * size).alias("lo"), ((F.col("_run.b") + 1) * size - 1).alias("hi")).drop("_run")


def within_distance(left: DataFrame, right: DataFrame, radius_m: float, left_key: str, right_key: str, left_coordinates: str = "coordinates", right_coordinates: str = "coordinates") -> DataFrame:
    """Every ``(left_key, right_key, distance_m)`` at most ``radius_m`` apart on the sphere, each pair once.

    ``right`` is the side that is covered (take the smaller one). Rows without
    a key or with a null, NaN or out-of-range position have no partner; exact
    repeats count once, while a key with several positions keeps its nearest.
    An empty table gives an empty result, further columns do not matter.

    Plan: a range never leaves the parent of its cells, so the join runs on the
    parent's code, an equality that shuffles both sides by place, with the
    range test as its condition; a place that holds much of the data is split by
    the engine's skew handling. Discs beside a pole, whose box is a whole ring
    of cells, meet the points of their rows of cells. Only then the exact
    distance is taken.
    """
    level = level_for(radius_m)
    coarse = 2 * (level + 1)
    a = points(left, left_key, left_coordinates, "l").withColumns({"code": interleave(grid_x(F.col("l_lng")), grid_y(F.col("l_lat"))), "row": F.shiftright(grid_y(F.col("l_lat")), level)})
    boxes = bounds(points(right, right_key, right_coordinates, "r"), "r", radius_m, level)
    wide = F.col("x1") - F.col("x0") > WIDEST
    b = cover(boxes.filter(~wide), level).withColumn("place", F.shiftright("lo", coarse))
    near = a.withColumn("place", F.shiftright("code", coarse)).join(b, "place").filter("code between lo and hi")
    ring = a.join(boxes.filter(wide).withColumn("row", F.explode(F.sequence("y0", "y1"))), "row")
    keep = ["l_key", "l_lat", "l_lng", "r_key", "r_lat", "r_lng"]
    distance = haversine_m(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng"))
    exact = near.select(keep).unionByName(ring.select(keep)).withColumn("distance_m", distance).filter(F.col("distance_m") <= radius_m)
    return exact.groupBy(F.col("l_key").alias("left_key"), F.col("r_key").alias("right_key")).agg(F.min("distance_m").alias("distance_m"))


def in_region(left: DataFrame, regions: DataFrame, left_key: str, region_key: str, left_coordinates: str = "coordinates", level: int = 17) -> DataFrame:
    """Every ``(left_key, region_key)`` whose point lies in the box ``south, north, west, east`` of a region, each once.

    A box with ``west > east`` crosses the date line. Boxes are covered by the
    cells of ``2**level`` grid steps they touch; the join is on cells, then the
    exact box test. Null bounds and positions match nothing.
    """
    a = points(left, left_key, left_coordinates, "l").withColumn("cell", F.shiftright(interleave(grid_x(F.col("l_lng")), grid_y(F.col("l_lat"))), 2 * level))
    box = regions.select(F.col(f"`{region_key}`").alias("region_key"), *[F.col(c).cast("double").alias(c) for c in ("south", "north", "west", "east")]).filter("south <= north and west is not null and east is not null").distinct()
    span = 2 ** (BITS - level)
    x0 = F.shiftright(grid_x(F.col("west")), level)
    x1 = F.shiftright(grid_x(F.col("east")), level) + F.when(F.col("west") > F.col("east"), F.lit(span)).otherwise(F.lit(0))
    y0, y1 = F.shiftright(grid_y(F.col("south")), level), F.shiftright(grid_y(F.col("north")), level)
    b = box.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
    b = b.withColumn("cell", interleave(F.pmod(F.col("x"), F.lit(span)), F.col("y"))).drop("x", "y").distinct()
    inside = F.col("l_lat").between(F.col("south"), F.col("north")) & F.when(F.col("west") <= F.col("east"), F.col("l_lng").between(F.col("west"), F.col("east"))).otherwise((F.col("l_lng") >= F.col("west")) | (F.col("l_lng") <= F.col("east")))
    return a.join(b, "cell").filter(inside).select(F.col("l_key").alias("left_key"), "region_key").distinct()
