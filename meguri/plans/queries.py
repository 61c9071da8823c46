"""The queries of the core library by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.operators import spatial
from meguri.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("""
    WITH a AS (SELECT DISTINCT record_id, coordinates.lat AS lat, coordinates.lng AS lng FROM attractions
               WHERE NOT isnan(coordinates.lat) AND NOT isnan(coordinates.lng) AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180),
         s AS (SELECT DISTINCT qid, coordinates.lat AS lat, coordinates.lng AS lng FROM stations
               WHERE NOT isnan(coordinates.lat) AND NOT isnan(coordinates.lng) AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180)
    SELECT DISTINCT record_id, qid AS station_qid FROM a JOIN s ON s.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01
    WHERE 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - a.lng) / 2), 2)))) <= 500
""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attraction record with each station within 500 m."""
    near = spatial.within_distance(table(spark, sf_dir, "attractions"), table(spark, sf_dir, "stations"), 500.0, "record_id", "qid")
    return near.select(F.col("left_key").alias("record_id"), F.col("right_key").alias("station_qid"))
