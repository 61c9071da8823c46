"""Incremental work: staleness, hash gates, breakers, graph search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meguri.session import cut

# Days of a whole cycle, days of the promise, least and most rows of a day's batch.
CYCLE_DAYS, SLA_DAYS, LEAST_BATCH, MOST_BATCH = 28, 33, 30, 130


def stalest(rows: DataFrame, key: str, last: str, n: int) -> DataFrame:
    """The ``n`` rows seen longest ago, never-seen ones first; ties by key."""
    return rows.orderBy(F.asc_nulls_first(last), F.asc(key)).limit(n)


def baseline_batch(candidates: Column) -> Column:
    """Rows a day that see every candidate once in a cycle, within the bounds."""
    return F.greatest(F.lit(LEAST_BATCH), F.least(F.lit(MOST_BATCH), F.ceil(candidates / CYCLE_DAYS)))


def recommended_batch(candidates: Column, max_age_days: Column) -> Column:
    """The baseline, raised by how far the oldest row is behind; the most if one was never seen (null)."""
    base = baseline_batch(candidates)
    raised = F.greatest(base, F.least(F.lit(MOST_BATCH), F.ceil(base * (max_age_days / CYCLE_DAYS))))
    return F.when(max_age_days.isNull(), F.lit(MOST_BATCH)).when(max_age_days <= SLA_DAYS, base).otherwise(raised)


def age_days(moment: Column, now: str) -> Column:
    """Days from a moment to ``now``, a literal, so that a run can be repeated."""
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(moment)) / 86_400_000_000


def stale_rows(current: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``(key, reason)`` of rows to work on again: ``new``, ``incomplete`` or ``changed``.

    ``current`` has the key and ``hash``; ``known`` the key, ``complete`` and
    ``old_hash``. A complete row without an old hash only gets one.
    """
    joined = current.join(known.withColumn("_known", F.lit(True)), key, "left")
    reason = F.when(F.col("_known").isNull(), "new").when(~F.coalesce("complete", F.lit(False)), "incomplete").when(F.col("old_hash").isNotNull() & (F.col("old_hash") != F.col("hash")), "changed")
    return joined.select(key, reason.alias("reason")).filter("reason is not null")


def longest_run(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """``(key, longest_run)``: the most failures in a row of each key."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_f", F.coalesce(failed, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(by))
    runs = marked.filter("_f").groupBy(key, "_island").agg(F.count(F.lit(1)).alias("n"))
    return events.select(key).distinct().join(runs.groupBy(key).agg(F.max("n").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("longest_run"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)`` of the nodes within ``depth`` steps from the start nodes, breadth first.

    ``edges`` has ``src`` and ``dst``, ``start`` has ``node``. Each round joins
    the frontier with the edges and leaves out what was seen.
    """
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        frontier = cut(step)
        if frontier.limit(1).count() == 0:
            break
        seen = cut(seen.unionByName(frontier))
    return seen
