"""Coverage, scores and evaluation aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weight of each dimension in a satisfaction score.
WEIGHTS = {"intent_understanding": 0.25, "factual_accuracy": 0.25, "practical_usefulness": 0.25, "specificity": 0.10, "groundedness": 0.10, "expression_quality": 0.05}


def weighted(weights: dict[str, float]) -> Column:
    """The weighted sum of the named columns; null counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()])


def coverage(facts: DataFrame, dimension: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Counts of each condition for every key of the dimension, zero where there are no facts."""
    counted = facts.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    return dimension.select(key).distinct().join(counted, key, "left").select(key, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in conditions])


def share(condition: Column) -> Column:
    """The percentage of rows that meet a condition, rounded to two digits."""
    return F.round(100.0 * F.avg(F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)), 2)


def upper_median(values: Column) -> Column:
    """The middle value, of an even number of values the upper one."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def judge_kpis(scores: DataFrame, satisfaction: Column, average: Column, passed: Column) -> DataFrame:
    """Shares of satisfied (score 4 or more), acceptable (passed and 3 or more on average) and failed rows."""
    return scores.agg(F.count(F.lit(1)).alias("n"), share(satisfaction >= 4.0).alias("satisfied_pct"), share(passed & (average >= 3.0)).alias("acceptable_pct"), share(~passed).alias("failed_pct"))


def merge_judges(scores: DataFrame, case: str, numeric: list[str], flags: list[str], label: str, judges: int) -> DataFrame:
    """One row per case that all judges scored: medians of numbers, all of flags, the commonest label (ties: the smallest)."""
    votes = scores.groupBy(case, label).agg(F.count(F.lit(1)).alias("v")).groupBy(case).agg(F.min_by(label, F.struct(-F.col("v"), F.col(label))).alias(label))
    out = scores.groupBy(case).agg(F.count(F.lit(1)).alias("votes"), *[F.median(c).alias(c) for c in numeric], *[F.every(c).alias(c) for c in flags])
    return out.filter(F.col("votes") == judges).join(votes, case)
