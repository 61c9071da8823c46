"""Entity resolution: decisions on near pairs, clusters, and the fold of a cluster into one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meguri.functions.text import name_similarity, normal_hotel_name, normal_phone
from meguri.session import cut

#: Name similarities from which two near hotels are one, and from which a person should look.
SAME, LIKELY = 0.90, 0.65


def match_decision(phone_a: Column, phone_b: Column, name_a: Column, name_b: Column) -> Column:
    """``confirmed``, ``review`` or null for two hotels near each other."""
    a, b = normal_phone(phone_a), normal_phone(phone_b)
    similar = name_similarity(normal_hotel_name(name_a), normal_hotel_name(name_b))
    return F.when((a != "") & (a == b), "confirmed").when(similar >= SAME, "confirmed").when(similar >= LIKELY, "review")


def clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, cluster)``: the smallest node that each node is linked with, directly or through others.

    Smallest labels spread along the edges and are then followed to their own
    label, so the rounds grow with the logarithm of the longest chain. Nodes
    without edges are clusters of their own. Raises if ``rounds`` do not do.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select(F.col("b"), F.col("a"))).filter("src <> dst").distinct()
    both = cut(both)
    labels = cut(nodes.select("node", F.col("node").alias("cluster")).distinct())
    for _ in range(rounds):
        heard = both.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("cluster").alias("heard"))
        spread = labels.join(heard, F.col("node") == F.col("dst"), "left").select("node", F.least("cluster", "heard").alias("next"), "cluster")
        own = spread.select(F.col("node").alias("_n"), F.col("next").alias("_next"))
        jumped = cut(spread.join(own, F.col("next") == F.col("_n"), "left").select("node", F.least("next", "_next").alias("next"), "cluster"))
        changed = jumped.filter("next <> cluster").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("cluster"))
        if not changed:
            return labels
    raise RuntimeError(f"clusters have not settled after {rounds} rounds")


def fold_clusters(members: DataFrame, fields: list[str]) -> DataFrame:
    """One record per cluster: the longest name, of each other field the first value by member, the members' list.

    ``members`` has ``cluster``, ``member``, ``name`` and ``fields``.
    """
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("member"))).alias(c) for c in fields]
    order = F.struct(-F.coalesce(F.length("name"), F.lit(-1)), F.col("member"))
    out = members.groupBy("cluster").agg(F.min_by("name", order).alias("name"), *first, F.count(F.lit(1)).alias("n_members"))
    return out.withColumn("confidence", F.when(F.col("n_members") > 1, "confirmed").otherwise("singleton"))
