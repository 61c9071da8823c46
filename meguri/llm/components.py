"""Connected components of pairwise matches, by alternating large-star and small-star rewrites.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). An edge
list is rewritten by two distributed joins until it no longer changes; then
every record hangs directly on the smallest identifier of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meguri.session import cut


def clean_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct undirected edges ``(u, v)`` with ``u > v``; null, empty and self pairs fall away."""
    a, b = F.col(f"`{left}`").cast("string"), F.col(f"`{right}`").cast("string")
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a != "").alias("_a"), (b != "").alias("_b")).filter("_a and _b and u <> v").select("u", "v").distinct()


#: A node with more than this share of all edges, and more edges than any task minds, is a hub; there are fewer than
#: twice the share's inverse of them.
HUB_SHARE, HUB_EDGES = 1 / 512, 1_000_000


def _moved(edges: DataFrame, node: str, low: DataFrame, edge_count: int) -> DataFrame:
    """``edges`` with ``m``, the smallest node around ``node``, from ``low`` ``(n, m, degree)``.

    A hub's minimum goes to the edges by broadcast, a table of fewer than
    ``2 / HUB_SHARE`` rows, so that its edges stay where they are; those of all
    other nodes are shuffled, none of which fills more than that share. With
    fewer edges than make a hub there is none, and the plan leaves that out.
    """
    if 2 * edge_count <= HUB_EDGES:
        return edges.join(low.select(F.col("n").alias(node), "m"), node).select("u", "v", "m")
    hubs = low.filter(F.col("degree") > max(edge_count * HUB_SHARE, HUB_EDGES)).select(F.col("n").alias(node), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), node, "left")
    light = marked.filter("hub_m is null").drop("hub_m").join(low.select(F.col("n").alias(node), "m"), node)
    return marked.filter("hub_m is not null").withColumnRenamed("hub_m", "m").select("u", "v", "m").unionByName(light.select("u", "v", "m"))


def _star(edges: DataFrame, large: bool, edge_count: int) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``.

    Large-star: every node links its larger neighbours to the smallest node
    around it (itself included). Small-star: the same for its smaller
    neighbours and itself. The minimum is pre-aggregated before the shuffle and
    joined back, so no neighbourhood is ever collected, and a hub is never
    shuffled to one task (:func:`_moved`).
    """
    if large:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).union(edges.select(F.col("v").alias("n"), F.col("v").alias("x")))
        low = around.groupBy("n").agg(F.min("x").alias("m"), F.count(F.lit(1)).alias("degree"))
        moved = _moved(edges, "v", low, edge_count).select("u", F.col("m").alias("v"))
    else:
        low = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        moved = _moved(edges, "u", low, edge_count).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.distinct()


def _cut(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges written out, with a fingerprint of their set, taken as they are written: the same before and after means a fixed point."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    values = seen.get
    return out, (int(values["n"]), int(values["h"] or 0))


def connected_components(pairs: DataFrame, left: str = "left_source_id", right: str = "right_source_id") -> DataFrame:
    """``(record_key, group_key)``: every record of a usable pair with its component's smallest id.

    A pair is usable if its two ids differ and neither is null or empty; ids
    are compared as strings in code-point order. Repeated and reversed pairs,
    further columns and clashing names do not matter; an empty table gives an
    empty result. The number of rounds grows with the logarithm of the longest
    chain. Lineage is cut in the shared checkpoint folder after every round.
    """
    edges, state = _cut(clean_edges(pairs, left, right))
    while state[0]:
        before = state
        edges, state = _cut(_star(_star(edges, True, before[0]), False, before[0]))
        if state == before:
            break
    roots = edges.select(F.col("v").alias("record_key"), F.col("v").alias("group_key")).distinct()
    return edges.select(F.col("u").alias("record_key"), F.col("v").alias("group_key")).unionByName(roots)
