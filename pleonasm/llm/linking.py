"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pleonasm.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free sum over them: equal states are taken as equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step that hangs neighbours of a node under the smallest of them.

    Large: those above the node. Small: those below it, and the node itself.
    """
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        hung = around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node of a link (u, v) but the smallest of its component, that smallest node.

    Each round keeps at most the links it was given, and the number of rounds grows with the logarithm of the longest
    path. Only counts come to the driver. No link, no row.
    """
    edges = cut_lineage(edges.select("u", "v").where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
