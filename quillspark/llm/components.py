"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: hang the neighbours of each node on the smallest of them.

    large: neighbours above the node; small: those below, and the node itself.
    Only minima are aggregated, so a node with very many neighbours is combined
    before the shuffle; the minima are written first, so both sides of the join
    are plain exchanges that adaptive execution can split at a hot node.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
    hung = both.join(low, "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node of its component.

    Rounds repeat until no edge changes; each is written to the shared folder,
    and only two numbers of it reach the driver.
    """
    state = cut(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        count = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if count["n"] == 0 or (count["n"], count["s"]) == mark:
            return state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        mark = (count["n"], count["s"])
        state = cut(_star(_star(state, large=True), large=False), "stars")
