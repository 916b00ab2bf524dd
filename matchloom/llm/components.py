"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. The least neighbour is found by a partial aggregate, so that a hub's edges never meet in one task."""
    if large:
        arcs = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``(node, root)`` of every node of ``links(lo, hi)``; the root is the least node of its component.

    A link to itself or with a null end is ignored. Each round is written to the shared folder; only two counts reach the
    driver. The rounds end once the edge set no longer changes.
    """
    edges = materialise(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        edges = materialise(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct().toDF("node", "root")).distinct()
        mark = now
    raise RuntimeError("the components have not settled; raise most_rounds")
