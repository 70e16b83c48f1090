"""Connected components of a table of links by alternating star contractions.

Every step is a grouping and a join; the links shrink towards stars around the
smallest node of each component. No component is ever collected in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours, and itself, to its smallest neighbour."""
    if large:
        sides = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = sides.where(F.col("b") > F.col("a")) if large else sides
    out = near.join(least, "a").select(F.col("m").alias("a"), F.col("b"))
    if not large:
        out = out.unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of a link the smallest node it reaches. Null ends are ignored."""
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    last = None
    for _ in range(most_rounds):
        edges = stored(_star(_star(edges, large=True), large=False))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
                edges.select(F.col("a"), F.col("a")).distinct())
        last = state
    raise RuntimeError("components did not settle")
