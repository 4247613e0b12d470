"""Connected components by randomised contraction, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of ``edges``; vertices of one component share a root.

    Each round maps a vertex to that neighbour (or itself) with the least
    random priority and contracts the edges.  A constant share of the vertices
    goes in each expected round, whatever the shape of the graph, so chains
    need no more rounds than stars.  Nothing but one edge count a round reaches
    the driver.  Null ends and loops are ignored.
    """
    now = stage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("w")).where("u <> w").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct(),
        "edges",
    )
    spent, steps = [now], []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("p"), c.alias("v"))
        near = both.groupBy("u").agg(F.min(rank(F.col("w"))).alias("n"))
        step = stage(near.select(F.col("u").alias("v"), F.least("n", rank(F.col("u")))["v"].alias("root")), "contraction")
        steps.append(step)
        moved = now.join(step.select(F.col("v").alias("u"), F.col("root").alias("ru")), "u").join(step.select(F.col("v").alias("w"), F.col("root").alias("rw")), "w")
        now = stage(moved.where("ru <> rw").select(F.least("ru", "rw").alias("u"), F.greatest("ru", "rw").alias("w")).distinct(), "edges")
        spent.append(now)
    drop(*spent)
    if not steps:
        return edges.select(F.col(a).alias("v"), F.col(a).alias("root")).where("false")
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("v").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("v", F.coalesce("last", "root").alias("root"))
    if len(steps) > 1:
        out = stage(out, "components")
        drop(*steps)
    return out
