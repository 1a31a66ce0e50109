"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b longs): root is the smallest node reachable.

    Every round takes the smallest label among neighbours and then follows labels once more
    (pointer doubling), so chains shorten geometrically. Labels are written between rounds; the
    driver sees one number a round. Minima combine map-side, so hubs cost no more than their edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "cc-edges")
    state = table = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc")
    for _ in range(MAX_ROUNDS):
        label = state.select(F.col("node").alias("b"), "root")
        near = both.join(label, "b").groupBy("a").agg(F.min("root").alias("m"))
        step = state.join(near, state.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        table = written(step, "cc", replaces=table)
        state = table.select("node", "root")
        if table.where("old <> root").isEmpty():
            return state
    raise RuntimeError("components did not settle")
