"""Propagation level by level over a directed acyclic graph.

Each level's changes and what they bring to later levels are written to the shared folder once, so plans stay
small and a level reads only what concerns it (``engine``). The depth of the graph is the number of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop, scratch, written

STEP_LIMIT = 100_000


class StepLimitExceeded(RuntimeError):
    """Raised where a graph has a cycle or is deeper than the limit."""


def levels(edges: DataFrame, limit: int = STEP_LIMIT) -> DataFrame:
    """(node, level) of every node of (src, tgt): inputs are level 0, others one above their deepest input.

    A step takes the edges from nodes just done off those that are left and adds the nodes that have none left;
    both are written by themselves, and what is left shrinks from step to step.
    """
    spark = edges.sparkSession
    left = written(edges.select("src", "tgt").distinct(), "level-edges")
    schema, done = left.select(F.col("src").alias("node")).schema, scratch(spark, "levels")
    nodes = left.select(F.col("src").alias("node")).union(left.select("tgt")).distinct()
    nodes.join(left.select(F.col("tgt").alias("node")), "node", "left_anti").write.parquet(f"{done}/level=0")
    step = 0
    while not left.isEmpty():
        step += 1
        if step > limit:
            raise StepLimitExceeded(step)
        last = spark.read.schema(schema).parquet(f"{done}/level={step - 1}").withColumnRenamed("node", "src")
        rest = written(left.join(last, "src", "left_anti"), "level-edges")
        new = left.join(last, "src", "left_semi").select(F.col("tgt").alias("node")).distinct().join(rest.select(F.col("tgt").alias("node")), "node", "left_anti")
        new.write.parquet(f"{done}/level={step}")
        if spark.read.schema(schema).parquet(f"{done}/level={step}").isEmpty():
            raise StepLimitExceeded(f"a cycle among the nodes after step {step}")
        drop(spark, left._trivane_path)
        left = rest
    return spark.read.schema(schema.add("level", T.IntegerType())).parquet(done)


def propagate(writes: DataFrame, rules: DataFrame, edges: DataFrame, limit: int = STEP_LIMIT) -> DataFrame:
    """The change log (node, seq, old, val, level) of writes (seq, node, val) pushed through a graph that stays as it is.

    ``rules`` has (node, rule) of computed nodes, ``edges`` (src, tgt), parallel edges counted. Every node is
    evaluated at most once an operation, after all its inputs. A write to a computed node holds until
    an input of it next changes. Glitch-free, so the result does not depend on any processing order.
    """
    from . import engine

    lev = written(levels(edges, limit), "levels-all")
    top = lev.agg(F.max("level")).first()[0] or 0
    born = F.lit(engine.BORN)
    feed = engine.feed_row(rules.withColumn("ord", born), reset=F.lit(True), rule=F.col("rule"))
    feed = feed.union(engine.feed_row(writes.withColumn("ord", F.col("seq")), set=F.col("val")))
    feed = feed.join(lev, "node", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    at = lambda end, name: lev.select(F.col("node").alias(end), F.col("level").alias(name))
    known = edges.select("src", "tgt").join(at("src", "slevel"), "src").join(at("tgt", "tlevel"), "tgt")
    none = lambda kind: F.lit(None).cast(kind)
    known = known.select("*", born.alias("since"), none("long").alias("until"), F.lit(False).alias("remote"), none("int").alias("r_capability"), none("long").alias("r_scope"), none("long").alias("r_lattice"))
    rows, _ = engine.push_levels(written(feed, "level-feed"), written(known, "level-edges"), top)
    return rows.where("not reset and old <> val").select("node", F.col("ord").alias("seq"), "old", "val", "level")


def amplification(log: DataFrame) -> DataFrame:
    """Changes, writes that changed something, and their ratio."""
    a = log.agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("seq").alias("updates"))
    return a.withColumn("ratio", F.try_divide(F.col("changes").cast("double"), F.col("updates")))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, upstream: bool = True) -> DataFrame:
    """(node, depth) of all nodes reached from ``seeds`` (node) in at most ``max_depth`` steps, at least depth.

    Without ``max_depth`` steps go on until no new node appears; more than ``STEP_LIMIT`` are an error.
    """
    a, b = ("tgt", "src") if upstream else ("src", "tgt")
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "closure")
    if max_depth is None:
        edges = written(edges.select("src", "tgt").distinct(), "closure-edges")
    for depth in range(1, (STEP_LIMIT if max_depth is None else max_depth) + 1):
        last = seen.where(F.col("depth") == depth - 1)
        new = last.join(edges, last.node == edges[a]).select(F.col(b).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = written(seen.union(new), "closure", replaces=seen)
        if seen.where(F.col("depth") == depth).isEmpty():
            return seen
    if max_depth is None:
        raise StepLimitExceeded(STEP_LIMIT)
    return seen
