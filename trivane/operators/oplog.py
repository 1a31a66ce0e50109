"""Writes folded into changes: suppression, versions, running counters, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ternary as t


def effective(writes: DataFrame, *key: str) -> DataFrame:
    """Writes that change the value of their input: old and val; a fresh input is pending."""
    w = Window.partitionBy(*key).orderBy("seq")
    return writes.withColumn("old", F.coalesce(F.lag("val").over(w), F.lit(-1))).where("old <> val")


def versions(changes: DataFrame, *key: str) -> DataFrame:
    """A running count of real changes."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy(*key).orderBy("seq")).cast("long"))


def deltas(changes: DataFrame, node: str = "sub") -> DataFrame:
    """What each operation adds to a node's counters: one row a node and seq."""
    add = lambda k, n: F.sum(F.when(F.col("val") == k, 1).otherwise(0) - F.when(F.col("old") == k, 1).otherwise(0)).alias(n)
    return changes.groupBy(node, "seq").agg(add(-1, "d_neg"), add(0, "d_zero"))


def counters(changes: DataFrame, n_deps, node: str = "sub") -> DataFrame:
    """neg, zero and pos of a node's inputs after every operation; inputs never written are pending."""
    w = Window.partitionBy(node).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    c = deltas(changes, node).withColumn("neg", n_deps + F.sum("d_neg").over(w)).withColumn("zero", F.sum("d_zero").over(w))
    return c.select(node, "seq", "neg", "zero", (n_deps - F.col("neg") - F.col("zero")).alias("pos"))


def retained(counted: DataFrame, rule, n_deps, node: str = "sub") -> DataFrame:
    """The node's value after every operation: pending inputs leave the value as it was."""
    w = Window.partitionBy(node).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("eval", t.gated(rule, F.col("neg"), F.col("zero"), n_deps)).withColumn("out", F.coalesce(F.last("eval", True).over(w), F.lit(-1)))


def changes_of(valued: DataFrame, node: str = "sub", value: str = "out") -> DataFrame:
    """Rows at which a node's value changed, as (node, seq, old, val): the next level's input."""
    w = Window.partitionBy(node).orderBy("seq")
    v = valued.withColumn("_old", F.coalesce(F.lag(value).over(w), F.lit(-1)))
    return v.where(F.col("_old") != F.col(value)).select(node, "seq", F.col("_old").alias("old"), F.col(value).alias("val"))


def latest(log: DataFrame, *key: str) -> DataFrame:
    """The last row of each key by seq, combined map-side."""
    rest = [c for c in log.columns if c not in (*key, "seq")]
    g = log.groupBy(*key).agg(F.max(F.struct("seq", *rest)).alias("_l"))
    return g.select(*key, "_l.*")


def as_of(events: DataFrame, states: DataFrame, key: str, value: str) -> DataFrame:
    """Each event with the last state of its key at or before its seq (null before the first)."""
    others = [c for c in events.columns if c not in (key, "seq")]
    s = states.select(key, "seq", F.col(value).alias("_v"), F.lit(0).alias("_e"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in others])
    e = events.select(key, "seq", F.lit(None).cast(states.schema[value].dataType).alias("_v"), F.lit(1).alias("_e"), *others)
    w = Window.partitionBy(key).orderBy("seq", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(e).withColumn(value, F.last("_v", True).over(w)).where("_e = 1").drop("_e", "_v")
