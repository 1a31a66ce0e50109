"""Nodes, edges, modes and partitions as of any position in a log of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .oplog import latest

#: Operations by wire opcode, the clock dimension each ticks, its class and its layer.
OPCODES = {1: "NodeCreate", 2: "EdgeConnect", 3: "SetValue", 4: "Propagate", 5: "Subscribe", 6: "DelNode", 7: "DelEdge", 8: "Demand", 9: "SetMode", 10: "Reflect", 11: "Stabilize", 12: "PartitionCreate", 13: "PartitionBind", 14: "SetPartitionAuthority", 15: "SetEdgeLabel", 16: "SetStabilizationConfig", 17: "SetExecutionPolicy", 18: "RegionDeclare"}
TICKS = {"dependency": (2, 5, 7), "attribute": (3, 4, 8, 10), "egraph": (11,)}  # all others tick identity
INHIBITION, REFLECTION = (6, 7, 8, 9), (10, 11)
INTERPRETATION = (3, 4, 8, 10, 11)


def op_name(op):
    out = F.lit(None).cast("string")
    for k, v in OPCODES.items():
        out = F.when(op == k, v).otherwise(out)
    return out


def clock_dim(op):
    out = F.lit("identity")
    for k, v in TICKS.items():
        out = F.when(op.isin(*v), k).otherwise(out)
    return out


def primitive_class(op):
    return F.when(op.isin(*INHIBITION), "inhibition").when(op.isin(*REFLECTION), "reflection").otherwise("extension")


def layer(op):
    return F.when(op.isin(*INTERPRETATION), "interp").otherwise("id")


def nodes(ops: DataFrame) -> DataFrame:
    """Each node's latest creation and the deletion that ended it, if any: id, rule, since_seq, until_seq."""
    made = latest(ops.where("op = 1").select(F.col("node").alias("id"), "seq", F.col("k").alias("rule")), "id").withColumnRenamed("seq", "since_seq")
    gone = ops.where("op = 6").select(F.col("node").alias("id"), F.col("seq").alias("until_seq"))
    g = made.join(gone, "id", "left").groupBy("id", "rule", "since_seq")
    return g.agg(F.min(F.when(F.col("until_seq") > F.col("since_seq"), F.col("until_seq"))).alias("until_seq"))


def edges(ops: DataFrame) -> DataFrame:
    """edge_id, src, tgt, since_seq, until_seq: an edge ends with itself or with either end's next deletion."""
    e = ops.where("op = 2").select(F.col("seq").alias("edge_id"), F.col("other").alias("src"), F.col("node").alias("tgt"), F.col("seq").alias("since_seq"))
    own = ops.where("op = 7").select((F.col("seq") - 9).alias("edge_id"), F.col("seq").alias("e_seq"))
    gone = ops.where("op = 6").select("node", "seq")
    ends = e.select("edge_id", F.col("since_seq").alias("seq"), F.explode(F.array_distinct(F.array("src", "tgt"))).alias("node"))
    cut = next_after(ends, gone, "node", "seq", "n_seq").where("n_seq is not null").groupBy("edge_id").agg(F.min("n_seq").alias("n_seq"))
    return e.join(own, "edge_id", "left").join(cut, "edge_id", "left").select("edge_id", "src", "tgt", "since_seq", F.least("e_seq", "n_seq").alias("until_seq"))


def next_after(events: DataFrame, marks: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``events`` with the first ``order`` of ``marks`` (key, order) after theirs: one ordered pass a key, no pairs."""
    others = [c for c in events.columns if c not in (key, order)]
    m = marks.select(key, order, F.col(order).alias(name), F.lit(0).alias("_e"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in others])
    e = events.select(key, order, F.lit(None).cast("long").alias(name), F.lit(1).alias("_e"), *others)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_e")).rowsBetween(Window.unboundedPreceding, 0)
    return m.unionByName(e).withColumn(name, F.last(name, True).over(w)).where("_e = 1").drop("_e")


def with_positions(live: DataFrame) -> DataFrame:
    """Positions of inputs of each target in connect order, closed up after deletions."""
    return live.withColumn("pos", (F.row_number().over(Window.partitionBy("tgt").orderBy("since_seq", "edge_id")) - 1).cast("int"))


def history(ops: DataFrame) -> DataFrame:
    """The clocks after every operation. The running counts are global, so they are computed from counts a
    stretch of the log first; only the stretches' totals are ordered in one place."""
    dims = ["identity", "attribute", "dependency", "egraph"]
    h = ops.select("seq", "op", clock_dim(F.col("op")).alias("dim"), F.expr("seq div 100000").alias("part"))
    sums = h.groupBy("part").agg(*[F.count_if(F.col("dim") == d).alias(f"n_{d}") for d in dims])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", *[F.coalesce(F.sum(f"n_{d}").over(before), F.lit(0)).alias(f"b_{d}") for d in dims])
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = h.select("seq", "op", "part", *[F.count(F.when(F.col("dim") == d, 1)).over(w).alias(f"c_{d}") for d in dims])
    out = run.join(base, "part")
    return out.select("seq", "op", *[(F.col(f"b_{d}") + F.col(f"c_{d}")).alias(f"t_{d}") for d in dims])


def mode_of_port(kind):
    return F.when(kind == "effort", "Lazy").when(kind == "flow", "Eager").when(kind == "bond", "Stabilizing")


def power(kind, v):
    """The signed value that a power port carries; signals carry none."""
    return F.when(kind != "signal", v)
