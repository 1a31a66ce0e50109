"""The op-log engine: from a log of operations to changes, values, versions, events and errors.

Three steps. (1) What does not depend on values is derived by windows: lives of nodes, lives of edges, modes,
refused operations. (2) Nodes are evaluated level by level of the dependency graph. What arrives at a node (its
own operations, changes of live inputs, edges that begin or end) is summed to one row an operation, running
counters and the last value follow by windows, and its changes are delivered to the levels of its targets.
Every level writes its own changes and deliveries and reads only what was delivered to it. A hot node's rows
are cut into stretches of the log, whose totals are carried over, so that no node has to fit one task.
(3) Demands of pending inputs and resolved sections follow from values before them. They are derived from the
log and fed back until they no longer change; as an operation is decided by earlier ones alone, that log is
the only consistent one.

An operation evaluates each node once, after all its inputs. ``ord`` is ``ROOM * seq``; what an operation's
stabilization does follows at the next numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ternary as t
from ..operators import authority as au
from ..operators import oplog, solve, topology
from ..storage import scratch, written
from .levels import STEP_LIMIT, StepLimitExceeded, levels

#: Columns of a log; those that a log lacks are null. ``other`` is the source of an edge or label, ``nodes`` what to stabilize.
FIELDS = {
    "seq": "long", "op": "int", "node": "long", "other": "long", "edge": "long", "rule": "string", "mode": "string", "port": "string", "val": "int",
    "part": "long", "lattice": "long", "capability": "int", "scope": "long", "remote": "boolean", "nodes": "array<long>",
}
ROOM = 8
#: Length of a stretch of the log, in ord.
STRETCH = 1 << 20
#: Members of a section at most: a fixed value of the operation.
SECTION = 64
FEED = {"node": "long", "ord": "long", "set": "int", "flip": "boolean", "reset": "boolean", "d_neg": "long", "d_zero": "long", "d_n": "long", "push": "boolean", "ask": "boolean", "mode": "string", "rule": "string"}
ROW = "node {0}, ord long, old int, val int, push boolean, gate boolean, reset boolean, infected boolean, flip boolean, mode string, level int"
INBOX = "node {0}, ord long, src {0}, d_neg long, d_zero long, d_n long, push boolean, violation string, gate boolean, tlevel int"
#: Before all operations: where what a graph starts with happens.
BORN = -(1 << 60)


@dataclass
class Result:
    """What a log comes to; every member is a DataFrame."""

    rows: DataFrame
    deliveries: DataFrame
    demands: DataFrame
    sections: DataFrame
    errors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    modes: DataFrame

    @property
    def changes(self) -> DataFrame:
        """(node, seq, old, val, version, level); a reflected contest changes the version alone and is left out."""
        return self._versioned().where("not reset and old <> val").select("node", _seq("ord"), "old", "val", "version", "level")

    def _versioned(self) -> DataFrame:
        w = Window.partitionBy("node").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        r = self.rows.withColumn("life", F.count(F.when(F.col("reset"), 1)).over(w))
        counts = (~F.col("reset")) & ((F.col("old") != F.col("val")) | F.col("flip"))
        return r.withColumn("version", F.count(F.when(counts, 1)).over(Window.partitionBy("node", "life").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))

    @property
    def values(self) -> DataFrame:
        """(node, val, version) of the nodes that live at the end."""
        last = self._versioned().groupBy("node").agg(F.max(F.struct("ord", "val", "version")).alias("l")).select("node", F.col("l.val").alias("val"), F.col("l.version").alias("version"))
        live = self.nodes.where("until is null").select("node").distinct()
        return live.join(last, "node", "left").select("node", F.coalesce("val", F.lit(-1)).alias("val"), F.coalesce("version", F.lit(0)).cast("long").alias("version"))

    @property
    def events(self) -> DataFrame:
        """(seq, kind, node, other, detail): the five kinds of events."""
        e = lambda d, kind, node, other, detail: d.select(_seq("ord"), F.lit(kind).alias("kind"), node.alias("node"), other.cast("long").alias("other"), detail.cast("string").alias("detail"))
        node, none = F.col("node"), F.lit(None)
        out = e(self.rows.where("not reset and old <> val"), "ValueChanged", node, none, F.concat("old", F.lit(">"), "val"))
        out = out.union(e(self.rows.where("infected"), "BochvarInfected", node, none, none))
        out = out.union(e(self.demands, "DemandFired", node, none, none))
        out = out.union(e(self.rows.where("infected and mode = 'Stabilizing'"), "StabilizeQueued", node, none, none))
        return out.union(e(self.deliveries.where("violation is not null"), "AuthViolation", node, F.col("src"), F.col("violation")))

    @property
    def statistics(self) -> DataFrame:
        """One row: what was materialized, held back and fired, and changes an effective write."""
        r = self.rows.agg(
            F.count_if(~F.col("reset") & (F.col("old") != F.col("val"))).alias("changes"),
            F.count_if(F.col("gate") & (F.col("old") != F.col("val"))).alias("nodes_materialized"),
            F.count_if("infected").alias("infections"),
            F.count_distinct(F.when(~F.col("reset") & ~F.col("gate") & (F.col("old") != F.col("val")), F.col("ord"))).alias("updates"))
        d = self.deliveries.where("d_n = 0").join(self.demands.withColumn("asked", F.lit(True)), ["node", "ord"], "left")
        d = oplog.as_of(d.withColumn("seq", F.col("ord")), self.modes.select("node", F.col("ord").alias("seq"), F.col("mode").alias("tmode")), "node", "tmode")
        lazy = F.col("push") & F.col("asked").isNull() & (F.coalesce("tmode", F.lit("Eager")) != "Eager")
        d = d.agg(F.count_if(F.col("push") & ~lazy).alias("pushes"), F.count_if(lazy).alias("pushes_suppressed_by_mode"), F.count_if(F.col("gate") & ~F.col("push")).alias("pushes_suppressed_by_authority"))
        f = self.demands.agg(F.count(F.lit(1)).alias("demands_fired"))
        one = r.crossJoin(d).crossJoin(f)  # a row each
        return one.withColumn("amplification", F.try_divide(F.col("changes").cast("double"), F.col("updates")))


def _seq(ord_: str) -> Column:
    return F.floor(F.col(ord_) / ROOM).cast("long").alias("seq")


def fielded(ops: DataFrame) -> DataFrame:
    """``ops`` with all ``FIELDS``, and ord."""
    have = set(ops.columns)
    cols = [F.col(c).cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in FIELDS.items()]
    return ops.select(*cols).withColumn("ord", F.col("seq") * ROOM)


def _alive(ops: DataFrame, deletes: DataFrame) -> DataFrame:
    """(node, since, until, ended, rule) of creations: until is the next creation or deletion."""
    e = ops.where("op = 1").select("node", "ord", F.coalesce("rule", F.lit("Input")).alias("rule")).union(deletes.select("node", "ord", F.lit(None).cast("string")))
    w = Window.partitionBy("node").orderBy("ord")
    e = e.withColumn("until", F.lead("ord").over(w)).withColumn("ended", F.col("until").isNotNull() & F.lead("rule").over(w).isNull())
    return e.where("rule is not null").select("node", F.col("ord").alias("since"), "until", "ended", "rule")


def _lives_at(events: DataFrame, alive: DataFrame, node: str) -> DataFrame:
    """``events`` with ``{node}_lives``: whether the node lives just before their ord."""
    s = alive.select(F.col("node").alias(node), F.col("since").alias("seq"), F.lit(True).alias("_l")).union(alive.where("ended").select("node", "until", F.lit(False)))
    out = oplog.as_of(events.withColumn("seq", F.col("ord")), s, node, "_l")
    return out.withColumn(f"{node}_lives", F.coalesce("_l", F.lit(False))).drop("_l", "seq")


def _next_after(events: DataFrame, marks: DataFrame, key: str, name: str) -> DataFrame:
    return topology.next_after(events, marks, key, "ord", name)


def topology_of(ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes' lives, edges' lives, changes of modes, and refused operations of a log with ``FIELDS``.

    A node cannot be deleted while a remote edge is at it, and a remote edge cannot be deleted at all.
    """
    deletes = ops.where("op = 6").select("node", "ord")
    wants = ops.where("op = 2").select("ord", F.col("other").alias("src"), F.col("node").alias("tgt"), "edge", "port", F.coalesce("remote", F.lit(False)).alias("remote"), "capability", "scope", "lattice")
    wants = written(wants, "engine-connects")
    guarded = None
    while True:  # a deletion that a remote edge forbids may let later operations through: once or twice
        alive = written(_alive(ops, deletes if guarded is None else deletes.join(guarded, ["node", "ord"], "left_anti")), "engine-lives")
        connects = written(_lives_at(_lives_at(wants, alive, "src"), alive, "tgt"), "engine-connected")
        remote = connects.where("remote and src_lives and tgt_lives").select(F.explode(F.array("src", "tgt")).alias("node"), F.col("ord").alias("at")).groupBy("node").agg(F.min("at").alias("at"))
        now = written(deletes.join(remote, "node").where("at < ord").select("node", "ord"), "engine-guarded")
        if now.isEmpty() or guarded is not None and now.join(guarded, ["node", "ord"], "left_anti").isEmpty():
            break
        guarded = now
    known = connects.where("src_lives and tgt_lives")
    cut = ops.where("op = 7").select("edge", "ord")
    spare = known.where("remote and edge is not null").select("edge").distinct()
    e = _next_after(known.where("edge is not null").withColumn("since", F.col("ord")), cut.join(spare, "edge", "left_anti"), "edge", "cut")
    plain = known.where("edge is null").withColumn("since", F.col("ord")).withColumn("cut", F.lit(None).cast("long"))
    subs = ops.where("op = 5").select("ord", F.col("other").alias("src"), F.col("node").alias("tgt"), F.col("ord").alias("since"))
    e = e.unionByName(plain).unionByName(subs, allowMissingColumns=True)
    gone = alive.where("ended").select("node", F.col("until").alias("ord"))
    for end in ("src", "tgt"):
        e = _next_after(e, gone.withColumnRenamed("node", end), end, f"{end}_end")
    e = e.select("src", "tgt", "since", F.least("cut", "src_end", "tgt_end").alias("until"), F.coalesce("remote", F.lit(False)).alias("remote"), "port",
                 F.col("capability").alias("r_capability"), F.col("scope").alias("r_scope"), F.col("lattice").alias("r_lattice"))
    edges = written(e, "engine-edges")
    # Modes: a creation or SetMode sets one, a port prefers one where the mode is still Eager.
    named = _lives_at(ops.where("op in (3, 9, 10)").select("ord", "op", "node", "val", "mode"), alive, "node")
    named = written(named, "engine-named")
    m = alive.select("node", F.col("since").alias("ord"), F.lit("Eager").alias("base"), F.lit(None).cast("string").alias("wish"))
    m = m.union(named.where("op = 9 and node_lives").select("node", "ord", "mode", F.lit(None).cast("string")))
    m = m.union(known.select("tgt", "ord", F.lit(None).cast("string"), topology.mode_of_port(F.col("port"))).where("port is not null"))
    w = Window.partitionBy("node").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("seg", F.count("base").over(w)).withColumn("base", F.coalesce(F.last("base", True).over(w), F.lit("Eager")))
    first = F.first(F.when(F.col("wish") != "Eager", F.col("wish")), True).over(Window.partitionBy("node", "seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    modes = m.select("node", "ord", F.when(F.col("base") != "Eager", F.col("base")).otherwise(F.coalesce(first, F.lit("Eager"))).alias("mode"))
    refused = named.where("not node_lives").select("ord", "op", "node", F.lit("NodeNotFound").alias("reason"))
    refused = refused.union(connects.where("not src_lives").select("ord", F.lit(2), "src", F.lit("NodeNotFound")))
    refused = refused.union(connects.where("src_lives and not tgt_lives").select("ord", F.lit(2), "tgt", F.lit("NodeNotFound")))
    if guarded is not None:
        refused = refused.union(guarded.select("ord", F.lit(6), "node", F.lit("DpoViolation")))
    held = cut.join(spare, "edge").join(known.where("remote").groupBy("edge").agg(F.min("ord").alias("since")), "edge").where("ord > since")
    refused = refused.union(held.select("ord", F.lit(7), "edge", F.lit("DpoViolation")))
    return alive, edges, modes, refused


def _feed(ops: DataFrame, alive: DataFrame, modes: DataFrame, edges: DataFrame) -> DataFrame:
    """What happens at nodes by operations on themselves."""
    born = feed_row(alive.withColumn("ord", F.col("since")), reset=F.lit(True), rule=F.col("rule"))
    born = born.union(feed_row(alive.where("ended").withColumn("ord", F.col("until")), reset=F.lit(True), rule=F.lit("Input")))  # nothing evaluates it any more
    sets = _lives_at(ops.where("op in (3, 10)").select("ord", "op", "node", "val"), alive, "node").where("node_lives")
    out = born.union(feed_row(sets.where("op = 3"), set=F.col("val"))).union(feed_row(sets.where("op = 10"), flip=F.lit(True)))
    return out.union(feed_row(modes, mode=F.col("mode"))).union(feed_row(ops.where("op = 4").select("node", "ord"), ask=F.lit(True)))


def _carried(rows: DataFrame, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """Running sums and last non-null values up to each row of its node, a stretch at a time with what came before."""
    key, w = ["node", "part"], Window.partitionBy("node", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*key).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(F.when(c.isNotNull(), F.struct("ord", c.alias("v")))).getField("v").alias(f"_{n}") for n, c in lasts.items()])
    b = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*key, *[F.coalesce(F.sum(f"_{n}").over(b), F.lit(0)).alias(f"_{n}") for n in sums], *[F.last(f"_{n}", True).over(b).alias(f"_{n}") for n in lasts])
    out = rows.select("*", *[F.sum(c).over(w).alias(f"_w_{n}") for n, c in sums.items()], *[F.last(c, True).over(w).alias(f"_w_{n}") for n, c in lasts.items()]).join(before, key)
    made = {n: F.col(f"_w_{n}") + F.col(f"_{n}") for n in sums} | {n: F.coalesce(f"_w_{n}", f"_{n}") for n in lasts}
    return out.select(*[c for c in rows.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def evaluate(feed: DataFrame, level: int) -> DataFrame:
    """Rows (``ROW``) of the nodes of a level from what arrives at them (``FEED``): changes, pushes, infections."""
    zero = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    some = lambda n: F.coalesce(F.max(n), F.lit(False)).alias(n)
    r = feed.withColumn("part", F.expr(f"ord div {STRETCH}")).repartition(F.col("node"), F.col("part")).groupBy("node", "part", "ord").agg(
        F.max("set").alias("set"), *[some(n) for n in ("flip", "reset", "push", "ask")], *[zero(n) for n in ("d_neg", "d_zero", "d_n")], F.max("mode").alias("m"), F.max("rule").alias("r"))
    r = _carried(r, {"neg": F.col("d_neg"), "zero": F.col("d_zero"), "n": F.col("d_n")}, {"mode": F.col("m"), "rule": F.col("r")})
    mode = F.coalesce("mode", F.lit("Eager"))
    able = F.coalesce(F.col("rule") != "Input", F.lit(False))
    r = r.withColumn("mode", mode).withColumn("trig", able & (F.col("ask") | F.col("push") & (mode == "Eager")))
    r = r.withColumn("eval", F.when(F.col("trig"), t.gated(F.col("rule"), F.col("neg"), F.col("zero"), F.col("n"))))
    # A resolved section outlasts what is evaluated in Stabilizing mode; otherwise evaluation comes last.
    put = F.when(F.col("reset"), -1).when(F.col("mode") == "Stabilizing", F.coalesce("set", "eval")).otherwise(F.coalesce("eval", "set"))
    r = r.withColumn("put", put).drop("neg", "zero", "n", "d_neg", "d_zero", "d_n", "m", "r")
    # The value after a row: the last put, turned once for every later flip. What a stretch does not put comes from before.
    w, whole = Window.partitionBy("node", "part").orderBy("ord"), Window.partitionBy("node").orderBy("part")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = lambda flips: F.when(flips % 2 == 0, 1).otherwise(-1)
    r = r.withColumn("flips", F.sum(F.col("flip").cast("int")).over(upto))
    r = r.withColumn("at", F.last(F.when(F.col("put").isNotNull(), F.struct(F.col("put").alias("v"), F.col("flips").alias("f"))), True).over(upto))
    r = r.withColumn("here", F.col("at.v") * sign(F.col("flips") - F.col("at.f")))
    ends = r.groupBy("node", "part").agg(F.max(F.struct("ord", "here", "flips")).alias("e")).select("node", "part", "e.here", "e.flips")
    ends = ends.withColumn("all", F.sum("flips").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("last", F.last(F.when(F.col("here").isNotNull(), F.struct(F.col("here").alias("v"), F.col("all").alias("f"))), True).over(whole.rowsBetween(Window.unboundedPreceding, -1)))
    base = F.coalesce(F.col("last.v"), F.lit(-1)) * sign(F.col("all") - F.col("flips") - F.coalesce(F.col("last.f"), F.lit(0)))
    r = r.join(ends.select("node", "part", base.alias("before")), ["node", "part"])
    r = r.withColumn("val", F.coalesce(F.col("here"), F.col("before") * sign(F.col("flips"))).cast("int"))
    r = r.withColumn("old", F.coalesce(F.lag("val").over(w), F.col("before")).cast("int"))
    infected = F.coalesce(F.col("trig") & (F.col("eval") == 0), F.lit(False))
    changed = F.col("old") != F.col("val")
    gate = F.col("trig") & F.col("eval").isNotNull()
    push = ~F.col("reset") & F.when(infected & (F.col("mode") != "Stabilizing"), F.col("mode") == "Eager").when(infected, F.col("val") != 0).otherwise(changed | F.col("flip"))
    r = r.select("node", "ord", "old", "val", push.alias("push"), gate.alias("gate"), "reset", infected.alias("infected"), "flip", "mode", F.lit(level).alias("level"))
    return r.where("old <> val or push or infected or reset")


def _authority(ops: DataFrame, mode: str) -> dict[str, DataFrame] | None:
    """Labels, bindings and partitions by ord; None where nothing is gated."""
    if mode == "Advisory":
        return None
    labels = ops.where("op = 15").select("other", "node", F.col("ord").alias("seq"), F.struct(F.coalesce("lattice", F.lit(0)).alias("lattice"), F.coalesce("capability", F.lit(au.ALL_CAPABILITIES)).alias("capability"), F.coalesce("scope", F.lit(au.UNIVERSAL)).alias("scope")).alias("label"))
    bound = ops.where("op = 13").select("node", F.col("ord").alias("seq"), "part")
    made = ops.where("op = 12").groupBy("part").agg(F.min("ord").alias("made"))
    decl = ops.where("op in (12, 14)").join(made, "part").where("ord >= made").select("part", F.col("ord").alias("seq"), F.coalesce("lattice", F.lit(0)).alias("class"))
    return {"labels": written(labels.withColumn("pair", F.concat_ws(">", "other", "node")).drop("other", "node"), "engine-labels"), "bound": written(bound.withColumnRenamed("node", "src"), "engine-bound"), "decl": written(decl, "engine-decl")}


def _deliver(rows: DataFrame, edges: DataFrame, auth, mode: str, unbound: str) -> DataFrame:
    """What a level's rows and the lives of edges from its nodes bring to targets."""
    is_ = lambda c, k: (c == k).cast("long")
    e = edges.withColumnRenamed("src", "node")
    j = rows.join(e, "node").where("ord > since and (until is null or ord < until)")
    j = j.select(F.col("tgt"), "tlevel", "ord", F.col("node").alias("src"), (is_(F.col("val"), -1) - is_(F.col("old"), -1)).alias("d_neg"), (is_(F.col("val"), 0) - is_(F.col("old"), 0)).alias("d_zero"),
                 F.lit(0).cast("long").alias("d_n"), "push", (F.col("push") & F.col("gate")).alias("gate"), "remote", "r_capability", "r_scope", "r_lattice")
    j = j.withColumn("violation", F.lit(None).cast("string"))
    if auth is not None:
        a = j.where("gate").withColumn("seq", F.col("ord")).withColumn("pair", F.concat_ws(">", "src", "tgt"))
        a = oplog.as_of(a, auth["labels"], "pair", "label")
        a = oplog.as_of(a, auth["bound"], "src", "part")
        some = a.where("part is not null")
        a = oplog.as_of(some, auth["decl"], "part", "class").unionByName(a.where("part is null").withColumn("class", F.lit(None).cast("long")))
        cap, scope = F.coalesce("label.capability", F.lit(au.ALL_CAPABILITIES)), F.coalesce("label.scope", F.lit(au.UNIVERSAL))
        sent = lambda own, field: F.when(F.col("remote"), F.coalesce(field, own)).otherwise(own)
        reason = au.gates.authority_reason(cap, scope, F.coalesce("label.lattice", F.lit(0)), sent(cap, "r_capability"), sent(scope, "r_scope"), F.when(F.col("remote"), F.coalesce("r_lattice", "class")).otherwise(F.col("class")))
        reason = F.when(F.col("class").isNull() & ~F.col("remote"), "UnboundSource").otherwise(reason)
        passes, audited = au.decide(F.col("why"), mode, unbound)
        a = a.withColumn("why", reason).withColumn("push", passes).withColumn("violation", F.when(audited, F.col("why")))
        j = j.where("not gate").unionByName(a.select(*j.columns))
    # Edges bring the value that their source has where they begin, and take it where they end.
    states = rows.select("node", F.col("ord").alias("seq"), "val")
    spans = e.select("node", F.col("since").alias("seq"), "tgt", "tlevel", F.lit(1).cast("long").alias("d_n")).union(e.where("until is not null").select("node", F.col("until") - 1, "tgt", "tlevel", F.lit(-1).cast("long")))
    v = oplog.as_of(spans, states, "node", "val").withColumn("val", F.coalesce("val", F.lit(-1)))
    v = v.select("tgt", "tlevel", F.when(F.col("d_n") > 0, F.col("seq")).otherwise(F.col("seq") + 1).alias("ord"), F.col("node").alias("src"), (is_(F.col("val"), -1) * F.col("d_n")).alias("d_neg"), (is_(F.col("val"), 0) * F.col("d_n")).alias("d_zero"), "d_n", F.lit(False).alias("push"), F.lit(None).cast("string").alias("violation"), F.lit(False).alias("gate"))
    out = j.select("tgt", "tlevel", "ord", "src", "d_neg", "d_zero", "d_n", "push", "violation", "gate").unionByName(v)
    return out.withColumnRenamed("tgt", "node")


def feed_row(d: DataFrame, **values: Column) -> DataFrame:
    """``d`` (node, ord) as rows of what happens at nodes."""
    kind = d.schema["node"].dataType
    col = lambda n: values[n] if n in values else F.col(n) if n in ("node", "ord") else F.lit(None)
    return d.select(*[col(n).cast(kind if n == "node" else k).alias(n) for n, k in FEED.items()])


def push_levels(feed: DataFrame, edges: DataFrame, top: int, auth=None, mode: str = "Advisory", unbound: str = "Allow") -> tuple[DataFrame, DataFrame]:
    """All levels once: rows and deliveries. ``feed`` has level, ``edges`` the levels of both ends."""
    spark, kind = feed.sparkSession, feed.schema["node"].dataType.simpleString()
    row, box = ROW.format(kind), INBOX.format(kind)
    log, inbox = scratch(spark, "engine-log"), scratch(spark, "engine-inbox")
    for k in range(top + 1):
        own = feed.where(F.col("level") == k).select(*FEED)
        if k:
            got = spark.read.schema(box).parquet(inbox).where(F.col("tlevel") == k)
            own = own.unionByName(got.select("node", "ord", "d_neg", "d_zero", "d_n", "push"), allowMissingColumns=True)
        evaluate(own, k).drop("level").write.parquet(f"{log}/level={k}")
        if k < top:
            rows = spark.read.schema(row).parquet(f"{log}/level={k}")
            _deliver(rows, edges.where(F.col("slevel") == k), auth, mode, unbound).write.mode("append").partitionBy("tlevel").parquet(inbox)
    rows = spark.read.schema(row).parquet(log)
    if not top:
        return rows, spark.createDataFrame([], box)
    return rows, spark.read.schema(box).parquet(inbox)


def _before(at: DataFrame, rows: DataFrame, node: str = "node") -> DataFrame:
    """``at`` (ord, node, ...) with the node's value just before ord."""
    s = rows.select(F.col("node").alias(node), (F.col("ord") + 1).alias("seq"), "val").join(at.select(node).distinct(), node, "left_semi")
    return oplog.as_of(at.withColumn("seq", F.col("ord")), s, node, "val").withColumn("val", F.coalesce("val", F.lit(-1))).drop("seq")


def _inputs(at: DataFrame, edges: DataFrame) -> DataFrame:
    """Live inputs (ord, node, src, since) of nodes at an ord."""
    e = edges.select(F.col("tgt").alias("node"), "src", "since", "until")
    return at.join(e, "node").where("since < ord and (until is null or until > ord)").drop("until")


def _demanded(roots: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(ord, node): demanded nodes, their pending inputs, theirs, and so on, by values before the demand."""
    spark, base, step = roots.sparkSession, scratch(roots.sparkSession, "engine-demands"), 0
    roots.select("ord", "node").distinct().write.parquet(f"{base}/step=0")
    read = lambda p: spark.read.schema("ord long, node long").parquet(p).select("ord", "node")
    while True:
        near = _inputs(read(f"{base}/step={step}"), edges).select("ord", F.col("src").alias("node")).distinct()
        new = _before(near, rows).where("val = -1").select("ord", "node").join(read(base), ["ord", "node"], "left_anti")
        step += 1
        new.write.parquet(f"{base}/step={step}")
        if read(f"{base}/step={step}").isEmpty():
            return read(base)
        if step > STEP_LIMIT:
            raise StepLimitExceeded(step)


def _sections(seeds: DataFrame, edges: DataFrame, rows: DataFrame, alive: DataFrame) -> DataFrame:
    """(ord, node, outcome, val): members of each operation's section and what it comes to; val null unless accepted."""
    members = written(_before(seeds, rows).withColumn("depth", F.lit(0)), "engine-section")
    last = members
    for depth in range(1, SECTION + 1):  # every step adds a member, so there are no more steps than members
        near = _inputs(last.select("ord", "node"), edges).select("ord", F.col("src").alias("node")).distinct()
        new = _before(near, rows).where("val = 0").join(members, ["ord", "node"], "left_anti").withColumn("depth", F.lit(depth))
        last = written(new, "engine-section-step")
        if last.isEmpty():
            break
        members = written(members.unionByName(last), "engine-section", replaces=members)
    w = Window.partitionBy("ord").orderBy("depth", "node")
    members = members.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SECTION).drop("k", "depth")
    rule = alive.select("node", F.col("since").alias("seq"), "rule")
    members = written(oplog.as_of(members.withColumn("seq", F.col("ord")), rule, "node", "rule").drop("seq"), "engine-members")
    deps = _inputs(members.select("ord", "node"), edges)
    deps = _before(deps, rows, "src").groupBy("ord", "node").agg(F.array_sort(F.collect_list(F.struct("since", "src", "val"))).alias("deps"))
    m = members.join(deps, ["ord", "node"], "left").select("ord", "node", "val", F.coalesce("rule", F.lit("Input")).alias("rule"), F.col("deps.src").alias("srcs"), F.col("deps.val").alias("vals"))

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        rows_ = {int(n): (int(v), r, [] if s is None else [int(x) for x in s], [] if x is None else [int(y) for y in x]) for n, v, r, s, x in zip(g["node"], g["val"], g["rule"], g["srcs"], g["vals"], strict=True)}
        outcome, value = solve.settle(rows_)
        contested = [n for n, (v, *_) in rows_.items() if v == 0]
        return pd.DataFrame({"ord": g["ord"].iloc[0], "node": contested, "outcome": outcome, "val": pd.array([value] * len(contested), dtype="Int32")})

    return m.groupBy("ord").applyInPandas(settle, "ord long, node long, outcome string, val int")


def run(ops: DataFrame, authority: str = "Advisory", unbound: str = "Allow", limit: int = STEP_LIMIT) -> Result:
    """Apply a log (``FIELDS``; seq distinct, null operands where an operation has none).

    ``authority`` is Advisory, Audit or Enforced, ``unbound`` the policy for sources without partition. A log
    whose edges, taken over all time, form a cycle raises ``StepLimitExceeded``. Operations on nodes that do not
    live, and deletions that would break a remote edge, are refused and listed in errors. An empty log
    comes to nothing.
    """
    spark = ops.sparkSession
    ops = written(fielded(ops), "engine-ops")
    alive, edges, modes, refused = topology_of(ops)
    refused = written(refused.select(_seq("ord"), "op", "node", "reason"), "engine-errors")
    computed = alive.where("rule <> 'Input'").select(F.col("node").alias("tgt")).distinct()
    edges = written(edges.join(computed, "tgt", "left_semi"), "engine-edges")
    lev = written(levels(edges, limit), "engine-levels")
    top = lev.agg(F.max("level")).first()[0] or 0
    edges = edges.join(lev.select(F.col("node").alias("src"), F.col("level").alias("slevel")), "src").join(lev.select(F.col("node").alias("tgt"), F.col("level").alias("tlevel")), "tgt")
    edges = written(edges, "engine-edges")
    base = written(_feed(ops, alive, modes, edges), "engine-feed")
    auth = _authority(ops, authority)
    roots = ops.where("op = 8").select("ord", "node")
    asks = ops.where("op = 11").select("ord", F.explode_outer(F.coalesce("nodes", F.array("node"))).alias("node"))
    waits = not roots.isEmpty() or not asks.isEmpty() or not modes.where("mode = 'Stabilizing'").isEmpty()
    demands = written(roots.distinct(), "engine-demanded")
    sections = spark.createDataFrame([], "ord long, node long, outcome string, val int")
    while True:
        more = demands.select("node", "ord", F.lit(True).alias("ask")).unionByName(sections.where("val is not null").select("node", "ord", F.col("val").alias("set")), allowMissingColumns=True)
        feed = base.unionByName(more, allowMissingColumns=True).join(lev, "node", "left").withColumn("level", F.coalesce("level", F.lit(0)))
        rows, inbox = push_levels(written(feed, "engine-fed"), edges, top, auth, authority, unbound)
        if waits:
            asked = written(_demanded(roots, edges, rows), "engine-demanded")
            # Stabilize asks for its node, or for all that is contested; a contest in Stabilizing mode for itself and its inputs.
            every = asks.where("node is null").select("ord")
            seeds = asks.where("node is not null").select("ord", "node")
            if not every.isEmpty():
                spans = rows.withColumn("until", F.lead("ord").over(Window.partitionBy("node").orderBy("ord"))).where("val = 0")
                ended = _next_after(spans.select("node", "ord", "until"), alive.where("ended").select("node", F.col("until").alias("ord")), "node", "dies")
                seeds = seeds.union(every.withColumnRenamed("ord", "at").join(ended, (F.col("at") > F.col("ord")) & (F.least("until", "dies").isNull() | (F.col("at") <= F.least("until", "dies")))).select("at", "node"))
            queued = rows.where(f"infected and mode = 'Stabilizing' and pmod(ord, {ROOM}) < {ROOM - 1}").select((F.col("ord") + 1).alias("ord"), "node")
            seeds = seeds.union(queued).union(_inputs(queued, edges).select("ord", F.col("src").alias("node"))).distinct()
            found = written(_sections(seeds, edges, rows, alive), "engine-sections")
            same = lambda a, b, on: a.join(b, on, "left_anti").isEmpty() and b.join(a, on, "left_anti").isEmpty()
            key = lambda d: d.where("val is not null").select("ord", "node", "val")
            settled = same(asked, demands, ["ord", "node"]) and same(key(found), key(sections), ["ord", "node", "val"])
            demands, sections = asked, found
            if not settled:
                continue
        return Result(rows, inbox, demands, sections, refused, alive, edges, modes)
