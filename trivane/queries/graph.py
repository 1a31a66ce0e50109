"""C and Q: definition and mutation of graphs, read from a log of operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ternary as t
from ..operators import oplog, topology
from .base import EFFECTIVE, OPS, Registry, ops, table, writes

R = Registry()
#: The log is 10,000 operations times the scale; snapshots are taken in its middle.
MID = 5000
LAST = "(SELECT {k}, max_by(struct_pack({f}), seq) AS l, max(seq) AS seq FROM ops WHERE {w} GROUP BY {k})"


def _latest(name, op, key, **cols):
    names = ", ".join(cols)
    fields = ", ".join(f"{n} := {c}" for n, c in cols.items())
    keys = ", ".join(key)
    sql = f"WITH {OPS}, l AS {LAST.format(k=keys, f=fields, w=f'op = {op}')} SELECT {keys}, seq, {', '.join(f'l.{n} AS {n}' for n in cols)} FROM l"

    def run(spark, sf_dir):
        o = ops(spark, sf_dir).where(F.col("op") == op).select(*key, "seq", *[F.expr(c).alias(n) for n, c in cols.items()])
        return oplog.latest(o, *key)

    run.__doc__ = f"Latest {names} of each {keys}."
    R(name, sql)(run)


_NODES = f"""{OPS}, made AS (SELECT node AS id, max(seq) AS since_seq, max_by(k, seq) AS rule FROM ops WHERE op = 1 GROUP BY node),
    nodes AS (SELECT id, rule, since_seq, (SELECT min(seq) FROM ops WHERE op = 6 AND node = id AND seq > since_seq) AS until_seq FROM made)"""
_EDGES = f"""{OPS}, e AS (SELECT seq AS edge_id, other AS src, node AS tgt, seq AS since_seq FROM ops WHERE op = 2),
    edges AS (SELECT edge_id, src, tgt, since_seq, least((SELECT min(seq) FROM ops WHERE op = 7 AND seq - 9 = edge_id), (SELECT min(seq) FROM ops WHERE op = 6 AND node IN (src, tgt) AND seq > since_seq)) AS until_seq FROM e)"""
_LIVE = "since_seq <= {0} AND (until_seq IS NULL OR until_seq > {0})"

R("c1_node_create", f"WITH {_NODES} SELECT * FROM nodes")(lambda s, d: topology.nodes(ops(s, d)))
R("c2_edge_connect", f"WITH {_EDGES} SELECT edge_id, src, tgt, since_seq, (row_number() OVER (PARTITION BY tgt ORDER BY since_seq, edge_id) - 1)::INT AS pos FROM edges WHERE until_seq IS NULL")(
    lambda s, d: topology.with_positions(topology.edges(ops(s, d)).where("until_seq IS NULL").drop("until_seq")))
R("c3_subscribe", f"WITH {OPS} SELECT CASE WHEN op = 2 THEN seq END AS edge_id, other AS src, node AS tgt, seq FROM ops WHERE op IN (2, 5)")(
    lambda s, d: ops(s, d).where("op in (2, 5)").select(F.when(F.col("op") == 2, F.col("seq")).alias("edge_id"), F.col("other").alias("src"), F.col("node").alias("tgt"), "seq"))
_SET = f"{OPS}, s AS (SELECT seq, node, val, coalesce(lag(val) OVER (PARTITION BY node ORDER BY seq), -1) AS old FROM ops WHERE op = 3)"
R("c4_set_value", f"WITH {_SET} SELECT node, seq, old, val FROM s WHERE old <> val")(lambda s, d: oplog.effective(ops(s, d).where("op = 3").select("node", "seq", "val"), "node").select("node", "seq", "old", "val"))
R("c5_propagate_triggers", f"WITH {OPS} SELECT node, seq, op = 4 AS forced FROM ops WHERE op IN (3, 4)")(lambda s, d: ops(s, d).where("op in (3, 4)").select("node", "seq", (F.col("op") == 4).alias("forced")))
R("c6_del_node", f"WITH {_EDGES} SELECT edge_id, src, tgt, until_seq FROM edges WHERE until_seq IN (SELECT seq FROM ops WHERE op = 6)")(
    lambda s, d: topology.edges(ops(s, d)).join(ops(s, d).where("op = 6").select(F.col("seq").alias("until_seq")), "until_seq", "left_semi").select("edge_id", "src", "tgt", "until_seq"))
R("c7_del_edge", f"WITH {_EDGES} SELECT edge_id, until_seq FROM edges WHERE until_seq IN (SELECT seq FROM ops WHERE op = 7)")(
    lambda s, d: topology.edges(ops(s, d)).join(ops(s, d).where("op = 7").select(F.col("seq").alias("until_seq")), "until_seq", "left_semi").select("edge_id", "until_seq"))
_ASOF = "SELECT d.node, d.seq, (SELECT max_by({v}, o.seq) FROM ops o WHERE o.op = {o} AND o.node = d.node AND o.seq <= d.seq) AS {n} FROM ops d WHERE d.op = {d}"


def _asof(event, state, expr, name):
    def run(spark, sf_dir):
        o = ops(spark, sf_dir)
        return oplog.as_of(o.where(F.col("op") == event).select("node", "seq"), o.where(F.col("op") == state).select("node", "seq", F.expr(expr).alias(name)), "node", name)

    return run


R("c8_demand", f"WITH {OPS} " + _ASOF.format(v="val", o=3, n="val", d=8))(_asof(8, 3, "val", "val"))
R("c9_set_mode", f"WITH {OPS} " + _ASOF.format(v="k % 3", o=9, n="mode", d=3))(_asof(3, 9, "k % 3", "mode"))


@R("c10_reflect", f"""WITH {OPS}, m AS (SELECT seq, node, op, CASE WHEN op = 3 THEN val END AS w, count(*) FILTER (WHERE op = 3) OVER (PARTITION BY node ORDER BY seq) AS grp FROM ops WHERE op IN (3, 10)),
    p AS (SELECT seq, node, op, coalesce(max(w) OVER (PARTITION BY node, grp), -1) AS base, count(*) FILTER (WHERE op = 10) OVER (PARTITION BY node, grp ORDER BY seq) AS flips FROM m)
    SELECT seq, node, (CASE WHEN flips % 2 = 1 THEN -base ELSE base END)::INT AS val FROM p WHERE op = 10""")
def reflect(spark, sf_dir):
    """Reflection negates: the parity of reflections since the last write decides."""
    o = ops(spark, sf_dir).where("op in (3, 10)")
    w = Window.partitionBy("node").orderBy("seq")
    o = o.withColumn("grp", F.count(F.when(F.col("op") == 3, 1)).over(w))
    g = Window.partitionBy("node", "grp")
    o = o.withColumn("base", F.coalesce(F.max(F.when(F.col("op") == 3, F.col("val"))).over(g), F.lit(-1)))
    o = o.withColumn("flips", F.count(F.when(F.col("op") == 10, 1)).over(g.orderBy("seq")))
    return o.where("op = 10").select("seq", "node", F.when(F.col("flips") % 2 == 1, t.mv_neg(F.col("base"))).otherwise(F.col("base")).cast("int").alias("val"))


R("c11_stabilize", f"WITH {OPS} SELECT seq, CASE WHEN k % 2 = 0 THEN node END AS seed FROM ops WHERE op = 11")(
    lambda s, d: ops(s, d).where("op = 11").select("seq", F.when(F.col("k") % 2 == 0, F.col("node")).alias("seed")))
_latest("c12_partition_create", 12, ["node"], root="other", lattice="k")
_latest("c14_set_partition_authority", 14, ["node"], lattice="k")
_latest("c15_set_edge_label", 15, ["other", "node"], lattice="k % 16")
_latest("c16_stabilization_config", 16, ["node"], strategy="k % 4")
_latest("c17_execution_policy", 17, ["node"], priority="k % 3")
_latest("c18_region_declare", 18, ["node"], boundary="k % 3")


@R("c13_partition_bind", f"WITH {OPS} SELECT node, max_by(k % 7, seq) AS part, bit_and(8 + k % 8) AS scope, count(*) AS bindings FROM ops WHERE op = 13 GROUP BY node")
def bind(spark, sf_dir):
    """The latest partition, and the scope that all bindings so far have narrowed to."""
    o = ops(spark, sf_dir).where("op = 13")
    return o.groupBy("node").agg(F.max_by(F.expr("k % 7"), "seq").alias("part"), F.expr("bit_and(8 + k % 8)").alias("scope"), F.count(F.lit(1)).alias("bindings"))


_PORT = "CASE k % 4 WHEN 0 THEN 'signal' WHEN 1 THEN 'effort' WHEN 2 THEN 'flow' ELSE 'bond' END"


@R("c19_port_mode", f"""WITH {OPS}, p AS (SELECT node, seq, CASE {_PORT} WHEN 'effort' THEN 'Lazy' WHEN 'bond' THEN 'Stabilizing' END AS mode FROM ops WHERE op = 2)
    SELECT node, coalesce(min_by(mode, seq) FILTER (WHERE mode IS NOT NULL), 'Eager') AS mode FROM p GROUP BY node""")
def port_mode(spark, sf_dir):
    """The first port that asks for another mode than Eager decides."""
    o = ops(spark, sf_dir).where("op = 2").select("node", "seq", topology.mode_of_port(F.expr(_PORT)).alias("mode"))
    return o.groupBy("node").agg(F.coalesce(F.min_by("mode", F.when(F.col("mode") != "Eager", F.col("seq"))), F.lit("Eager")).alias("mode"))


_NAME = "([" + ", ".join(f"'{v}'" for v in topology.OPCODES.values()) + "])[op]"
R("c20_op_classes", f"""WITH {OPS} SELECT seq, {_NAME} AS name, CASE WHEN op IN (6, 7, 8, 9) THEN 'inhibition' WHEN op IN (10, 11) THEN 'reflection' ELSE 'extension' END AS class,
    CASE WHEN op IN (3, 4, 8, 10, 11) THEN 'interp' ELSE 'id' END AS layer FROM ops""")(
    lambda s, d: ops(s, d).select("seq", topology.op_name(F.col("op")).alias("name"), topology.primitive_class(F.col("op")).alias("class"), topology.layer(F.col("op")).alias("layer")))
R("c22_dangling_edges", f"WITH {_EDGES}, live AS (SELECT DISTINCT node FROM ops WHERE op = 1) SELECT edge_id, src, tgt, src IN (SELECT node FROM live) AS has_src, tgt IN (SELECT node FROM live) AS has_tgt FROM edges WHERE NOT (src IN (SELECT node FROM live) AND tgt IN (SELECT node FROM live))")(
    lambda s, d: _dangling(ops(s, d)))


def _dangling(o):
    live = o.where("op = 1").select("node").distinct()
    e = topology.edges(o)
    for c in ("src", "tgt"):
        e = e.join(live.select(F.col("node").alias(c), F.lit(True).alias(f"has_{c}")), c, "left").withColumn(f"has_{c}", F.coalesce(f"has_{c}", F.lit(False)))
    return e.where("not (has_src and has_tgt)").select("edge_id", "src", "tgt", "has_src", "has_tgt")


R("c23_snapshot", f"WITH {_EDGES} SELECT edge_id, src, tgt, (row_number() OVER (PARTITION BY tgt ORDER BY since_seq, edge_id) - 1)::INT AS pos FROM edges WHERE {_LIVE.format(MID)}")(
    lambda s, d: topology.with_positions(topology.edges(ops(s, d)).where(_LIVE.format(MID))).select("edge_id", "src", "tgt", "pos"))
R("c24_counts", f"WITH {_EDGES} SELECT (SELECT count(DISTINCT node) FROM ops WHERE op = 1) AS node_count, count(*) AS edge_count, count(*) FILTER (WHERE until_seq IS NULL) AS live_edges FROM edges")(
    lambda s, d: topology.edges(ops(s, d)).agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("until_seq").isNull()).alias("live_edges")).join(
        F.broadcast(ops(s, d).where("op = 1").agg(F.count_distinct("node").alias("node_count"))), how="cross"))  # one row each


@R("c25_set_attr", f"""WITH {OPS}, a AS (SELECT node, 'k' || (k % 3) AS key, max_by(val, seq) AS val, count(*) AS n FROM ops WHERE op = 3 GROUP BY 1, 2)
    SELECT node, string_agg(key || '=' || val, ',' ORDER BY key) AS attrs, sum(n)::BIGINT AS version FROM a GROUP BY node""")
def set_attr(spark, sf_dir):
    """Attributes as a map, the last write of a key wins; each write is a version."""
    a = ops(spark, sf_dir).where("op = 3").groupBy("node", F.concat(F.lit("k"), (F.col("k") % 3).cast("string")).alias("key")).agg(F.max_by("val", "seq").alias("val"), F.count(F.lit(1)).alias("n"))
    m = a.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "val")))).alias("m"), F.sum("n").alias("version"))
    return m.select("node", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("attrs"), "version")


@R("c26_reflect_attrs", f"""WITH {OPS}, a AS (SELECT node, 'k' || (k % 3) AS key, -max_by(val, seq) AS val FROM ops WHERE op = 3 GROUP BY 1, 2)
    SELECT node, string_agg(key || '=' || val, ',' ORDER BY key) AS attrs FROM a GROUP BY node""")
def reflect_attrs(spark, sf_dir):
    """Every ternary attribute negated."""
    a = ops(spark, sf_dir).where("op = 3").groupBy("node", F.concat(F.lit("k"), (F.col("k") % 3).cast("string")).alias("key")).agg(F.max_by("val", "seq").alias("val"))
    m = a.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "val")))).alias("m"))
    m = m.withColumn("m", F.transform_values("m", lambda _, v: t.mv_neg(v)))
    return m.select("node", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("attrs"))


_DIM = "CASE WHEN op IN (2, 5, 7) THEN 'd' WHEN op IN (3, 4, 8, 10) THEN 'a' WHEN op = 11 THEN 'e' ELSE 'i' END"
R("c27_history", f"""WITH {OPS} SELECT seq, op, count(*) FILTER (WHERE {_DIM} = 'i') OVER w AS t_identity, count(*) FILTER (WHERE {_DIM} = 'a') OVER w AS t_attribute,
    count(*) FILTER (WHERE {_DIM} = 'd') OVER w AS t_dependency, count(*) FILTER (WHERE {_DIM} = 'e') OVER w AS t_egraph FROM ops WINDOW w AS (ORDER BY seq)""")(lambda s, d: topology.history(ops(s, d)))
R("c28_power", f"WITH {OPS} SELECT seq, CASE WHEN {_PORT} <> 'signal' THEN val END AS power FROM ops WHERE op = 2")(
    lambda s, d: ops(s, d).where("op = 2").select("seq", topology.power(F.expr(_PORT), F.col("val")).alias("power")))
R("c29_rule_diff", f"WITH {EFFECTIVE} SELECT sub, src, seq, val AS changed FROM eff")(
    lambda s, d: oplog.effective(writes(s, d), "sub", "src").select("sub", "src", "seq", F.when(F.col("val") != F.col("old"), F.col("val")).alias("changed")))


@R("c21_op_constructors", f"WITH {OPS} SELECT {_NAME} AS name, count(*) AS n, min(seq) AS first_seq FROM ops GROUP BY 1")
def constructors(spark, sf_dir):
    return ops(spark, sf_dir).groupBy(topology.op_name(F.col("op")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


R("q2_dependency_reads", f"WITH {_EDGES} SELECT tgt, count(*) AS n_deps, count(DISTINCT src) AS n_sources, min(src) AS first_source FROM edges WHERE until_seq IS NULL GROUP BY tgt")(
    lambda s, d: topology.edges(ops(s, d)).where("until_seq IS NULL").groupBy("tgt").agg(F.count(F.lit(1)).alias("n_deps"), F.count_distinct("src").alias("n_sources"), F.min("src").alias("first_source")))
R("q4_label_defaults", f"""WITH {_EDGES}, l AS (SELECT other AS src, node AS tgt, max_by(k % 16, seq) AS lattice FROM ops WHERE op = 15 GROUP BY 1, 2)
    SELECT edge_id, coalesce(lattice, 0) AS lattice, CASE WHEN lattice IS NULL THEN -1 ELSE 7 END::BIGINT AS scope FROM edges LEFT JOIN l USING (src, tgt)""")(
    lambda s, d: topology.edges(ops(s, d)).join(ops(s, d).where("op = 15").groupBy(F.col("other").alias("src"), F.col("node").alias("tgt")).agg(F.max_by(F.expr("k % 16"), "seq").alias("lattice")), ["src", "tgt"], "left")
    .select("edge_id", F.coalesce("lattice", F.lit(0)).alias("lattice"), F.when(F.col("lattice").isNull(), -1).otherwise(7).cast("long").alias("scope")))
R("q12_slot_free", f"WITH {_NODES} SELECT id, CASE WHEN until_seq IS NOT NULL THEN -1 END AS freed FROM nodes WHERE until_seq IS NOT NULL")(
    lambda s, d: topology.nodes(ops(s, d)).where("until_seq IS NOT NULL").select("id", F.lit(-1).alias("freed")))
