"""E and F: propagation, suppression, retention, and evaluation on demand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gates
from ..functions import ternary as t
from ..operators import oplog, topology
from ..plans import levels
from .base import EFFECTIVE, OPS, WRITES, Registry, ops, table, writes
from .graph import _EDGES

R = Registry()
N = 5  # event types, the inputs of every user
STEP = "sum(CASE WHEN val = -1 THEN 1 ELSE 0 END - CASE WHEN old = -1 THEN 1 ELSE 0 END) AS dn, sum(CASE WHEN val = 0 THEN 1 ELSE 0 END - CASE WHEN old = 0 THEN 1 ELSE 0 END) AS dz"


def level_sql(name: str, source: str, node: str, n: str, ready: int = 1) -> str:
    """CTEs of a level: {name}_c counters, {name}_v values, {name} changes (node, seq, old, val)."""
    w = "OVER (PARTITION BY node ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    return f"""{name}_d AS (SELECT {node} AS node, seq, {STEP} FROM {source} GROUP BY 1, 2),
    {name}_c AS (SELECT node, seq, ({n} + sum(dn) {w})::BIGINT AS neg, (sum(dz) {w})::BIGINT AS zero FROM {name}_d),
    {name}_v AS (SELECT node, seq, neg, zero, coalesce(last_value(CASE WHEN zero > 0 THEN 0 WHEN neg > 0 THEN NULL ELSE {ready} END IGNORE NULLS) {w}, -1) AS out FROM {name}_c),
    {name}_o AS (SELECT node, seq, coalesce(lag(out) OVER (PARTITION BY node ORDER BY seq), -1) AS old, out AS val FROM {name}_v),
    {name} AS (SELECT * FROM {name}_o WHERE old <> val)"""


def eff(spark, sf_dir):
    return oplog.effective(writes(spark, sf_dir), "sub", "src")


def counted(spark, sf_dir):
    return oplog.counters(eff(spark, sf_dir), F.lit(N))


L1 = f"WITH {EFFECTIVE}, {level_sql('a', 'eff', 'sub', str(N))}"
R("e1_effective_writes", f"WITH {EFFECTIVE} SELECT seq, sub, src, old, val FROM eff")(lambda s, d: eff(s, d).select("seq", "sub", "src", "old", "val"))
R("e2_versions", f"WITH {EFFECTIVE} SELECT sub, src, seq, row_number() OVER (PARTITION BY sub, src ORDER BY seq) AS version FROM eff")(
    lambda s, d: oplog.versions(eff(s, d), "sub", "src").select("sub", "src", "seq", "version"))
R("e3_push_step", L1 + f" SELECT node AS sub, seq, neg, zero, {N} - neg - zero AS pos FROM a_c")(lambda s, d: counted(s, d))
R("e4_counter_shortcut", L1 + " SELECT node AS sub, seq, CASE WHEN zero > 0 THEN 0 WHEN neg > 0 THEN -1 ELSE 1 END AS r FROM a_c")(
    lambda s, d: counted(s, d).select("sub", "seq", t.aggregate_of(F.col("neg"), F.col("zero")).alias("r")))
R("e5_retained_meet", L1 + " SELECT node AS sub, seq, out FROM a_v")(lambda s, d: oplog.retained(counted(s, d), F.lit("MeetAll"), F.lit(N)).select("sub", "seq", "out"))
R("e6_infection", L1 + " SELECT node AS sub, seq, zero FROM a_c WHERE zero > 0")(lambda s, d: counted(s, d).where("zero > 0").select("sub", "seq", "zero"))


@R("e7_delta_gate", f"""WITH {OPS}, s AS (SELECT seq, node, (CASE WHEN op IN (2, 5, 7) THEN 4 WHEN op IN (3, 4, 8, 10) THEN 2 WHEN op = 11 THEN 8 ELSE 1 END)::INT AS dim, (1 + k % 31)::INT AS mask FROM ops)
    SELECT seq, (dim & mask) <> 0 AS passes FROM s""")
def delta_gate(spark, sf_dir):
    """An operation ticks one clock; a subscriber with a mask is told if it masks that clock."""
    h = ops(spark, sf_dir)
    dim = topology.clock_dim(F.col("op"))
    zero = {d: F.lit(0) for d in gates.DIMS}
    clock = {d: F.when(F.concat(F.lit("t_"), dim) == d, 1).otherwise(0) for d in gates.DIMS}
    return h.select("seq", gates.should_propagate((1 + F.col("k") % 31).cast("int"), clock, zero).alias("passes"))


R("e8_last_seen", f"WITH {EFFECTIVE} SELECT sub, src, seq, max(seq) OVER (PARTITION BY sub ORDER BY seq) AS seen FROM eff")(
    lambda s, d: eff(s, d).select("sub", "src", "seq", F.max("seq").over(Window.partitionBy("sub").orderBy("seq")).alias("seen")))
_MODE = "(SELECT max_by(k % 3, o.seq) FROM ops o WHERE o.op = 9 AND o.node = w.node AND o.seq <= w.seq)"
R("e9_mode_gate", f"WITH {OPS} SELECT node, seq, val FROM ops w WHERE op = 3 AND coalesce({_MODE}, 0) = 0")(
    lambda s, d: oplog.as_of(ops(s, d).where("op = 3").select("node", "seq", "val"), ops(s, d).where("op = 9").select("node", "seq", F.expr("k % 3").alias("mode")), "node", "mode")
    .where(F.coalesce("mode", F.lit(0)) == 0).select("node", "seq", "val"))


def tree(spark, sf_dir):
    """writes, rules and edges of three levels: users meet their inputs, groups join users, one root meets groups."""
    w = writes(spark, sf_dir)
    name = F.concat_ws("/", F.lit("i"), F.col("sub").cast("string"), F.col("src"))
    user, group, root = F.concat_ws("/", F.lit("u"), F.col("sub").cast("string")), F.concat_ws("/", F.lit("g"), (F.col("sub") % 10).cast("string")), F.lit("root")
    pairs = w.select("sub", "src").distinct()
    e = pairs.select(name.alias("src"), user.alias("tgt")).union(pairs.select(user, group).distinct()).union(pairs.select(group, root).distinct())
    rules = pairs.select(user.alias("node"), F.lit("MeetAll").alias("rule")).union(pairs.select(group, F.lit("JoinAny"))).union(pairs.select(root, F.lit("MeetAll"))).distinct()
    return w.select("seq", name.alias("node"), "val"), rules, e


TREE = f"""WITH {EFFECTIVE}, {level_sql('a', 'eff', 'sub', "(SELECT count(DISTINCT src) FROM writes w WHERE w.sub = node)")},
    {level_sql('b', 'a', '(node % 10)', "(SELECT count(DISTINCT sub) FROM writes w WHERE w.sub % 10 = node)")},
    {level_sql('c', 'b', '0', "(SELECT count(DISTINCT sub % 10) FROM writes)")},
    log AS (SELECT 0 AS level, 'i/' || sub || '/' || src AS node, seq, old, val FROM eff UNION ALL SELECT 1, 'u/' || node, seq, old, val FROM a UNION ALL SELECT 2, 'g/' || node, seq, old, val FROM b UNION ALL SELECT 3, 'root', seq, old, val FROM c)"""
R("e10_drain_levels", TREE + " SELECT level, node, seq, old, val FROM log")(lambda s, d: levels.propagate(*tree(s, d)).select("level", "node", "seq", "old", "val"))
R("e11_subscribers", f"WITH {_EDGES} SELECT src, string_agg(DISTINCT tgt::VARCHAR, ',' ORDER BY tgt::VARCHAR) AS subs FROM edges WHERE until_seq IS NULL GROUP BY src")(
    lambda s, d: topology.edges(ops(s, d)).where("until_seq IS NULL").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.col("tgt").cast("string"))), ",").alias("subs")))
R("e12_change_events", L1 + " SELECT seq, node AS sub, CASE WHEN val = 0 THEN 'BochvarInfected' ELSE 'ValueChanged' END AS kind, old, val FROM a")(
    lambda s, d: oplog.changes_of(oplog.retained(counted(s, d), F.lit("MeetAll"), F.lit(N))).select("seq", "sub", F.when(F.col("val") == 0, "BochvarInfected").otherwise("ValueChanged").alias("kind"), "old", "val"))
R("e13_statistics", TREE + " SELECT level, count(*) AS changes, count(*) FILTER (WHERE val = 0) AS infections, count(DISTINCT node) AS nodes, max(seq) AS last_seq FROM log GROUP BY level")(
    lambda s, d: levels.propagate(*tree(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("val") == 0).alias("infections"), F.count_distinct("node").alias("nodes"), F.max("seq").alias("last_seq")))
R("e14_amplification", TREE + " SELECT count(*) AS changes, count(DISTINCT seq) AS updates, count(*)::DOUBLE / count(DISTINCT seq) AS ratio FROM log")(lambda s, d: levels.amplification(levels.propagate(*tree(s, d))))
R("e15_registry", f"WITH {_EDGES} SELECT src, tgt, count(*) AS n, min(since_seq) AS since_seq, count(*) FILTER (WHERE until_seq IS NULL) AS live FROM edges GROUP BY src, tgt")(
    lambda s, d: topology.edges(ops(s, d)).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"), F.min("since_seq").alias("since_seq"), F.count_if(F.col("until_seq").isNull()).alias("live")))
R("e16_active_deps", f"WITH {_EDGES}, p AS (SELECT node, seq FROM ops WHERE op = 8) SELECT p.node, p.seq, count(edge_id) AS active FROM p LEFT JOIN edges ON tgt = p.node AND since_seq <= p.seq AND (until_seq IS NULL OR until_seq > p.seq) GROUP BY p.node, p.seq")(
    lambda s, d: _active(ops(s, d)))


def _active(o):
    """Edges into a node that are live at each demand: a running count of those begun less those ended."""
    e = topology.edges(o)
    one = lambda d, seq, k: d.select(F.col("tgt").alias("node"), seq.alias("seq"), F.lit(k).alias("d"), F.lit(0).alias("p"))
    u = one(e, F.col("since_seq"), 1).union(one(e.where("until_seq is not null"), F.col("until_seq"), -1))
    u = u.union(o.where("op = 8").select("node", "seq", F.lit(0), F.lit(1)))
    w = Window.partitionBy("node").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    return u.withColumn("active", F.sum("d").over(w)).where("p = 1").select("node", "seq", "active")


R("e17_step_count", TREE + " SELECT max(level) AS steps, max(level) > 100000 AS exceeded FROM log")(
    lambda s, d: levels.levels(tree(s, d)[2]).agg(F.max("level").alias("steps"), (F.max("level") > levels.STEP_LIMIT).alias("exceeded")))


def demands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_id % 13 = 0").select(F.col("user_id").alias("sub"), F.col("event_id").alias("seq"))


DEMANDS = "dem AS (SELECT user_id AS sub, event_id AS seq FROM events WHERE event_id % 13 = 0)"
_AT = "(SELECT max_by({}, c.seq) FROM a_c c WHERE c.node = d.sub AND c.seq <= d.seq)"
F_SQL = L1 + f", {DEMANDS}, j AS (SELECT d.sub, d.seq, {_AT.format('CASE WHEN zero > 0 THEN 0 WHEN neg > 0 THEN -2 ELSE 1 END')} AS e FROM dem d)"


def evaluated(spark, sf_dir):
    """What a lazy node's inputs evaluate to at each demand; -2 while any is pending."""
    c = counted(spark, sf_dir).select("sub", "seq", F.coalesce(t.gated(F.lit("MeetAll"), F.col("neg"), F.col("zero"), F.lit(N)), F.lit(-2)).alias("e"))
    return oplog.as_of(demands(spark, sf_dir), c, "sub", "e")


@R("f1_lazy_value", F_SQL + " SELECT sub, seq, coalesce(last_value(CASE WHEN e > -2 THEN e END IGNORE NULLS) OVER (PARTITION BY sub ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS out FROM j")
def lazy_value(spark, sf_dir):
    """A lazy node keeps its value between demands; a demand that finds pending inputs changes nothing."""
    w = Window.partitionBy("sub").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return evaluated(spark, sf_dir).select("sub", "seq", F.coalesce(F.last(F.when(F.col("e") > -2, F.col("e")), True).over(w), F.lit(-1)).alias("out"))


def _pending(o):
    """Live edges from pending nodes, and all live edges."""
    live = topology.edges(o).where("until_seq IS NULL").select("src", "tgt").distinct()
    set_ = o.where("op = 3").groupBy(F.col("node").alias("src")).agg(F.max_by("val", "seq").alias("val"))
    return live.join(set_, "src", "left").where(F.coalesce("val", F.lit(-1)) == -1).select("src", "tgt"), live


# A shortest way meets each source once at most, so the recursion ends there in a graph with cycles as well.
_DEMANDED = "(SELECT DISTINCT node, 0 FROM ops WHERE op = 8)"
_FAR = "depth < (SELECT count(DISTINCT src) FROM live)"


@R("f2_demand_set", f"""WITH RECURSIVE {_EDGES}, live AS (SELECT DISTINCT src, tgt FROM edges WHERE until_seq IS NULL), v AS (SELECT node, max_by(val, seq) AS val FROM ops WHERE op = 3 GROUP BY node),
    r(node, depth) AS ({_DEMANDED} UNION SELECT src, depth + 1 FROM r JOIN live ON tgt = r.node LEFT JOIN v ON v.node = src WHERE coalesce(val, -1) = -1 AND {_FAR})
    SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def demand_set(spark, sf_dir):
    """All demanded nodes pull their pending inputs, theirs, and so on, until none is left."""
    o = ops(spark, sf_dir)
    return levels.closure(_pending(o)[0], o.where("op = 8").select("node"))


R("f3_demand_unlock", F_SQL + " SELECT sub, seq, e > -2 AS evaluated FROM j WHERE e IS NOT NULL")(lambda s, d: evaluated(s, d).where("e IS NOT NULL").select("sub", "seq", (F.col("e") > -2).alias("evaluated")))


@R("f5_coalescing", f"""WITH {WRITES}, {DEMANDS}, u AS (SELECT sub, seq, 0 AS k FROM writes UNION ALL SELECT sub, seq, 1 FROM dem),
    c AS (SELECT sub, seq, k, count(*) FILTER (WHERE k = 0) OVER (PARTITION BY sub ORDER BY seq, k ROWS UNBOUNDED PRECEDING) AS n FROM u),
    d AS (SELECT * FROM c WHERE k = 1) SELECT sub, seq, n - coalesce(lag(n) OVER (PARTITION BY sub ORDER BY seq), 0) AS writes_merged FROM d""")
def coalescing(spark, sf_dir):
    """Writes that one demand's evaluation stands for."""
    u = writes(spark, sf_dir).select("sub", "seq", F.lit(0).alias("k")).union(demands(spark, sf_dir).select("sub", "seq", F.lit(1)))
    w = Window.partitionBy("sub").orderBy("seq", "k")
    c = u.withColumn("n", F.count(F.when(F.col("k") == 0, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("k = 1")
    return c.select("sub", "seq", (F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("sub").orderBy("seq")), F.lit(0))).alias("writes_merged"))


@R("f6_materialization", F_SQL + """, v AS (SELECT sub, seq, coalesce(last_value(CASE WHEN e > -2 THEN e END IGNORE NULLS) OVER (PARTITION BY sub ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS out FROM j),
    m AS (SELECT sub, out, coalesce(lag(out) OVER (PARTITION BY sub ORDER BY seq), -1) AS old FROM v) SELECT sub, count(*) FILTER (WHERE old <> out)::DOUBLE / count(*) AS ratio FROM m GROUP BY sub""")
def materialization(spark, sf_dir):
    """Changes a demand."""
    v = lazy_value(spark, sf_dir)
    v = v.withColumn("old", F.coalesce(F.lag("out").over(Window.partitionBy("sub").orderBy("seq")), F.lit(-1)))
    return v.groupBy("sub").agg((F.count_if(F.col("old") != F.col("out")).cast("double") / F.count(F.lit(1))).alias("ratio"))


@R("f4_frontier_depth", f"""WITH RECURSIVE {_EDGES}, live AS (SELECT DISTINCT src, tgt FROM edges WHERE until_seq IS NULL),
    r(node, depth) AS ({_DEMANDED} UNION SELECT src, depth + 1 FROM r JOIN live ON tgt = r.node WHERE {_FAR}), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT depth, count(*) AS width FROM m GROUP BY depth""")
def frontier_depth(spark, sf_dir):
    """How wide the closure of all demanded nodes is at each depth, down to its end."""
    o = ops(spark, sf_dir)
    live = topology.edges(o).where("until_seq IS NULL").select("src", "tgt").distinct()
    return levels.closure(live, o.where("op = 8").select("node")).groupBy("depth").agg(F.count(F.lit(1)).alias("width"))
