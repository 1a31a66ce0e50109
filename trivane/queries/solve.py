"""H, I and O: stabilization, regions, and circuits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ternary as t
from ..operators import oplog, solve, topology
from ..plans import levels
from .algebra import ALL, DEPS, SLOTS, _JOIN, _MEET, all_deps, deps, slots
from .base import EFFECTIVE, OPS, Registry, ops, table, writes
from .graph import _EDGES
from .push import eff

R = Registry()

#: Expressions over a symbol s, and what they come to.
EXPRS = [("(mv-neg (mv-neg s))", "s"), ("(mv-add neg s)", "s"), ("(mv-mul pos s)", "s"), ("(mv-add s (mv-neg s))", "pos"), ("(merge neg s s)", "s"), ("(b-add zero s)", "zero"), ("(meet neg s)", "neg"), ("(join pos s)", "pos"), ("(mv-neg (mv-add s y))", "(mv-mul (mv-neg s) (mv-neg y))"), ("(meet pos (join neg s))", "s"), ("(mv-add zero zero)", "pos"), ("(merge neg zero pos)", "zero")]


def expressions(spark, sf_dir):
    k = (F.floor("value") % len(EXPRS) + 1).cast("int")
    expr = F.element_at(F.array(*[F.lit(e) for e, _ in EXPRS]), k)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.regexp_replace(expr, r"\bs\b", F.concat(F.lit("x"), F.col("user_id").cast("string"))).alias("expr"))


_NORM = "([" + ", ".join(f"'{n}'" for _, n in EXPRS) + f"])[floor(value)::INT % {len(EXPRS)} + 1]"
_SYM = f"regexp_replace({_NORM}, '\\bs\\b', 'x' || user_id, 'g')"
R("h3_rewrite", f"SELECT event_id AS id, {_SYM} AS normal, CASE {_NORM} WHEN 'neg' THEN -1 WHEN 'zero' THEN 0 WHEN 'pos' THEN 1 END AS constant FROM events")(lambda s, d: solve.normalised(expressions(s, d)))
R("h1_expression_rows", "SELECT event_id AS id, len(regexp_extract_all(e, '\\('))::INT AS n_ops FROM (SELECT event_id, ([" + ", ".join(f"'{e}'" for e, _ in EXPRS) + f"])[floor(value)::INT % {len(EXPRS)} + 1] AS e FROM events)")(
    lambda s, d: expressions(s, d).select("id", F.regexp_count("expr", F.lit(r"\(")).alias("n_ops")))
R("h4_saturation", f"SELECT {_NORM} IN ('neg', 'zero', 'pos') AS solved, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: solve.normalised(expressions(s, d)).groupBy(F.col("constant").isNotNull().alias("solved")).agg(F.count(F.lit(1)).alias("n")))


def two_levels(spark, sf_dir):
    """Orders fold their lines, customers their orders: constants from the leaves up."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey")
    leaf = deps(spark, sf_dir).groupBy("node").agg(t.meet_all(F.col("v")).alias("v"))
    return o.join(leaf, "node", "left").select("o_custkey", F.coalesce("v", F.lit(1)).alias("v"))


_TWO = f"{DEPS}, lf AS (SELECT node, {_MEET} AS v FROM deps GROUP BY node), two AS (SELECT o_custkey, coalesce(v, 1) AS v FROM orders LEFT JOIN lf ON node = o_orderkey)"
R("h2_constant_folding", f"WITH {_TWO} SELECT o_custkey, {_JOIN} AS v FROM two GROUP BY o_custkey")(lambda s, d: two_levels(s, d).groupBy("o_custkey").agg(t.join_any(F.col("v")).alias("v")))
R("h6_rule_expressions", f"WITH {DEPS} SELECT node, '(meet ' || string_agg(CASE v WHEN -1 THEN 'neg' WHEN 0 THEN 'zero' ELSE 'pos' END, ' ' ORDER BY v) || ')' AS expr FROM deps GROUP BY node")(
    lambda s, d: deps(s, d).groupBy("node").agg(F.array_sort(F.collect_list("v")).alias("v")).select("node", F.concat(F.lit("(meet "), F.array_join(F.transform("v", lambda x: F.when(x == -1, "neg").when(x == 0, "zero").otherwise("pos")), " "), F.lit(")")).alias("expr")))


def roots(spark, sf_dir):
    return two_levels(spark, sf_dir).select(F.col("o_custkey").alias("region"), F.when(F.col("o_custkey") % 7 != 0, F.col("v")).alias("constant"), (F.col("v") == 0).alias("pinned"), (F.col("o_custkey") % 11 == 0).alias("oscillates"))


_ROOTS = f"{_TWO}, rt AS (SELECT o_custkey AS region, CASE WHEN o_custkey % 7 <> 0 THEN v END AS constant, v = 0 AS pinned, o_custkey % 11 = 0 AS osc FROM two)"
_OUT = "CASE WHEN count(DISTINCT constant) = 1 AND count(constant) = count(*) AND min(constant) <> 0 THEN 'Accepted' WHEN count(DISTINCT constant) > 1 THEN 'Structural' WHEN bool_or(pinned) OR bool_or(osc) THEN 'Boundary' ELSE 'Structural' END"
R("h7_port_compliance", f"WITH {_ROOTS} SELECT region, {_OUT} AS outcome, CASE WHEN {_OUT} = 'Accepted' THEN min(constant) END AS value FROM rt GROUP BY region")(lambda s, d: solve.compliance(roots(s, d)))
R("h8_stabilize", f"WITH {_ROOTS}, c AS (SELECT region, {_OUT} AS outcome FROM rt GROUP BY region) SELECT outcome, count(*) AS n FROM c GROUP BY outcome")(lambda s, d: solve.compliance(roots(s, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


@R("h9_apply_result", f"""WITH {_ROOTS}, c AS (SELECT region, {_OUT} AS outcome, min(constant) AS value FROM rt GROUP BY region)
    SELECT o_orderkey AS node, 0 AS old, value AS val FROM orders JOIN c ON region = o_custkey WHERE outcome = 'Accepted' AND o_orderkey % 3 = 0""")
def apply_result(spark, sf_dir):
    """Contested members (every third order) of accepted regions take the agreed value."""
    ok = solve.compliance(roots(spark, sf_dir)).where("outcome = 'Accepted'")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.join(ok, o.o_custkey == ok.region).select(F.col("o_orderkey").alias("node"), F.lit(0).alias("old"), F.col("value").alias("val"))


_VALS = "v AS (SELECT node, max_by(val, seq) AS val FROM ops WHERE op = 3 GROUP BY node), live AS (SELECT DISTINCT src, tgt FROM edges WHERE until_seq IS NULL), seeds AS (SELECT node FROM ops WHERE op = 11 AND k % 2 = 0 GROUP BY node)"


def network(spark, sf_dir):
    o = ops(spark, sf_dir)
    return o.where("op = 3").groupBy("node").agg(F.max_by("val", "seq").alias("val")), topology.edges(o).where("until_seq IS NULL").select("src", "tgt").distinct(), o.where("op = 11 and k % 2 = 0").select("node").distinct()


R("h5_section", f"""WITH RECURSIVE {_EDGES}, {_VALS}, r(node) AS (SELECT node FROM seeds UNION SELECT src FROM r JOIN v USING (node) JOIN live ON tgt = r.node WHERE val = 0)
    SELECT r.node, r.node IN (SELECT node FROM seeds) OR coalesce(val = 0, false) AS member FROM r LEFT JOIN v USING (node)""")(lambda s, d: solve.section(*network(s, d)))
_REV = "CASE WHEN val > old AND lag(val - old) OVER w < 0 OR val < old AND lag(val - old) OVER w > 0 THEN 1 ELSE 0 END"
R("h10_oscillation", f"WITH {EFFECTIVE}, x AS (SELECT sub, src, seq, {_REV} AS rev FROM eff WINDOW w AS (PARTITION BY sub, src ORDER BY seq)) SELECT sub, src, sum(rev)::BIGINT AS reversals, sum(rev) >= 3 AS oscillates FROM x GROUP BY sub, src")(lambda s, d: _oscillation(eff(s, d)))


def _oscillation(e):
    w = Window.partitionBy("sub", "src").orderBy("seq")
    step, last = F.col("val") - F.col("old"), F.lag(F.col("val") - F.col("old")).over(w)
    x = e.withColumn("rev", F.when((step > 0) & (last < 0) | (step < 0) & (last > 0), 1).otherwise(0))
    return x.groupBy("sub", "src").agg(F.sum("rev").alias("reversals"), (F.sum("rev") >= 3).alias("oscillates"))


R("h11_summary_versions", f"WITH {EFFECTIVE} SELECT sub, src, count(*) AS version, max_by(val, seq) AS val FROM eff GROUP BY sub, src")(lambda s, d: eff(s, d).groupBy("sub", "src").agg(F.count(F.lit(1)).alias("version"), F.max_by("val", "seq").alias("val")))
R("h12_stabilizing_routes", f"WITH {OPS}, m AS (SELECT node, max_by(k % 3, seq) AS mode FROM ops WHERE op = 9 GROUP BY node) SELECT o.node, seq FROM ops o JOIN m USING (node) WHERE op = 3 AND val = 0 AND mode = 2")(
    lambda s, d: ops(s, d).where("op = 3 and val = 0").join(ops(s, d).where("op = 9").groupBy("node").agg(F.max_by(F.expr("k % 3"), "seq").alias("mode")).where("mode = 2"), "node").select("node", "seq"))

# Regions.
R("i1_dep_closure", f"WITH RECURSIVE {_EDGES}, {_VALS}, r(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT src, depth + 1 FROM r JOIN live ON tgt = r.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node")(
    lambda s, d: levels.closure(network(s, d)[1], network(s, d)[2], 3))
R("i2_partition_region", f"WITH {OPS}, b AS (SELECT node, max_by(k % 7, seq) AS part FROM ops WHERE op = 13 GROUP BY node) SELECT part, count(*) AS members, min(node) AS first FROM b GROUP BY part")(
    lambda s, d: ops(s, d).where("op = 13").groupBy("node").agg(F.max_by(F.expr("k % 7"), "seq").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")))


def static(spark, sf_dir):
    """values, edges and rules of a static tree: order, customer, nation, region."""
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, c, na = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    leaf = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 0).otherwise(-1)
    e = o.select(n("o", "o_orderkey").alias("src"), n("c", "o_custkey").alias("tgt")).union(c.select(n("c", "c_custkey"), n("n", "c_nationkey"))).union(na.select(n("n", "n_nationkey"), n("r", "n_regionkey")))
    busy = e.select("tgt").distinct()
    e = e.join(o.select(n("o", "o_orderkey").alias("src")).union(busy.select(F.col("tgt").alias("src"))), "src", "left_semi")
    rules = busy.select(F.col("tgt").alias("node"), F.when(F.col("tgt").startswith("c"), "MeetAll").when(F.col("tgt").startswith("n"), "JoinAny").otherwise("BochvarFold").alias("rule"))
    return o.select(n("o", "o_orderkey").alias("node"), leaf.alias("val")), e, rules


_STATIC = f"""lv AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 ELSE -1 END AS v FROM orders),
    cu AS (SELECT o_custkey AS k, {_MEET} AS v FROM lv GROUP BY 1), na AS (SELECT c_nationkey AS k, {_JOIN} AS v FROM cu JOIN customer ON c_custkey = k GROUP BY 1),
    re AS (SELECT n_regionkey AS k, CASE WHEN bool_or(v = 0) THEN 0 WHEN bool_or(v = 1) THEN 1 ELSE -1 END AS v FROM na JOIN nation ON n_nationkey = k GROUP BY 1)"""
R("i3_topological_levels", f"WITH {_STATIC} SELECT 0 AS level, count(*) AS n FROM lv UNION ALL SELECT 1, count(*) FROM cu UNION ALL SELECT 2, count(*) FROM na UNION ALL SELECT 3, count(*) FROM re")(
    lambda s, d: levels.levels(static(s, d)[1]).groupBy("level").agg(F.count(F.lit(1)).alias("n")))
R("i4_csr_rows", "WITH c AS (SELECT o_custkey AS tgt, list(o_orderkey ORDER BY o_orderkey) AS deps FROM orders GROUP BY 1) SELECT tgt, len(deps)::INT AS n, array_to_string(deps, ',') AS cols FROM c")(
    lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("tgt")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("deps")).select("tgt", F.size("deps").alias("n"), F.array_join(F.transform("deps", lambda x: x.cast("string")), ",").alias("cols")))
R("i5_inverted_index", "SELECT l_partkey AS dep, count(DISTINCT l_orderkey) AS n_rows, min(l_orderkey) AS first_row, max(l_orderkey) - min(l_orderkey) + 1 = count(DISTINCT l_orderkey) AS contiguous FROM lineitem GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("dep")).agg(F.count_distinct("l_orderkey").alias("n_rows"), F.min("l_orderkey").alias("first_row"), (F.max("l_orderkey") - F.min("l_orderkey") + 1 == F.count_distinct("l_orderkey")).alias("contiguous")))
R("i6_run_region", f"WITH {_STATIC} SELECT 'r' || k AS node, v AS val FROM re UNION ALL SELECT 'n' || k, v FROM na UNION ALL SELECT 'c' || k, v FROM cu")(lambda s, d: _run(*static(s, d)))


def _run(values, edges, rules):
    return solve.evaluate_region(values, edges, rules, levels.levels(edges)).where("not node like 'o%'")


R("i8_adjacency_epochs", f"WITH {OPS}, t AS (SELECT node FROM ops WHERE op IN (2, 5, 7) UNION ALL SELECT other FROM ops WHERE op IN (2, 5, 7)) SELECT node, count(*) AS epoch FROM t GROUP BY node")(
    lambda s, d: ops(s, d).where("op in (2, 5, 7)").select(F.explode(F.array("node", "other")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("epoch")))
_VALID = "(SELECT count(*) FROM ops o WHERE o.op IN (2, 5, 7) AND (o.node = r.node OR o.other = r.node) AND o.seq > r.seq) = 0"
R("i7_artifact_validity", f"WITH {OPS}, r AS (SELECT node, max(seq) AS seq FROM ops WHERE op = 18 GROUP BY node) SELECT node, seq, {_VALID} AS valid FROM r")(lambda s, d: _valid(ops(s, d)))
R("i9_contracts", f"WITH {OPS}, r AS (SELECT node, max(seq) AS seq, max_by(k, seq) AS k FROM ops WHERE op = 18 GROUP BY node) SELECT node, k % 2 = 0 OR {_VALID} AS usable, (['Eager', 'Lazy', 'Never'])[k % 3 + 1] AS compile FROM r")(
    lambda s, d: _valid(ops(s, d)).join(ops(s, d).where("op = 18").groupBy("node").agg(F.max_by("k", "seq").alias("k")), "node").select("node", ((F.col("k") % 2 == 0) | F.col("valid")).alias("usable"), F.element_at(F.array(F.lit("Eager"), F.lit("Lazy"), F.lit("Never")), (F.col("k") % 3 + 1).cast("int")).alias("compile")))


def _valid(o):
    """A region compiled at a seq is valid while no later operation touches its node's edges."""
    r = o.where("op = 18").groupBy("node").agg(F.max("seq").alias("seq"))
    touched = o.where("op in (2, 5, 7)").select(F.explode(F.array("node", "other")).alias("node"), F.col("seq").alias("at")).groupBy("node").agg(F.max("at").alias("at"))
    return r.join(touched, "node", "left").select("node", "seq", (F.coalesce("at", F.lit(-1)) <= F.col("seq")).alias("valid"))


R("i10_boundary_push", f"WITH {_EDGES}, {_VALS} SELECT DISTINCT tgt FROM live WHERE src IN (SELECT node FROM seeds) AND tgt NOT IN (SELECT node FROM seeds)")(lambda s, d: _boundary(*network(s, d)))


def _boundary(_, edges, seeds):
    return edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").join(seeds.select(F.col("node").alias("tgt")), "tgt", "left_anti").select("tgt").distinct()


# Circuits.
@R("o5_cell_change", f"WITH {EFFECTIVE}, d AS (SELECT sub, seq, val FROM writes) SELECT sub, seq, val <> coalesce(lag(val) OVER (PARTITION BY sub ORDER BY seq), -1) AS changed FROM d")
def cell_change(spark, sf_dir):
    w = writes(spark, sf_dir)
    return w.select("sub", "seq", (F.col("val") != F.coalesce(F.lag("val").over(Window.partitionBy("sub").orderBy("seq")), F.lit(-1))).alias("changed"))


def ages(spark, sf_dir, most):
    """Cycles since the cell last changed, at most ``most``."""
    c = cell_change(spark, sf_dir)
    w = Window.partitionBy("sub").orderBy("seq")
    c = c.withColumn("grp", F.count(F.when(F.col("changed"), 1)).over(w))
    return c.select("sub", "seq", F.least(F.row_number().over(Window.partitionBy("sub", "grp").orderBy("seq")) - F.when(F.col("grp") > 0, 1).otherwise(0), F.lit(most)).alias("age"))


def _ages_sql(most):
    return f"""WITH {EFFECTIVE}, d AS (SELECT sub, seq, val <> coalesce(lag(val) OVER (PARTITION BY sub ORDER BY seq), -1) AS changed FROM writes),
    g AS (SELECT *, count(*) FILTER (WHERE changed) OVER (PARTITION BY sub ORDER BY seq) AS grp FROM d) SELECT sub, seq, least(row_number() OVER (PARTITION BY sub, grp ORDER BY seq) - CASE WHEN grp > 0 THEN 1 ELSE 0 END, {most})::INT AS age FROM g"""


R("o6_chain_age", _ages_sql(8191))(lambda s, d: ages(s, d, 8191))
R("o8_region_gated", _ages_sql(3).replace("SELECT sub, seq, least", "SELECT sub, count(*) FILTER (WHERE age >= 3) AS gated FROM (SELECT sub, seq, least") + ") GROUP BY sub")(lambda s, d: ages(s, d, 3).groupBy("sub").agg(F.count_if(F.col("age") >= 3).alias("gated")))


@R("o7_tree_root", f"WITH {SLOTS} SELECT {_MEET} AS v FROM slots")
def tree_root(spark, sf_dir):
    t_ = solve.tree_reduce(slots(spark, sf_dir), 16, t.meet_all)
    top = t_.agg(F.max("level").alias("level"))
    return t_.join(F.broadcast(top), "level").select("v")  # one row
