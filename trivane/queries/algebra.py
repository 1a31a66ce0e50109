"""A, B, D and O: scalar algebra, folds, rules, and their hardware twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ternary as t
from .base import Registry, band, band_sql, table

R = Registry()


def triples(spark, sf_dir):
    """seq, a, b, c: an event's banded value and those of its user's two events before."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = lambda k: F.when(F.lag("value", k).over(w).isNull(), -1).otherwise(band(F.lag("value", k).over(w)))
    return e.select(F.col("event_id").alias("seq"), band(F.col("value")).alias("a"), before(1).alias("b"), before(2).alias("c"))


_B, _C = "lag(value, 1) OVER (PARTITION BY user_id ORDER BY event_id)", "lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id)"
# A missing predecessor compares as unknown, so the band's last branch is taken; it must count as pending.
TRIPLES = f"x AS (SELECT event_id AS seq, {band_sql('value')} AS a, CASE WHEN {_B} IS NULL THEN -1 ELSE {band_sql(_B)} END AS b, CASE WHEN {_C} IS NULL THEN -1 ELSE {band_sql(_C)} END AS c FROM events)"

#: Truth tables over (-1, 0, 1) x (-1, 0, 1), rows first.
TABLES = {
    "a2_mv_add": (t.mv_add, [-1, 0, 1, 0, 1, 1, 1, 1, 1]),
    "a3_mv_mul": (t.mv_mul, [-1, -1, -1, -1, -1, 0, -1, 0, 1]),
    "a4_mv_sub": (t.mv_sub, [-1, -1, -1, 0, -1, -1, 1, 0, -1]),
    "a5_mv_impl": (t.mv_impl, [1, 1, 1, 0, 1, 1, -1, 0, 1]),
    "a6_meet": (t.meet, [-1, -1, -1, -1, 0, 0, -1, 0, 1]),
    "a7_join": (t.join, [-1, 0, 1, 0, 0, 1, 1, 1, 1]),
    "a10_bochvar_add": (t.bochvar_add, [-1, 0, 1, 0, 0, 0, 1, 0, 1]),
    "a11_bochvar_mul": (t.bochvar_mul, [-1, 0, -1, 0, 0, 0, -1, 0, 1]),
    "a12_bochvar_meet": (t.bochvar_meet, [-1, 0, -1, 0, 0, 0, -1, 0, 1]),
}
PAIRS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _binary(f):
    return lambda spark, sf_dir: triples(spark, sf_dir).select("seq", f(F.col("a"), F.col("b")).alias("r"))


for _name, (_f, _values) in TABLES.items():
    _rows = ", ".join(f"({a}, {b}, {r})" for (a, b), r in zip(PAIRS, _values, strict=True))
    R(_name, f"WITH {TRIPLES} SELECT seq, r FROM x JOIN (VALUES {_rows}) v(a, b, r) USING (a, b)")(_binary(_f))

R("a1_mv_neg", f"WITH {TRIPLES} SELECT seq, CASE a WHEN -1 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS r FROM x")(lambda s, d: triples(s, d).select("seq", t.mv_neg(F.col("a")).alias("r")))
_MEDIAN = f"WITH {TRIPLES} SELECT seq, list_sort([a, b, c])[2] AS r FROM x"
R("a8_median", _MEDIAN)(lambda s, d: triples(s, d).select("seq", t.median(F.col("a"), F.col("b"), F.col("c")).alias("r")))
R("a9_merge", _MEDIAN)(lambda s, d: triples(s, d).select("seq", t.merge(F.col("a"), F.col("b"), F.col("c")).alias("r")))
R("a13_predicates", f"WITH {TRIPLES} SELECT seq, a = 1 AS ready, a = 0 AS conflicted, a = -1 AS pending FROM x")(
    lambda s, d: triples(s, d).select("seq", t.is_ready(F.col("a")).alias("ready"), t.is_conflicted(F.col("a")).alias("conflicted"), t.is_pending(F.col("a")).alias("pending")))
R("a14_conversions", """SELECT event_id AS seq, CASE WHEN code BETWEEN -1 AND 1 THEN code END AS wire, CASE WHEN code = 1 THEN true WHEN code = 0 THEN false END AS flag,
    CASE WHEN code = 1 THEN 1 WHEN code = 0 THEN 0 ELSE -1 END AS back FROM (SELECT event_id, (event_id % 5)::INT - 2 AS code FROM events)""")(
    lambda s, d: table(s, d, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") % 5).cast("int") - 2).alias("code")).select(
        "seq", t.from_wire(F.col("code")).alias("wire"), t.to_flag(F.col("code")).alias("flag"), t.from_flag(t.to_flag(F.col("code"))).alias("back")))
R("a15_display", f"WITH {TRIPLES} SELECT seq, CASE WHEN a < 0 THEN '-1' WHEN a > 0 THEN '+1' ELSE ' 0' END AS r FROM x")(lambda s, d: triples(s, d).select("seq", t.display(F.col("a")).alias("r")))


def deps(spark, sf_dir):
    """node, v: an order depends on its lines; A is present, R contested, N pending. Users without lines stay out."""
    v = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 0).otherwise(-1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), v.alias("v"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


DEPS = "deps AS (SELECT l_orderkey AS node, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE -1 END AS v, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"
#: All orders, so that those without lines show what a fold gives for no input.
ALL = "n AS (SELECT o_orderkey AS node, v FROM orders LEFT JOIN deps ON o_orderkey = node)"


def all_deps(spark, sf_dir):
    d = deps(spark, sf_dir).select("node", "v")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")).join(d, "node", "left")


def _fold(name, f, sql):
    R(name, f"WITH {DEPS}, {ALL} SELECT node, {sql} AS r FROM n GROUP BY node")(lambda s, d: all_deps(s, d).groupBy("node").agg(f(F.col("v")).alias("r")))


_MEET = "CASE WHEN bool_or(v = -1) THEN -1 WHEN bool_or(v = 0) THEN 0 ELSE 1 END"
_JOIN = "CASE WHEN bool_or(v = 1) THEN 1 WHEN bool_or(v = 0) THEN 0 ELSE -1 END"
_fold("b1_meet_all", t.meet_all, _MEET)
_fold("b2_join_any", t.join_any, _JOIN)
_fold("b3_bochvar_fold", t.fold_add, "CASE WHEN bool_or(v = 0) THEN 0 WHEN bool_or(v = 1) THEN 1 ELSE -1 END")
_fold("b4_propagation_state", t.propagation_state, "CASE WHEN bool_or(v = 0) THEN 'Conflicted' WHEN bool_or(v = -1) THEN 'Pending' ELSE 'Ready' END")
_fold("o1_kernel_meet", t.meet_all, _MEET)
_fold("o2_kernel_join", t.join_any, _JOIN)
_fold("o3_region_quiescent", t.quiescent, "NOT coalesce(bool_or(v = -1), false)")
R("b5_dep_counters", f"WITH {DEPS}, {ALL} SELECT node, count(*) FILTER (WHERE v = -1) AS neg, count(*) FILTER (WHERE v = 0) AS zero, count(*) FILTER (WHERE v = 1) AS pos FROM n GROUP BY node")(
    lambda s, d: all_deps(s, d).groupBy("node").agg(*t.counters(F.col("v"))))
R("b6_eval_aggregate", f"WITH {DEPS}, {ALL} SELECT node, CASE WHEN bool_or(v = 0) THEN 0 WHEN bool_or(v = -1) THEN -1 ELSE 1 END AS r FROM n GROUP BY node")(
    lambda s, d: all_deps(s, d).groupBy("node").agg(*t.counters(F.col("v"))).select("node", t.aggregate_of(F.col("neg"), F.col("zero")).alias("r")))


def slots(spark, sf_dir):
    """idx, v: customers as a dense array of cells."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.when(b < 0, -1).when(b < 5000, 0).otherwise(1).alias("v"))


SLOTS = "slots AS (SELECT c_custkey AS idx, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 5000 THEN 0 ELSE 1 END AS v FROM customer)"
#: Ranges [start, end) asked for.
RANGES = [(0, 64), (10, 20), (63, 65), (64, 640), (100, 100), (1, 100_000)]
_RANGES = ", ".join(f"({a}, {b})" for a, b in RANGES)


def in_ranges(spark, sf_dir):
    r = spark.createDataFrame(RANGES, "lo int, hi int")
    s = slots(spark, sf_dir)
    return F.broadcast(r).join(s, (s.idx >= r.lo) & (s.idx < r.hi), "left")  # a handful of fixed ranges


for _name, _f, _sql in (("b7_meet_all_range", t.meet_all, _MEET), ("b8_join_any_range", t.join_any, _JOIN)):
    R(_name, f"WITH {SLOTS} SELECT lo, hi, {_sql} AS r FROM (VALUES {_RANGES}) q(lo, hi) LEFT JOIN slots ON idx >= lo AND idx < hi GROUP BY lo, hi")(
        lambda s, d, f=_f: in_ranges(s, d).groupBy("lo", "hi").agg(f(F.col("v")).alias("r")))


@R("b9_range_mask", f"""WITH q AS (SELECT lo, hi, w FROM (VALUES {_RANGES}) q(lo, hi), range(0, 4) g(w)),
    m AS (SELECT lo, hi, w, sum((1::HUGEINT) << b) AS m FROM q, range(0, 64) h(b) WHERE w * 64 + b >= lo AND w * 64 + b < hi GROUP BY lo, hi, w)
    SELECT q.lo, q.hi, q.w::INT AS w, (CASE WHEN coalesce(m, 0) >= 9223372036854775808 THEN m - 18446744073709551616 ELSE coalesce(m, 0) END)::BIGINT AS mask FROM q LEFT JOIN m USING (lo, hi, w)""")
def range_mask(spark, sf_dir):
    """Bits of word w that lie in [lo, hi)."""
    q = spark.createDataFrame([(a, b, w) for a, b in RANGES for w in range(4)], "lo int, hi int, w int")
    low = F.greatest(F.lit(0), F.least(F.lit(64), F.col("lo") - 64 * F.col("w")))
    high = F.greatest(F.lit(0), F.least(F.lit(64), F.col("hi") - 64 * F.col("w")))
    ones = lambda n: F.when(n >= 64, F.lit(-1)).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n)))
    return q.select("lo", "hi", "w", ones(high).cast("long").bitwiseAND(F.bitwise_not(ones(low).cast("long"))).alias("mask"))


_PLANE = "(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END)::BIGINT"


@R("b10_bit_planes", f"""WITH {SLOTS}, p AS (SELECT (idx // 64) AS word, sum(CASE WHEN v = 1 THEN (1::HUGEINT) << (idx % 64)::INT ELSE 0 END) AS a, sum(CASE WHEN v = 0 THEN (1::HUGEINT) << (idx % 64)::INT ELSE 0 END) AS b FROM slots GROUP BY 1)
    SELECT word, {_PLANE.format('a')} AS p0, {_PLANE.format('b')} AS p1 FROM p""")
def bit_planes(spark, sf_dir):
    """64 cells a word: a plane of present and a plane of contested bits."""
    s = slots(spark, sf_dir)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("idx") % 64).cast("int"))
    plane = lambda k: F.bit_or(F.when(F.col("v") == k, bit).otherwise(F.lit(0)))
    return s.groupBy(F.expr("idx div 64").alias("word")).agg(plane(1).alias("p0"), plane(0).alias("p1"))


def positioned(spark, sf_dir):
    w = Window.partitionBy("node").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "v")
    return deps(spark, sf_dir).select("node", "v", (F.row_number().over(w) - 1).alias("pos"))


POSITIONED = f"{DEPS}, p AS (SELECT node, v, row_number() OVER (PARTITION BY node ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, v) - 1 AS pos FROM deps), g AS (SELECT node, list(v ORDER BY pos) AS d FROM p GROUP BY node)"
_TWO = "CASE WHEN len(d) < 2 THEN -1 ELSE {} END"
#: Each rule over the list d of input values, and its value when all inputs are present.
PURE_SQL = {
    "Identity": ("d[1]", "1"), "MvNeg": ("-d[1]", "-1"),
    "MvAdd": (_TWO.format("least(1, d[1] + d[2] + 1)"), "CASE WHEN len(d) < 2 THEN -1 ELSE 1 END"),
    "MvMul": (_TWO.format("greatest(-1, d[1] + d[2] - 1)"), "CASE WHEN len(d) < 2 THEN -1 ELSE 1 END"),
    "MvSub": (_TWO.format("greatest(-1, d[1] - d[2] - 1)"), "-1"),
    "Merge": ("CASE WHEN len(d) < 3 THEN -1 ELSE list_sort(d[1:3])[2] END", "CASE WHEN len(d) < 3 THEN -1 ELSE 1 END"),
    "MeetAll": ("list_min(d)", "1"), "JoinAny": ("list_max(d)", "1"),
    "BochvarFold": ("CASE WHEN list_contains(d, 0) THEN 0 ELSE list_max(d) END", "1"),
    "PowerProduct": (_TWO.format("greatest(-1, d[1] + d[2] - 1)"), "CASE WHEN len(d) < 2 THEN -1 ELSE 1 END"),
}


def _rule(rule):
    def run(spark, sf_dir):
        p = positioned(spark, sf_dir)
        # Positional rules read three inputs at most, so all is one map-side combined aggregation.
        g = p.groupBy("node").agg(t.pure(rule, F.col("v"), F.col("pos")).alias("pure"), *t.counters(F.col("v")), F.count(F.lit(1)).alias("n"))
        return g.select("node", "pure", t.gated(F.lit(rule), F.col("neg"), F.col("zero"), F.col("n")).alias("gated"))

    return run


for _rule_name, _byte in t.RULES.items():
    _p, _ready = PURE_SQL[_rule_name]
    R(f"d{_byte}_{_rule_name.lower()}", f"WITH {POSITIONED} SELECT node, ({_p})::INT AS pure, CASE WHEN list_contains(d, 0) THEN 0 WHEN list_contains(d, -1) THEN NULL ELSE {_ready} END AS gated FROM g")(_rule(_rule_name))

R("o4_meetall_500", f"WITH {SLOTS} SELECT {_MEET} AS r, count(*) AS n FROM slots WHERE idx < 500")(lambda s, d: slots(s, d).where("idx < 500").agg(t.meet_all(F.col("v")).alias("r"), F.count(F.lit(1)).alias("n")))
