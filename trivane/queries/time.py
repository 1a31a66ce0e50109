"""G, J and K: clocks, masks and sensitivities; authority; boundary streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gates
from ..operators import authority, observe, topology
from .base import OPS, Registry, ops, table
from .graph import _EDGES

R = Registry()
D = list(gates.DIMS)


def clocks(spark, sf_dir):
    """Two clock vectors for each event, and the group that they belong to."""
    e = table(spark, sf_dir, "events")
    k = F.floor("value").cast("long")
    cols = [((k + i * F.col("event_id")) % (3 + i)).alias(d) for i, d in enumerate(D)] + [((k * (i + 2) + F.col("user_id")) % (3 + i)).alias(f"b_{d}") for i, d in enumerate(D)]
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("grp"), k.alias("k"), *cols)


CLOCKS = "clk AS (SELECT event_id AS seq, user_id AS grp, k, " + ", ".join([f"(k + {i} * event_id) % {3 + i} AS {d}" for i, d in enumerate(D)] + [f"(k * {i + 2} + user_id) % {3 + i} AS b_{d}" for i, d in enumerate(D)]) + " FROM (SELECT *, floor(value)::BIGINT AS k FROM events))"


class Columns:
    """Clock columns by dimension; made when asked for, as columns need a session."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getitem__(self, dim: str):
        return F.col(self.prefix + dim)


A, B = Columns(""), Columns("b_")
_dom = lambda x, y: " AND ".join(f"{x}{d} >= {y}{d}" for d in D)


@R("g1_product_time", f"WITH {CLOCKS} SELECT seq, {_dom('', 'b_')} AS dominates, " + ", ".join(f"CASE WHEN {d} < b_{d} THEN {d} ELSE b_{d} END AS meet_{d}, CASE WHEN {d} < b_{d} THEN b_{d} ELSE {d} END AS join_{d}" for d in D) + " FROM clk")
def product_time(spark, sf_dir):
    m, j = gates.clock_meet(A, B), gates.clock_join(A, B)
    return clocks(spark, sf_dir).select("seq", gates.dominates(A, B).alias("dominates"), *[c for d in D for c in (m[d].alias(f"meet_{d}"), j[d].alias(f"join_{d}"))])


R("g2_dim_sets", f"WITH {CLOCKS} SELECT seq, ((k % 32) & (grp % 32)) = (grp % 32) AS has, ((k % 32) & (grp % 32)) <> 0 AS meets, (k % 32) | (grp % 32) AS together FROM clk")(
    lambda s, d: clocks(s, d).select("seq", gates.has_all(F.col("k") % 32, F.col("grp") % 32).alias("has"), gates.meets(F.col("k") % 32, F.col("grp") % 32).alias("meets"), (F.col("k") % 32).bitwiseOR(F.col("grp") % 32).alias("together")))
R("g3_advanced_dim", f"WITH {CLOCKS} SELECT seq, CASE WHEN t_identity > b_t_identity THEN 'identity' WHEN t_dependency > b_t_dependency THEN 'dependency' WHEN t_attribute > b_t_attribute THEN 'attribute' WHEN t_egraph > b_t_egraph THEN 'egraph' WHEN t_boundary > b_t_boundary THEN 'boundary' END AS dim FROM clk")(
    lambda s, d: clocks(s, d).select("seq", gates.advanced_dim(B, A).alias("dim")))
R("g4_frontier", f"WITH {CLOCKS}, d AS (SELECT DISTINCT grp, {', '.join(D)} FROM clk) SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.grp = b.grp AND {' AND '.join(f'b.{d} >= a.{d}' for d in D)} AND ({' OR '.join(f'b.{d} > a.{d}' for d in D)}))")(
    lambda s, d: observe.frontier(clocks(s, d), "grp"))


@R("g5_vector_clock", f"""WITH {CLOCKS}, p AS (SELECT grp, seq % 7 AS part, max(k) AS c FROM clk GROUP BY 1, 2), q AS (SELECT grp, seq % 5 AS part, min(k) AS c FROM clk GROUP BY 1, 2),
    m AS (SELECT grp, part, max(c) AS c FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY 1, 2),
    o AS (SELECT q.grp, bool_and(coalesce(p.c, 0) >= q.c) AS dom FROM q LEFT JOIN p USING (grp, part) GROUP BY q.grp)
    SELECT grp, sum(c)::BIGINT AS total, count(*) AS n, any_value(dom) AS dominates FROM m JOIN o USING (grp) GROUP BY grp""")
def vector_clock(spark, sf_dir):
    """Clocks as maps: merged by maxima, and whether the first dominates the second."""
    c = clocks(spark, sf_dir)
    m = lambda n, f, name: c.groupBy("grp", (F.col("seq") % n).alias("part")).agg(f("k").alias("c")).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias(name))
    j = m(7, F.max, "a").join(m(5, F.min, "b"), "grp").withColumn("m", gates.vector_merge(F.col("a"), F.col("b")))
    return j.select("grp", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda x, y: x + y).alias("total"), F.size("m").cast("long").alias("n"), gates.vector_dominates(F.col("a"), F.col("b")).alias("dominates"))


R("g6_shape_masks", f"WITH {CLOCKS} SELECT seq, ((k % 8) & 5) <> 0 AS meets, ((k % 8) & 5) = 5 AS has FROM clk")(
    lambda s, d: clocks(s, d).select("seq", gates.meets(F.col("k") % 8, F.lit(5)).alias("meets"), gates.has_all(F.col("k") % 8, F.lit(5)).alias("has")))


def deltas(spark, sf_dir):
    """A delta for each event: dims, paths, shape by what kind of operation it was."""
    c = clocks(spark, sf_dir)
    m = F.col("k") % 6
    dims = F.when(m < 2, 2).when(m == 2, 1).when(m == 3, 4).when(m == 4, 8).otherwise(16)
    shape = F.when(m < 2, 0).when(m < 4, 1).when(m == 4, 2).otherwise(4)
    paths = F.when(m == 1, F.array(F.concat(F.lit("p"), (F.col("grp") % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return c.select("seq", "grp", "k", dims.alias("dims"), paths.alias("paths"), shape.alias("shape"))


DELTAS = f"""{CLOCKS}, dlt AS (SELECT seq, grp, k, CASE WHEN k % 6 < 2 THEN 2 WHEN k % 6 = 2 THEN 1 WHEN k % 6 = 3 THEN 4 WHEN k % 6 = 4 THEN 8 ELSE 16 END AS dims,
    CASE WHEN k % 6 < 2 THEN 0 WHEN k % 6 < 4 THEN 1 WHEN k % 6 = 4 THEN 2 ELSE 4 END AS shape, CASE WHEN k % 6 = 1 THEN ['p' || (grp % 5)] ELSE []::VARCHAR[] END AS paths FROM clk)"""
R("g7_attr_paths", f"WITH {DELTAS} SELECT seq, len(paths) = 0 OR list_has_any(paths, ['p1', 'p3']) AS matches FROM dlt")(
    lambda s, d: deltas(s, d).select("seq", gates.paths_match(F.col("paths"), F.array(F.lit("p1"), F.lit("p3"))).alias("matches")))
#: Masks observed with: the presets and one with paths.
MASKS = [(n, d, [], sh) for n, (d, sh) in gates.PRESETS.items()] + [("weight", 2, ["p1", "p3"], None)]
_MASKS = ", ".join(f"('{n}', {d}, {p if p else '[]::VARCHAR[]'}, {'NULL' if sh is None else sh})" for n, d, p, sh in MASKS)


def masks(spark):
    return F.broadcast(spark.createDataFrame(MASKS, "mask string, m_dims int, m_paths array<string>, m_shape int"))  # five rows


R("g8_mask_presets", f"SELECT mask, m_dims, m_shape, len(m_paths)::INT AS n_paths FROM (VALUES {_MASKS}) m(mask, m_dims, m_paths, m_shape)")(
    lambda s, d: masks(s).select("mask", "m_dims", "m_shape", F.size("m_paths").alias("n_paths")))
_AFF = "(m_dims & dims) <> 0 AND (len(m_paths) = 0 OR len(paths) = 0 OR list_has_any(m_paths, paths)) AND (m_shape IS NULL OR (m_shape & shape) <> 0)"
R("g9_affects", f"WITH {DELTAS} SELECT mask, grp, count(*) AS n, sum(seq)::BIGINT AS s FROM dlt JOIN (VALUES {_MASKS}) m(mask, m_dims, m_paths, m_shape) ON {_AFF} GROUP BY mask, grp")(
    lambda s, d: deltas(s, d).join(masks(s), gates.affects(F.col("m_dims"), F.col("m_paths"), F.col("m_shape"), F.col("dims"), F.col("paths"), F.col("shape"))).groupBy("mask", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("s")))
R("g10_covers", f"WITH m AS (SELECT * FROM (VALUES {_MASKS}) m(mask, m_dims, m_paths, m_shape)) SELECT a.mask, b.mask AS other, (a.m_dims & b.m_dims) = b.m_dims AND (len(a.m_paths) = 0 OR (len(b.m_paths) > 0 AND list_has_all(a.m_paths, b.m_paths))) AND (a.m_shape IS NULL OR coalesce((a.m_shape & b.m_shape) = b.m_shape, false)) AS covers FROM m a, m b")(
    lambda s, d: masks(s).join(masks(s).select(F.col("mask").alias("other"), F.col("m_dims").alias("d2"), F.col("m_paths").alias("p2"), F.col("m_shape").alias("s2")), how="cross").select(
        "mask", "other", gates.covers(F.col("m_dims"), F.col("m_paths"), F.col("m_shape"), F.col("d2"), F.col("p2"), F.col("s2")).alias("covers")))
R("g11_deltas", f"WITH {DELTAS} SELECT dims, shape, count(*) AS n, sum(len(paths))::BIGINT AS n_paths FROM dlt GROUP BY dims, shape")(
    lambda s, d: deltas(s, d).groupBy("dims", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("paths")).alias("n_paths")))
R("g12_mask_interning", f"WITH {DELTAS}, u AS (SELECT DISTINCT dims, shape FROM dlt), i AS (SELECT *, row_number() OVER (ORDER BY dims, shape)::INT AS mask_id FROM u) SELECT seq, mask_id FROM dlt JOIN i USING (dims, shape)")(
    lambda s, d: deltas(s, d).join(observe.intern(deltas(s, d), "dims", "shape"), ["dims", "shape"]).select("seq", "mask_id"))
_CLASS = "CASE WHEN k % 5 = 0 THEN 'Uncertain' WHEN k % 5 < 3 THEN 'Definite' ELSE 'Pending' END"


def classes(spark, sf_dir):
    d = deltas(spark, sf_dir)
    val, zero = F.when(F.col("k") % 5 < 3, F.col("k")), F.when(F.col("k") % 5 == 0, "Conflict")
    return d.withColumn("class", gates.state_class(val, zero)).withColumn("before", F.coalesce(F.lag(gates.state_class(val, zero)).over(Window.partitionBy("grp").orderBy("seq")), F.lit("Pending")))


CLASSES = f"{DELTAS}, cls AS (SELECT *, {_CLASS} AS class, coalesce(lag({_CLASS}) OVER (PARTITION BY grp ORDER BY seq), 'Pending') AS before FROM dlt)"
R("g13_state_class", f"WITH {CLASSES} SELECT seq, class, before FROM cls")(lambda s, d: classes(s, d).select("seq", "class", "before"))
R("g14_state_dominates", f"""WITH {CLASSES}, x AS (SELECT c.*, {', '.join(f'l.{d}, l.b_{d}' for d in D)} FROM cls c JOIN clk l USING (seq))
    SELECT seq, NOT (class = 'Definite' AND before = 'Uncertain') AND NOT (class = 'Uncertain' AND before = 'Definite') AND {_dom('', 'b_')} AND NOT (class = 'Pending' AND before <> 'Pending') AS dominates FROM x""")(
    lambda s, d: classes(s, d).join(clocks(s, d).drop("grp", "k"), "seq").select("seq", (
        ~((F.col("class") == "Definite") & (F.col("before") == "Uncertain")) & ~((F.col("class") == "Uncertain") & (F.col("before") == "Definite")) & gates.dominates(A, B) & ~((F.col("class") == "Pending") & (F.col("before") != "Pending"))).alias("dominates")))
_KINDS = ["Exact", "Monotone", "StableOnly", "Edge"]
R("g15_triggers_recompute", f"""WITH {CLASSES} SELECT s AS sensitivity, grp, count(*) AS n FROM cls JOIN (VALUES ('Exact'), ('Monotone'), ('StableOnly'), ('Edge')) k(s) ON
    (dims & 2) <> 0 AND (s = 'Exact' OR (s = 'Monotone' AND before = 'Pending' AND class = 'Definite') OR (s = 'StableOnly' AND class = 'Definite') OR (s = 'Edge' AND before <> class)) GROUP BY s, grp""")(
    lambda s, d: classes(s, d).join(F.broadcast(s.createDataFrame([(k,) for k in _KINDS], "sensitivity string")), gates.triggers(F.col("sensitivity"), gates.meets(F.col("dims"), F.lit(2)), F.col("before"), F.col("class"))).groupBy("sensitivity", "grp").agg(F.count(F.lit(1)).alias("n")))

# Authority. Labels come from label operations; nodes bind to partitions; partitions have a class and a domain.
LABELS = f"""{_EDGES}, lab AS (SELECT other AS src, node AS tgt, max_by(k % 16, seq) AS lattice, max_by(1 + k % 7, seq) AS capability, max_by(8 + k % 8, seq) AS scope FROM ops WHERE op = 15 GROUP BY 1, 2),
    bnd AS (SELECT node, max_by(k % 7, seq) AS part FROM ops WHERE op = 13 GROUP BY node), prt AS (SELECT p::INT AS part, p % 4 AS class, 15 - p AS domain FROM range(0, 7) t(p)),
    gate AS (SELECT edge_id, src, tgt, b.part, coalesce(capability, 255) AS capability, coalesce(scope, -1)::BIGINT & coalesce(domain, -1)::BIGINT AS scope, coalesce(lattice, 0)::BIGINT AS lattice,
      CASE WHEN class IS NULL THEN 'UnboundSource' WHEN (class & coalesce(lattice, 0)) <> class THEN 'LatticeViolation' END AS reason
      FROM edges LEFT JOIN lab USING (src, tgt) LEFT JOIN bnd b ON b.node = src LEFT JOIN prt p ON p.part = b.part)"""


def gate(spark, sf_dir):
    o = ops(spark, sf_dir)
    last = lambda e, n: F.max_by(F.expr(e), "seq").alias(n)
    labels = o.where("op = 15").groupBy(F.col("other").alias("src"), F.col("node").alias("tgt")).agg(last("k % 16", "lattice"), last("1 + k % 7", "capability"), last("8 + k % 8", "scope"))
    bind = o.where("op = 13").groupBy("node").agg(last("k % 7", "part"))
    parts = spark.range(7).select(F.col("id").cast("int").alias("part"), (F.col("id") % 4).alias("class"), (15 - F.col("id")).alias("domain"))
    return authority.gated_edges(topology.edges(o).select("edge_id", "src", "tgt"), labels, bind, parts)


R("j1_flows_to", f"WITH {CLOCKS} SELECT seq, ((k % 16) & (grp % 16)) = (k % 16) AS flows FROM clk")(lambda s, d: clocks(s, d).select("seq", gates.flows_to(F.col("k") % 16, F.col("grp") % 16).alias("flows")))
R("j2_capabilities", f"WITH {CLOCKS} SELECT seq, ((k % 16) & (grp % 16)) = (grp % 16) AS allows, (k % 16) | (grp % 16) AS both_, (k % 16) & (grp % 16) AS common FROM clk")(
    lambda s, d: clocks(s, d).select("seq", gates.allows(F.col("grp") % 16, F.col("k") % 16).alias("allows"), (F.col("k") % 16).bitwiseOR(F.col("grp") % 16).alias("both_"), (F.col("k") % 16).bitwiseAND(F.col("grp") % 16).alias("common")))
R("j3_causal_scope", f"WITH {CLOCKS} SELECT seq, ((k % 16) & (grp % 16)) = (grp % 16) AS inside FROM clk")(lambda s, d: clocks(s, d).select("seq", gates.scope_contains(F.col("k") % 16, F.col("grp") % 16).alias("inside")))
R("j4_label_scope", f"WITH {LABELS} SELECT edge_id, capability, scope, lattice FROM gate")(lambda s, d: gate(s, d).select("edge_id", "capability", "scope", "lattice"))
R("j5_emitted_auth", f"WITH {LABELS} SELECT edge_id, part, part IS NULL AS unbound FROM gate")(lambda s, d: gate(s, d).select("edge_id", "part", F.col("part").isNull().alias("unbound")))
R("j6_authority_gate", f"WITH {LABELS} SELECT edge_id, reason FROM gate")(lambda s, d: gate(s, d).select("edge_id", "reason"))
_DECIDED = [(m, u) for m in ("Advisory", "Audit", "Enforced") for u in ("Allow", "AuditOnly", "Deny")]


@R("j7_try_auth", f"""WITH {LABELS}, m AS (SELECT m, u FROM (VALUES ('Advisory'), ('Audit'), ('Enforced')) x(m), (VALUES ('Allow'), ('AuditOnly'), ('Deny')) y(u))
    SELECT m AS mode, u AS unbound, count(*) FILTER (WHERE m = 'Advisory' OR reason IS NULL OR m = 'Audit' OR (reason = 'UnboundSource' AND u <> 'Deny')) AS passed,
      count(*) FILTER (WHERE m <> 'Advisory' AND CASE WHEN reason = 'UnboundSource' THEN u = 'AuditOnly' OR (u = 'Deny' AND m = 'Audit') ELSE reason IS NOT NULL AND m = 'Audit' END) AS audited
    FROM gate, m GROUP BY m, u""")
def try_auth(spark, sf_dir):
    """One pass over the edges, a pair of counts for each mode and policy."""
    cols = [F.struct(F.lit(m).alias("mode"), F.lit(u).alias("unbound"), *[F.count_if(x).alias(n) for x, n in zip(authority.decide(F.col("reason"), m, u), ("passed", "audited"), strict=True)]) for m, u in _DECIDED]
    return gate(spark, sf_dir).agg(F.array(*cols).alias("r")).select(F.explode("r").alias("r")).select("r.*")


R("j8_mode_defaults", "SELECT * FROM (VALUES ('Advisory', 'Allow'), ('Audit', 'AuditOnly'), ('Enforced', 'Deny')) v(mode, unbound)")(
    lambda s, d: s.createDataFrame([("Advisory", "Allow"), ("Audit", "AuditOnly"), ("Enforced", "Deny")], "mode string, unbound string"))
R("j9_delete_guard", f"WITH {_EDGES}, r AS (SELECT src AS node FROM edges WHERE edge_id % 3 = 0 UNION SELECT tgt FROM edges WHERE edge_id % 3 = 0) SELECT seq, node, node IN (SELECT node FROM r) AS forbidden FROM ops WHERE op = 6")(
    lambda s, d: authority.guarded_deletes(ops(s, d).where("op = 6").select("seq", "node"), topology.edges(ops(s, d)).withColumn("remote", F.col("edge_id") % 3 == 0)).select("seq", "node", "forbidden"))
_ZK = ["Conflict", "Incomplete", "Ambiguous", "Retracted", "BoundaryViolation", "VersionSkew"]
_ZSQL = "([" + ", ".join(f"'{z}'" for z in _ZK) + "])[k % 6 + 1]"


def zero_kind(k):
    return F.element_at(F.array(*[F.lit(z) for z in _ZK]), (k % 6 + 1).cast("int"))


R("j10_payload_kinds", f"WITH {OPS} SELECT CASE WHEN val = 0 THEN 'TypedZero' ELSE 'Definite' END AS payload, CASE WHEN val = 0 THEN {_ZSQL} END AS zero_kind, count(*) AS n FROM ops GROUP BY 1, 2")(
    lambda s, d: ops(s, d).groupBy(F.when(F.col("val") == 0, "TypedZero").otherwise("Definite").alias("payload"), F.when(F.col("val") == 0, zero_kind(F.col("k"))).alias("zero_kind")).agg(F.count(F.lit(1)).alias("n")))

# Boundary streams: nodes are customers, partitions their nations, types their market segments.
SUBS = [(1, "uid", [5], None, None), (2, "uid_set", [1, 2, 3, 900], None, None), (3, "partition", [], 7, None), (4, "typed", [], None, "BUILDING"), (5, "partition", [], 7, None)]


def matches(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("partition"), F.col("c_mktsegment").alias("typ"))
    s = spark.createDataFrame(SUBS, "stream_id long, scope_kind string, uids array<long>, partition long, typ string")
    return observe.scope_matches(s, n)


SCOPES = "hit AS (SELECT s.stream_id, c_custkey AS node FROM (VALUES (1, [5], -1, ''), (2, [1, 2, 3, 900], -1, ''), (3, []::INT[], 7, ''), (4, []::INT[], -1, 'BUILDING'), (5, []::INT[], 7, '')) s(stream_id, uids, part, typ) JOIN customer ON list_contains(uids, c_custkey) OR c_nationkey = part OR c_mktsegment = typ)"
R("k1_scope_match", f"WITH {SCOPES} SELECT stream_id::BIGINT AS stream_id, node FROM hit")(matches)
R("k2_shared_delivery", f"WITH {SCOPES}, k AS (SELECT node, (CASE WHEN stream_id = 5 THEN 3 ELSE stream_id END)::BIGINT AS key FROM hit) SELECT key, count(DISTINCT node) AS delivered, count(*) AS wanted FROM k GROUP BY key")(
    lambda s, d: matches(s, d).withColumn("key", F.when(F.col("stream_id") == 5, 3).otherwise(F.col("stream_id")).cast("long")).groupBy("key").agg(F.count_distinct("node").alias("delivered"), F.count(F.lit(1)).alias("wanted")))
_EMIT = f"CASE WHEN val = -1 THEN 'Pending' WHEN val = 0 THEN 'TypedZero:' || {_ZSQL} ELSE 'Value:' || val END"
R("k3_emit", f"WITH {OPS} SELECT seq, {_EMIT} AS emitted FROM ops WHERE op = 3")(
    lambda s, d: ops(s, d).where("op = 3").select("seq", observe.emitted(F.col("val"), F.when(F.col("val") == 0, zero_kind(F.col("k")))).alias("emitted")))
R("k4_remote_events", f"WITH {OPS} SELECT node, count(*) FILTER (WHERE val = -1) AS pending, count(*) FILTER (WHERE val = 0) AS zeros, count(*) FILTER (WHERE val = 1) AS vals FROM ops WHERE op = 3 GROUP BY node")(
    lambda s, d: ops(s, d).where("op = 3").groupBy("node").agg(F.count_if(F.col("val") == -1).alias("pending"), F.count_if(F.col("val") == 0).alias("zeros"), F.count_if(F.col("val") == 1).alias("vals")))
R("k5_stream_drain", f"WITH {OPS} SELECT seq // 1000 AS batch, count(*) AS n, max(seq) AS last_seq FROM ops WHERE op = 3 GROUP BY 1")(
    lambda s, d: ops(s, d).where("op = 3").groupBy(F.expr("seq div 1000").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")))
R("k6_payload_kind", f"WITH {OPS} SELECT seq, CASE WHEN val = 0 THEN 'TypedZero' ELSE 'Definite' END AS kind FROM ops WHERE op = 3")(
    lambda s, d: ops(s, d).where("op = 3").select("seq", F.when(F.col("val") == 0, "TypedZero").otherwise("Definite").alias("kind")))
