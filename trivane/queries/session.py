"""L, M, N, P and Q: codecs, gating, admission, placement, lifecycle, simulation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import oplog
from ..operators import session as ss
from ..sources import codec
from .base import OPS, Registry, ops, table

R = Registry()


def records(spark, sf_dir):
    """Record headers made of events; some are wrong in each of the ways that are checked."""
    o = ops(spark, sf_dir)
    s = F.col("seq")
    op = F.when(s % 43 == 0, 0).when(s % 23 == 0, 256).when(s % 29 == 0, 999).otherwise(F.col("op"))
    return o.select(
        s.alias("pos"), op.cast("int").alias("opcode"), F.when(s % 41 == 0, 47).otherwise(48 + F.col("k") % 100).cast("long").alias("length"),
        F.when(s % 11 == 0, 0).when(s % 17 == 0, 99).otherwise(F.col("node") % 25).cast("long").alias("tenant_id"), F.col("node").alias("session_id"),
        F.when(s % 47 == 0, -1).otherwise(F.col("node")).cast("long").alias("stream_session"), (F.col("k") % 12).cast("long").alias("partition_id"),
        (F.expr("seq div 100") - F.when(s % 37 == 0, 3).otherwise(0)).alias("causal_epoch"), (s - F.when(s % 31 == 0, 1500).otherwise(0)).alias("stream_seq"), F.col("k"), F.col("val"))


RECORDS = f"""{OPS}, rec AS (SELECT seq AS pos, CASE WHEN seq % 43 = 0 THEN 0 WHEN seq % 23 = 0 THEN 256 WHEN seq % 29 = 0 THEN 999 ELSE op END AS opcode, (CASE WHEN seq % 41 = 0 THEN 47 ELSE 48 + k % 100 END)::BIGINT AS length,
    (CASE WHEN seq % 11 = 0 THEN 0 WHEN seq % 17 = 0 THEN 99 ELSE node % 25 END)::BIGINT AS tenant_id, node AS session_id, (CASE WHEN seq % 47 = 0 THEN -1 ELSE node END)::BIGINT AS stream_session, (k % 12)::BIGINT AS partition_id,
    seq // 100 - CASE WHEN seq % 37 = 0 THEN 3 ELSE 0 END AS causal_epoch, seq - CASE WHEN seq % 31 = 0 THEN 1500 ELSE 0 END AS stream_seq, k, val FROM ops)"""
_PRE = "OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CHECKED = f"""{RECORDS}, r1 AS (SELECT *, CASE WHEN length < 48 THEN 'InvalidLength' WHEN opcode = 0 THEN 'InvalidOpcode' WHEN session_id <> stream_session THEN 'SessionIdMismatch' END AS p FROM rec),
    r2 AS (SELECT *, p IS NULL AND stream_seq > coalesce(max(CASE WHEN p IS NULL THEN stream_seq END) {_PRE}, -999999) AS ok FROM r1),
    chk AS (SELECT *, coalesce(p, CASE WHEN NOT ok THEN 'StreamSeqGap' END, CASE WHEN causal_epoch < max(CASE WHEN ok THEN causal_epoch END) {_PRE} THEN 'EpochRegression' END) AS error FROM r2)"""
_CLS = "CASE WHEN opcode IN (1, 2, 6, 7, 9) OR opcode BETWEEN 12 AND 18 THEN 'Control' WHEN opcode = 3 THEN 'SetValue' WHEN opcode = 4 THEN 'Propagate' WHEN opcode = 5 THEN 'Subscribe' WHEN opcode = 8 THEN 'Demand' WHEN opcode = 10 THEN 'Data' WHEN opcode = 11 THEN 'Stabilize' WHEN opcode = 256 THEN 'Profile' ELSE 'Unknown' END"

R("l2_record_checks", f"WITH {CHECKED} SELECT pos, error FROM chk")(lambda s, d: ss.header_errors(records(s, d)).select("pos", "error"))
R("l3_skip_unknown", f"WITH {CHECKED} SELECT opcode, count(*) AS n, sum(length - 48)::BIGINT AS skipped FROM chk WHERE error IS NULL AND {_CLS} = 'Unknown' GROUP BY opcode")(
    lambda s, d: ss.header_errors(records(s, d)).where(F.col("error").isNull() & (ss.opcode_class(F.col("opcode")) == "Unknown")).groupBy("opcode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length") - 48).alias("skipped")))


def _fields(x) -> dict:
    """An operation's payload fields from a row of ``ops``."""
    return {
        1: {"node": x.node, "typ": f"t{x.k % 3}", "rule": x.k % 11, "attrs": {"w": (6, x.val), "n": (2, x.k)}}, 2: {"edge_id": x.seq, "src": x.other, "tgt": x.node, "dep_kind": 0, "port_kind": x.k % 4, "port_name": "p"},
        3: {"node": x.node, "val": x.val}, 4: {"node": x.node}, 5: {"src": x.other, "node": x.node}, 6: {"node": x.node}, 7: {"edge_id": x.k}, 8: {"node": x.node}, 9: {"node": x.node, "mode": x.k % 3}, 10: {"node": x.node},
        11: {"nodes": [x.node, x.other]}, 12: {"partition": x.k, "root": x.node, "lattice": x.k % 16, "domain": x.k % 8}, 13: {"node": x.node, "partition": x.k}, 14: {"partition": x.k, "lattice": x.k % 16, "domain": x.k % 8},
        15: {"src": x.other, "node": x.node, "lattice": x.k, "capability": 1 + x.k % 7, "scope": x.k % 16}, 16: {"node": x.node, "strategy": 0, "domain": 0, "iterations": x.k, "convergence": 0}, 17: {"node": x.node, "priority": 0, "retry": 0},
        18: {"root": x.node, "boundary": 0, "region": x.k, "stability": 0, "compile": 0},
    }[x.op]


def encoded(spark, sf_dir):
    """Operations of all 18 kinds as binary records."""

    def run(batches):
        for b in batches:
            out = [codec.record(x.op, codec.encode(x.op, _fields(x)), session=x.node, seq=x.seq) for x in b.itertuples(index=False)]
            yield pd.DataFrame({"seq": b["seq"], "record": out})

    return ops(spark, sf_dir).mapInPandas(run, "seq long, record binary")


def decoded(batches):
    for b in batches:
        rows = []
        for seq, data in zip(b["seq"], b["record"], strict=True):
            head = codec.HEADER.unpack_from(data)
            f = codec.decode(head[0], data[codec.HEADER.size :])
            node = f.get("node", f.get("tgt", f.get("root", f.get("nodes", [None])[0])))
            rows.append((seq, head[0], head[7], node, f.get("src"), f.get("val"), f.get("rule"), f.get("lattice"), f.get("attrs", {}).get("w", (0, None))[1], f.get("partition"), f.get("mode")))
        yield pd.DataFrame(rows, columns=["seq", "op", "stream_seq", "node", "src", "val", "rule", "lattice", "attr", "part", "mode"]).astype({c: "Int64" for c in ("node", "src", "val", "rule", "lattice", "attr", "part", "mode")})


R("l4_payload_round_trip", f"""WITH {OPS} SELECT seq, op, seq AS stream_seq, CASE WHEN op NOT IN (7, 14) THEN node END AS node, CASE WHEN op IN (2, 5, 15) THEN other END AS src, CASE WHEN op = 3 THEN val END AS val, CASE WHEN op = 1 THEN k % 11 END AS rule,
    CASE WHEN op = 15 THEN k WHEN op IN (12, 14) THEN k % 16 END::BIGINT AS lattice, CASE WHEN op = 1 THEN val END AS attr, CASE WHEN op IN (12, 13, 14) THEN k END::BIGINT AS part, CASE WHEN op = 9 THEN k % 3 END AS mode FROM ops""")(
    lambda s, d: encoded(s, d).mapInPandas(decoded, "seq long, op int, stream_seq long, node long, src long, val int, rule int, lattice long, attr int, part long, mode int"))
_SIZES = "CASE op WHEN 1 THEN 8 + 2 + 2 + 1 + 2 + (2 + 1 + 1 + 1) + (2 + 1 + 1 + 8) WHEN 2 THEN 24 + 2 + 2 + 1 WHEN 3 THEN 9 WHEN 5 THEN 16 WHEN 9 THEN 9 WHEN 11 THEN 4 + 16 WHEN 12 THEN 32 WHEN 13 THEN 16 WHEN 14 THEN 24 WHEN 15 THEN 33 WHEN 16 THEN 15 WHEN 17 THEN 10 WHEN 18 THEN 15 ELSE 8 END"
R("l6_record_bytes", f"WITH {OPS} SELECT op, sum(48 + {_SIZES})::BIGINT AS bytes, count(*) AS n FROM ops GROUP BY op")(
    lambda s, d: encoded(s, d).join(ops(s, d).select("seq", "op"), "seq").groupBy("op").agg(F.sum(F.octet_length("record")).alias("bytes"), F.count(F.lit(1)).alias("n")))
R("l7_wire_mappings", f"WITH {OPS} SELECT seq, CASE val WHEN -1 THEN 255 ELSE val END AS wire_byte FROM ops WHERE op = 3")(
    lambda s, d: ops(s, d).where("op = 3").select("seq", F.when(F.col("val") == -1, 255).otherwise(F.col("val")).alias("wire_byte")))
R("l9_telemetry_ring", f"WITH {OPS}, t AS (SELECT seq, row_number() OVER (ORDER BY seq DESC) AS r FROM ops WHERE op = 3) SELECT min(seq) FILTER (WHERE r <= 4096) AS oldest, count(*) FILTER (WHERE r <= 4096) AS kept, count(*) FILTER (WHERE r > 4096) AS dropped FROM t")(
    lambda s, d: _ring(ops(s, d).where("op = 3").select("seq"), 4096))


def _ring(events, size):
    """The newest ``size`` events and how many were dropped. The limit is the buffer's feature."""
    kept = events.orderBy(F.desc("seq")).limit(size).agg(F.min("seq").alias("oldest"), F.count(F.lit(1)).alias("kept"))
    return kept.join(F.broadcast(events.agg(F.count(F.lit(1)).alias("all"))), how="cross").select("oldest", "kept", (F.col("all") - F.col("kept")).alias("dropped"))  # one row each


R("l10_node_names", f"WITH {OPS} SELECT seq, 'shard::' || (k % 3) || '::depth' AS name FROM ops WHERE op = 3")(
    lambda s, d: ops(s, d).where("op = 3").select("seq", F.concat_ws("::", F.lit("shard"), (F.col("k") % 3).cast("string"), F.lit("depth")).alias("name")))
R("l11_json_ops", f"WITH {OPS} SELECT seq, op, node, val FROM ops")(
    lambda s, d: ops(s, d).select(F.to_json(F.struct("seq", "op", "node", "val")).alias("j")).select(F.from_json("j", "seq long, op int, node long, val int").alias("x")).select("x.*"))

# Gating.
R("m1_opcode_classes", f"WITH {RECORDS} SELECT pos, {_CLS} AS cls, {_CLS} IN ('Control', 'Profile', 'Subscribe') AS control FROM rec")(
    lambda s, d: records(s, d).select("pos", ss.opcode_class(F.col("opcode")).alias("cls")).withColumn("control", ss.control_plane(F.col("cls"))))


def dims(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    ses = users.where("id % 10 <> 9").select(F.col("id").alias("session_id"), (F.col("id") % 25).alias("s_tenant"), (F.col("id") % 3 * 100).alias("floor"), (F.col("id") % 8).alias("assertion"), (F.col("id") % 4).alias("delegation"), (F.col("id") % 16).alias("observability"))
    rows = spark.range(4).crossJoin(spark.createDataFrame([("SetValue",), ("Demand",)], "cls string")).select(F.col("id").alias("partition_id"), "cls", F.col("id").alias("r_assertion"), F.lit(0).cast("long").alias("r_delegation"), (F.col("id") * 2).alias("r_observability"))
    parts = spark.range(9).select(F.col("id").alias("partition_id"), (F.col("id") % 3).cast("int").alias("shard_id"))
    press = spark.createDataFrame([(0, 0), (1, 1500), (2, 6000)], "shard_id int, depth int")
    return ses, rows, parts, press


_ADM = """CASE WHEN cls IN ('Control', 'Profile', 'Subscribe') THEN 'ControlPlane' WHEN cls = 'Demand' THEN 'Prioritize' WHEN cls = 'Stabilize' THEN 'SlowLane' WHEN cls = 'SetValue' THEN CASE WHEN depth >= 1000 THEN 'Coalesce' ELSE 'Allow' END
    WHEN cls = 'Propagate' THEN CASE WHEN depth >= 5000 THEN 'Drop' ELSE 'Allow' END WHEN cls = 'Data' THEN CASE WHEN depth >= 1000 THEN 'Delay' ELSE 'Allow' END ELSE 'Drop' END"""
ROUTED = f"""{RECORDS}, x AS (SELECT *, {_CLS} AS cls, CASE WHEN partition_id < 9 THEN partition_id % 3 WHEN {_CLS} IN ('Control', 'Profile', 'Subscribe') THEN 0 END AS shard FROM rec),
    y AS (SELECT *, CASE shard WHEN 1 THEN 1500 WHEN 2 THEN 6000 ELSE 0 END AS depth FROM x), z AS (SELECT *, {_ADM} AS decision FROM y),
    rt AS (SELECT *, CASE WHEN session_id % 10 = 9 THEN 'SessionNotFound' WHEN tenant_id <> 0 AND tenant_id <> session_id % 25 THEN 'TenantMismatch' WHEN stream_seq < session_id % 3 * 100 THEN 'StreamSeqReplay'
      WHEN partition_id < 4 AND (cls = 'SetValue' AND (session_id % 8 & partition_id) <> partition_id OR cls = 'Demand' AND (session_id % 16 & (partition_id * 2)) <> partition_id * 2) THEN 'AuthGateDenied'
      WHEN shard IS NULL THEN 'UnknownPartition' WHEN decision = 'Drop' THEN 'Shed' WHEN decision = 'Delay' THEN 'Delay' ELSE 'Admitted' END AS outcome FROM z)"""


def routed(spark, sf_dir):
    return ss.route(records(spark, sf_dir), *dims(spark, sf_dir))


R("m2_route_record", f"WITH {ROUTED} SELECT pos, cls, outcome FROM rt")(lambda s, d: routed(s, d).select("pos", "cls", "outcome"))
R("m3_policy_algebra", f"WITH {OPS} SELECT seq, (k & node) AS both_, (k & node) = k AS bounded FROM ops")(
    lambda s, d: ops(s, d).select("seq", F.col("k").cast("long").bitwiseAND(F.col("node")).alias("both_")).join(ops(s, d).select("seq", "k"), "seq").select("seq", "both_", (F.col("both_") == F.col("k")).alias("bounded")))
R("m4_partition_gate", f"WITH {ROUTED} SELECT partition_id, cls, count(*) FILTER (WHERE outcome = 'AuthGateDenied') AS denied, count(*) AS n FROM rt GROUP BY partition_id, cls")(
    lambda s, d: routed(s, d).groupBy("partition_id", "cls").agg(F.count_if(F.col("outcome") == "AuthGateDenied").alias("denied"), F.count(F.lit(1)).alias("n")))
R("m5_effective_policy", f"WITH {OPS} SELECT DISTINCT node, (node % 64) & (node % 25 * 3) AS policy FROM ops")(
    lambda s, d: ops(s, d).select("node", (F.col("node") % 64).bitwiseAND(F.col("node") % 25 * 3).alias("policy")).distinct())
R("m6_disclosure", f"WITH {OPS} SELECT seq, ((node % 16) & (k % 16)) = (k % 16) AS disclosed FROM ops WHERE op = 15")(
    lambda s, d: ops(s, d).where("op = 15").select("seq", ((F.col("node") % 16).bitwiseAND((F.col("k") % 16).cast("long")) == F.col("k") % 16).alias("disclosed")))
R("m7_admission", f"WITH {ROUTED} SELECT cls, shard::INT AS shard_id, decision, count(*) AS n FROM rt GROUP BY 1, 2, 3")(lambda s, d: routed(s, d).groupBy("cls", "shard_id", "decision").agg(F.count(F.lit(1)).alias("n")))
R("m8_coalescing", f"WITH {ROUTED} SELECT session_id, partition_id, max(pos) AS pos, max_by(val, pos) AS val FROM rt WHERE decision = 'Coalesce' GROUP BY 1, 2")(
    lambda s, d: routed(s, d).where("decision = 'Coalesce'").groupBy("session_id", "partition_id").agg(F.max("pos").alias("pos"), F.max_by("val", "pos").alias("val")))


@R("m9_profile_advisory", f"""WITH {OPS} SELECT seq, CASE WHEN k % 3 <> 0 THEN 'WrongTrustLevel' WHEN other <> node AND k % 2 = 0 THEN 'SessionMismatch' WHEN k % 5 <> 0 AND seq // 100 > k THEN 'Expired' WHEN k % 7 < 2 THEN 'GenerationRevoked' ELSE 'Ok' END AS verdict, CASE WHEN verdict = 'Ok' THEN k & node END::BIGINT AS policy FROM ops""")
def profile_advisory(spark, sf_dir):
    """Trust level, session, expiry (never, where k divides by five), generation; first failure counts. What is
    claimed (k) is clipped to what the parent has (the node's number)."""
    k = F.col("k")
    v = F.when(k % 3 != 0, "WrongTrustLevel").when((F.col("other") != F.col("node")) & (k % 2 == 0), "SessionMismatch").when((k % 5 != 0) & (F.expr("seq div 100") > k), "Expired").when(k % 7 < 2, "GenerationRevoked").otherwise("Ok")
    return ops(spark, sf_dir).select("seq", v.alias("verdict"), F.when(v == "Ok", k.cast("long").bitwiseAND(F.col("node"))).alias("policy"))


R("m11_seq_floor", f"WITH {RECORDS}, f AS (SELECT *, coalesce(max(CASE WHEN k % 9 = 0 THEN stream_seq + 1 END) {_PRE}, 0) AS floor FROM rec) SELECT pos, stream_seq >= floor AS valid FROM f")(lambda s, d: _floor(records(s, d)))


def _floor(r):
    """Every ninth record acknowledges; the floor is one past the highest acknowledged before."""
    w = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return r.select("pos", (F.col("stream_seq") >= F.coalesce(F.max(F.when(F.col("k") % 9 == 0, F.col("stream_seq") + 1)).over(w), F.lit(0))).alias("valid"))


R("m12_path_lifecycle", f"WITH {RECORDS}, p AS (SELECT pos, session_id, k FROM rec WHERE opcode = 256), q AS (SELECT *, lead(pos) OVER w AS next, lead(pos, 2) OVER w AS after FROM p WINDOW w AS (PARTITION BY session_id ORDER BY pos)) SELECT pos AS path, session_id, CASE WHEN next IS NULL THEN 'Active' WHEN after IS NULL THEN 'Draining' ELSE 'Closed' END AS state FROM q")(lambda s, d: _paths(records(s, d)))


def _paths(r):
    """A session's latest path is active, the one before drains, older ones are closed."""
    w = Window.partitionBy("session_id").orderBy("pos")
    p = r.where("opcode = 256").select(F.col("pos").alias("path"), "session_id", F.lead("pos", 1).over(w).alias("next"), F.lead("pos", 2).over(w).alias("after"))
    return p.select("path", "session_id", F.when(F.col("next").isNull(), "Active").when(F.col("after").isNull(), "Draining").otherwise("Closed").alias("state"))


ACTIVITY = f"""{ROUTED}, lastly AS (SELECT session_id, max(causal_epoch) FILTER (WHERE outcome = 'Admitted') AS last_active, max(pos) FILTER (WHERE outcome = 'Admitted') AS last_pos FROM rt GROUP BY session_id),
    act AS (SELECT rt.session_id, any_value(last_active) AS last_active, count(*) FILTER (WHERE last_pos IS NULL OR pos > last_pos) AS idle FROM rt JOIN lastly USING (session_id) GROUP BY rt.session_id)"""


def activity(spark, sf_dir):
    """Each session's last epoch with an admitted record, and its records since: any admitted one starts the count anew."""
    r = routed(spark, sf_dir).select("session_id", "pos", "causal_epoch", (F.col("outcome") == "Admitted").alias("admitted"))
    last = r.groupBy("session_id").agg(F.max(F.when(F.col("admitted"), F.col("causal_epoch"))).alias("last_active"), F.max(F.when(F.col("admitted"), F.col("pos"))).alias("at"))
    return r.join(last, "session_id").groupBy("session_id").agg(F.first("last_active").alias("last_active"), F.count_if(F.col("at").isNull() | (F.col("pos") > F.col("at"))).alias("idle"))


R("m13_activity", f"WITH {ACTIVITY} SELECT session_id, last_active, idle FROM act")(activity)
R("m14_reaper", f"WITH {ACTIVITY} SELECT session_id, CASE WHEN (SELECT max(seq // 100) FROM ops) - last_active > 12 THEN 'Inactivity' WHEN (SELECT max(last_active) FROM act) - last_active > 8 THEN 'EpochLag' WHEN idle >= 30 THEN 'ZeroFrustration' END AS reason FROM act")(lambda s, d: _reap(activity(s, d), ops(s, d)))


def _reap(a, o):
    tops = a.agg(F.max("last_active").alias("front")).join(F.broadcast(o.agg(F.max(F.expr("seq div 100")).alias("now"))), how="cross")
    return a.join(F.broadcast(tops), how="cross").select("session_id", ss.expiry(F.col("last_active"), F.col("idle"), F.col("now"), F.col("front"), 12, 8, 30).alias("reason"))  # one row of maxima


R("m15_control_feedback", f"WITH {OPS}, c AS (SELECT node AS partition_id, max(seq) AS seq, max_by(k, seq) AS lattice FROM ops WHERE op IN (12, 14) GROUP BY node) SELECT partition_id, cls, lattice FROM c, (VALUES ('SetValue'), ('Propagate'), ('Demand')) v(cls)")(
    lambda s, d: ops(s, d).where("op in (12, 14)").groupBy(F.col("node").alias("partition_id")).agg(F.max_by("k", "seq").alias("lattice")).withColumn("cls", F.explode(F.array(F.lit("SetValue"), F.lit("Propagate"), F.lit("Demand")))).select("partition_id", "cls", "lattice"))


# Fabric: shards are suppliers, addressed by region, nation, a hundredth and a tenth of their key.
FABRIC = "fab AS (SELECT s_suppkey AS shard_id, n_regionkey AS region, s_nationkey AS pod, s_suppkey % 4 AS rack, s_suppkey % 3 AS leaf, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
_HOP = "CASE WHEN a.region <> b.region THEN 16 WHEN a.pod <> b.pod THEN 8 WHEN a.rack <> b.rack THEN 4 WHEN a.leaf <> b.leaf THEN 2 ELSE 1 END"


def fabric(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("shard_id"), F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("pod"), (F.col("s_suppkey") % 4).alias("rack"), (F.col("s_suppkey") % 3).alias("leaf"), "s_acctbal")


R("m17_fabric_metrics", f"WITH {FABRIC} SELECT a.shard_id AS a, max({_HOP}) FILTER (WHERE a.shard_id <> b.shard_id)::INT AS radius, count(*) FILTER (WHERE {_HOP} = 16) AS remote FROM fab a, fab b GROUP BY 1")(
    lambda s, d: ss.fabric_metrics(fabric(s, d)))
R("m16_shard_pick", f"WITH {FABRIC} SELECT coalesce((SELECT min(shard_id) FROM fab WHERE s_acctbal > 9000 AND region = 1), (SELECT min(shard_id) FROM fab WHERE s_acctbal > 5000), 0) AS shard_id")(
    lambda s, d: fabric(s, d).agg(F.coalesce(F.min(F.when((F.col("s_acctbal") > 9000) & (F.col("region") == 1), F.col("shard_id"))), F.min(F.when(F.col("s_acctbal") > 5000, F.col("shard_id"))), F.lit(0)).alias("shard_id")))
R("m18_health", f"WITH {OPS} SELECT seq, CASE WHEN k % 50 = 0 THEN -1 WHEN k * 5 >= 500 THEN 0 ELSE 1 END AS health FROM ops")(
    lambda s, d: ops(s, d).select("seq", ss.health(F.col("k") * 5, F.when(F.col("k") % 50 == 0, 1).otherwise(0)).alias("health")))
_H = "CASE WHEN k % 50 = 0 THEN -1 WHEN k * 5 >= 500 THEN 0 ELSE 1 END"
R("m19_topology_transitions", f"WITH {OPS}, h AS (SELECT seq, node AS shard, {_H} AS health, coalesce(lag({_H}) OVER (PARTITION BY node ORDER BY seq), -1) AS old FROM ops) SELECT shard, seq, old, health FROM h WHERE old <> health")(
    lambda s, d: ss.transitions(ops(s, d).select("seq", F.col("node").alias("shard"), ss.health(F.col("k") * 5, F.when(F.col("k") % 50 == 0, 1).otherwise(0)).alias("health")), "shard", "health").select("shard", "seq", "old", "health"))
R("m20_best_shard", f"WITH {FABRIC}, x AS (SELECT a.shard_id AS a, b.shard_id AS best, row_number() OVER (PARTITION BY a.shard_id ORDER BY {_HOP}, b.shard_id) AS r FROM fab a, fab b WHERE b.s_acctbal > 0) SELECT a, best FROM x WHERE r = 1")(
    lambda s, d: ss.best_shards(fabric(s, d), F.col("s_acctbal") > 0))
R("m21_quiescence_streak", f"WITH {OPS}, g AS (SELECT *, count(*) FILTER (WHERE op IN (3, 4)) OVER (PARTITION BY node ORDER BY seq) AS grp FROM ops) SELECT node, seq, count(*) FILTER (WHERE op IN (10, 11)) OVER (PARTITION BY node, grp ORDER BY seq) AS streak FROM g")(
    lambda s, d: ss.streak(ops(s, d), "node", F.col("op").isin(10, 11), F.col("op").isin(3, 4)).select("node", "seq", "streak"))
R("m22_profile_bootstrap", f"WITH {RECORDS} SELECT pos, session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) = 1 AS creates FROM rec WHERE opcode = 256")(
    lambda s, d: records(s, d).where("opcode = 256").select("pos", "session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) == 1).alias("creates")))
R("m23_engine_pool", f"WITH {ROUTED} SELECT shard::INT AS shard_id, count(*) AS n, count(DISTINCT session_id) AS sessions, max(pos) AS last_pos FROM rt WHERE outcome = 'Admitted' GROUP BY 1")(
    lambda s, d: routed(s, d).where("outcome = 'Admitted'").groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"), F.max("pos").alias("last_pos")))
R("m24_recovery", f"WITH {OPS} SELECT seq, 100 > 0 AND (k % 101) * 10 >= 100 * 9 AS near_limit, CASE k % 4 WHEN 2 THEN 'Escalate' WHEN 3 THEN 'Shed' ELSE 'Requeue' END AS action FROM ops")(
    lambda s, d: ops(s, d).select("seq", ((F.col("k") % 101) * 10 >= 900).alias("near_limit"), F.when(F.col("k") % 4 == 2, "Escalate").when(F.col("k") % 4 == 3, "Shed").otherwise("Requeue").alias("action")))
R("m25_quotas", f"WITH {ROUTED} SELECT session_id % 25 AS tenant, count(*) AS used, count(*) > 300 AS over FROM rt WHERE outcome = 'Admitted' GROUP BY 1")(
    lambda s, d: routed(s, d).where("outcome = 'Admitted'").groupBy((F.col("session_id") % 25).alias("tenant")).agg(F.count(F.lit(1)).alias("used"), (F.count(F.lit(1)) > 300).alias("over")))
R("m26_bootstrap", f"WITH {RECORDS} SELECT session_id, min(pos) FILTER (WHERE opcode = 256) AS created, count(*) FILTER (WHERE opcode <> 256) AS others FROM rec GROUP BY session_id")(
    lambda s, d: records(s, d).groupBy("session_id").agg(F.min(F.when(F.col("opcode") == 256, F.col("pos"))).alias("created"), F.count_if(F.col("opcode") != 256).alias("others")))

# Simulation: pressure messages from observers, delivered after a delay, dropped where links are cut.
MSG = f"{OPS}, msg AS (SELECT seq AS tick, node % 8 AS observer, other % 8 AS target, {_H} AS health, seq + k % 5 AS deliver_at, (node % 8 = 3 AND other % 8 = 5) AS cut FROM ops)"


def messages(spark, sf_dir):
    h = ss.health(F.col("k") * 5, F.when(F.col("k") % 50 == 0, 1).otherwise(0))
    return ops(spark, sf_dir).select(F.col("seq").alias("tick"), (F.col("node") % 8).alias("observer"), (F.col("other") % 8).alias("target"), h.alias("health"), (F.col("seq") + F.col("k") % 5).alias("deliver_at"), ((F.col("node") % 8 == 3) & (F.col("other") % 8 == 5)).alias("cut"))


R("n2_tick_delivery", f"WITH {MSG} SELECT deliver_at AS tick, count(*) AS n FROM msg GROUP BY 1")(lambda s, d: messages(s, d).groupBy(F.col("deliver_at").alias("tick")).agg(F.count(F.lit(1)).alias("n")))
R("n3_crashes", f"WITH {MSG} SELECT observer, count(*) FILTER (WHERE health = -1) AS crashes, max(tick) FILTER (WHERE health = 1) AS healed FROM msg GROUP BY observer")(
    lambda s, d: messages(s, d).groupBy("observer").agg(F.count_if(F.col("health") == -1).alias("crashes"), F.max(F.when(F.col("health") == 1, F.col("tick"))).alias("healed")))
R("n4_faults", f"WITH {MSG} SELECT cut, count(*) AS n, max(deliver_at - tick)::BIGINT AS delay FROM msg GROUP BY cut")(lambda s, d: messages(s, d).groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("deliver_at") - F.col("tick")).alias("delay")))
R("n5_drain_due", f"WITH {MSG} SELECT tick, observer, target FROM msg WHERE deliver_at <= 5000 AND NOT cut")(lambda s, d: messages(s, d).where("deliver_at <= 5000 and not cut").select("tick", "observer", "target"))
R("n6_health_seen", f"WITH {MSG} SELECT observer, target, max_by(health, deliver_at * 1000000 + tick) AS health FROM msg WHERE NOT cut GROUP BY observer, target")(
    lambda s, d: messages(s, d).where("not cut").groupBy("observer", "target").agg(F.max_by("health", F.struct("deliver_at", "tick")).alias("health")))
R("n7_reap_all", f"WITH {ACTIVITY} SELECT session_id % 3 AS shard, count(*) FILTER (WHERE (SELECT max(seq // 100) FROM ops) - last_active > 12) AS reaped FROM act GROUP BY 1")(
    lambda s, d: _reap(activity(s, d), ops(s, d)).groupBy((F.col("session_id") % 3).alias("shard")).agg(F.count_if(F.col("reason") == "Inactivity").alias("reaped")))
R("n8_workload", "SELECT i AS seq, (i % 10)::BIGINT AS node, ((i // 10) % 3 - 1)::INT AS val FROM range(0, 1000) t(i)")(
    lambda s, d: s.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 10).alias("node"), (F.expr("id div 10") % 3 - 1).cast("int").alias("val")))


@R("n1_generator", """WITH RECURSIVE g(i, x) AS (SELECT 0, 3735928559::HUGEINT UNION ALL SELECT i + 1, (x * 6364136223846793005 % 18446744073709551616 + 1442695040888963407) % 18446744073709551616 FROM g WHERE i < 99) SELECT i, (x % 1000000007)::BIGINT AS r FROM g""")
def generator(spark, sf_dir):
    """The first hundred numbers of the seeded generator; a driver-side helper of simulations."""
    x, out = 0xDEADBEEF, []
    for i in range(100):
        out.append((i, x % 1_000_000_007))
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
    return spark.createDataFrame(out, "i int, r long")


R("q9_latest_config", f"WITH {OPS} SELECT node, coalesce(max_by(k % 4, seq) FILTER (WHERE op = 16), 0) AS strategy, coalesce(max_by(k % 3, seq) FILTER (WHERE op = 17), 0) AS priority FROM ops GROUP BY node")(
    lambda s, d: ops(s, d).groupBy("node").agg(F.coalesce(F.max_by(F.expr("k % 4"), F.when(F.col("op") == 16, F.col("seq"))), F.lit(0)).alias("strategy"), F.coalesce(F.max_by(F.expr("k % 3"), F.when(F.col("op") == 17, F.col("seq"))), F.lit(0)).alias("priority")))
R("q15_decision_helpers", f"WITH {ROUTED} SELECT decision <> 'Drop' AS reaches, outcome = 'Admitted' AS admitted, count(*) AS n FROM rt GROUP BY 1, 2")(
    lambda s, d: routed(s, d).groupBy((F.col("decision") != "Drop").alias("reaches"), (F.col("outcome") == "Admitted").alias("admitted")).agg(F.count(F.lit(1)).alias("n")))
R("q16_table_crud", f"WITH {OPS}, x AS (SELECT node, max_by(op, seq) AS op, max_by(k, seq) AS k FROM ops WHERE op IN (1, 6) GROUP BY node) SELECT node, k FROM x WHERE op = 1")(
    lambda s, d: oplog.latest(ops(s, d).where("op in (1, 6)").select("node", "seq", "op", "k"), "node").where("op = 1").select("node", "k"))
R("q18_pipeline", f"WITH {CHECKED}, c AS (SELECT pos FROM chk WHERE error IS NULL), {ROUTED[len(RECORDS) + 2:]} SELECT outcome, count(*) AS n FROM rt JOIN c USING (pos) GROUP BY outcome")(
    lambda s, d: ss.route(ss.header_errors(records(s, d)).where("error is null").drop("error"), *dims(s, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
R("q20_pending_messages", f"WITH {MSG} SELECT observer, count(*) FILTER (WHERE tick <= 5000 AND deliver_at > 5000) AS pending FROM msg GROUP BY observer")(
    lambda s, d: messages(s, d).groupBy("observer").agg(F.count_if((F.col("tick") <= 5000) & (F.col("deliver_at") > 5000)).alias("pending")))


def coded(spark, sf_dir, code, schema):
    """One row for each user, through a coder and back in Python."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(int(u), *code(int(u))) for u in b["user_id"]], columns=[c.split()[0] for c in schema.split(", ")])

    return users.mapInPandas(run, schema)


def _preamble(u):
    p = codec.read_preamble(codec.preamble(u * 3, u, features=u % 4))
    return p["path"], p["session"], p["features"]


def _attrs(u):
    f = {"node": u, "typ": "t", "rule": 0, "attrs": {"z": (2, u), "a": (6, u % 3 - 1), "m": (4, f"u{u}")}}
    back = codec.decode(1, codec.encode(1, f))["attrs"]
    return (",".join(f"{k}={v[1]}" for k, v in back.items()),)


def _profile(u):
    f = {"profile_id": u, "version": 1 + u % 2, "trust": 1 + u % 3, "assertion": u, "delegation": u + 1, "observability": u + 2, "disclosure": u + 3, "issuer": u % 25, "session": u, "generation": 1, "expiry": 9, "signature": b""}
    p = codec.profile_decode(codec.profile_encode(f))
    return p["assertion"], p["disclosure"], p["issuer"]


_U = "SELECT DISTINCT user_id FROM events"
R("l1_preamble", f"SELECT user_id, user_id * 3 AS path, user_id AS session, user_id % 4 AS features FROM ({_U})")(lambda s, d: coded(s, d, _preamble, "user_id long, path long, session long, features long"))
R("l5_attr_codec", f"SELECT user_id, 'a=' || (user_id % 3 - 1) || ',m=u' || user_id || ',z=' || user_id AS attrs FROM ({_U})")(lambda s, d: coded(s, d, _attrs, "user_id long, attrs string"))
R("l8_profiles", f"SELECT user_id, user_id AS assertion, CASE WHEN user_id % 2 = 1 THEN user_id + 3 ELSE user_id END AS disclosure, user_id % 25 AS issuer FROM ({_U})")(lambda s, d: coded(s, d, _profile, "user_id long, assertion long, disclosure long, issuer long"))

#: Scenario graphs: name, rule, number of inputs, writes (input, value), final value.
SCENARIOS = [("and_gate", "MeetAll", 2, [(0, 1), (1, 1)], 1), ("or_gate", "JoinAny", 2, [(0, 1)], -1), ("not_gate", "MvNeg", 1, [(0, 1)], -1), ("bochvar_chain", "Identity", 1, [(0, 1), (0, 0)], 0), ("majority", "Merge", 3, [(0, 1), (1, 1), (2, 1)], 1), ("lazy_demand", "MeetAll", 2, [(0, 1), (1, 0)], 0)]


@R("l12_scenarios", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {v})" for n, _, _, _, v in SCENARIOS) + ") v(scenario, val)")
def scenarios(spark, sf_dir):
    """Six small graphs evaluated together."""
    from ..plans import levels

    edges = [(f"{n}/{i}", n) for n, _, k, _, _ in SCENARIOS for i in range(k)]
    writes, seq = [], 0
    for n, _, _, ws, _ in SCENARIOS:
        for i, v in ws:
            seq += 1
            writes.append((seq, f"{n}/{i}", v))
    log = levels.propagate(spark.createDataFrame(writes, "seq long, node string, val int"), spark.createDataFrame([(n, r) for n, r, *_ in SCENARIOS], "node string, rule string"), spark.createDataFrame(edges, "src string, tgt string"))
    last = log.groupBy("node").agg(F.max_by("val", "seq").alias("v"))
    names = spark.createDataFrame([(n,) for n, *_ in SCENARIOS], "scenario string")
    return names.join(last, names.scenario == last.node, "left").select("scenario", F.coalesce("v", F.lit(-1)).alias("val"))


def _le(c):
    """Eight little-endian bytes of a long, in hex."""
    big = F.lpad(F.hex(c), 16, "0")
    return F.lower(F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)]))


_LE = "(SELECT string_agg(h[15 - 2 * i:16 - 2 * i], '' ORDER BY i) FROM (SELECT lpad(printf('%x', {0}), 16, '0') AS h), range(0, 8) r(i))"
#: A profile's fields in the order that is signed: four masks, issuer, session, generation, expiry.
SIGNED = ("user_id * 1000003", "user_id + 1", "user_id + 2", "user_id + 3", "user_id % 25", "user_id", "1", "user_id * 7")
R("m10_signing_payload", f"SELECT user_id, {' || '.join(_LE.format(x) for x in SIGNED)} AS payload FROM ({_U})")(
    lambda s, d: table(s, d, "events").select("user_id").distinct().select("user_id", F.concat(*[_le(F.expr(x).cast("long")) for x in SIGNED]).alias("payload")))
R("q3_counter_reads", f"WITH {OPS}, l AS (SELECT node % 10 AS grp, node, max_by(val, seq) AS val FROM ops WHERE op = 3 GROUP BY node) SELECT grp, count(*) FILTER (WHERE val = -1) AS neg, count(*) FILTER (WHERE val = 0) AS zero, count(*) FILTER (WHERE val = 1) AS pos FROM l GROUP BY grp")(
    lambda s, d: ops(s, d).where("op = 3").groupBy("node").agg(F.max_by("val", "seq").alias("val")).groupBy((F.col("node") % 10).alias("grp")).agg(*[F.count_if(F.col("val") == k).alias(n) for k, n in ((-1, "neg"), (0, "zero"), (1, "pos"))]))
R("q1_attr_reads", f"WITH {OPS} SELECT node, max_by(val, seq) FILTER (WHERE k % 3 = 0) AS k0, max_by(val, seq) FILTER (WHERE k % 3 = 1) AS k1 FROM ops WHERE op = 3 GROUP BY node")(
    lambda s, d: ops(s, d).where("op = 3").groupBy("node").agg(*[F.max_by("val", F.when(F.col("k") % 3 == i, F.col("seq"))).alias(f"k{i}") for i in (0, 1)]))
R("q5_partition_lookup", f"WITH {OPS}, p AS (SELECT node AS part, max_by(k, seq) AS lattice FROM ops WHERE op IN (12, 14) GROUP BY node) SELECT b.node, lattice FROM (SELECT node, max_by(k % 7, seq) AS part FROM ops WHERE op = 13 GROUP BY node) b LEFT JOIN p ON p.part = b.part")(
    lambda s, d: ops(s, d).where("op = 13").groupBy("node").agg(F.max_by(F.expr("k % 7"), "seq").alias("part")).join(ops(s, d).where("op in (12, 14)").groupBy(F.col("node").alias("part")).agg(F.max_by("k", "seq").alias("lattice")), "part", "left").select("node", "lattice"))
R("q6_element_counts", f"WITH {OPS} SELECT op, count(*) AS n, count(DISTINCT node) AS nodes FROM ops WHERE op IN (1, 2, 6, 7) GROUP BY op")(
    lambda s, d: ops(s, d).where("op in (1, 2, 6, 7)").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node").alias("nodes")))
R("q8_policy_defaults", "SELECT * FROM (VALUES ('strategy', 'FullL3'), ('domain', 'Inherit'), ('iterations', '256'), ('convergence', 'Canonical'), ('priority', 'Normal'), ('retry', 'Fail')) v(setting, value)")(
    lambda s, d: s.createDataFrame([("strategy", "FullL3"), ("domain", "Inherit"), ("iterations", "256"), ("convergence", "Canonical"), ("priority", "Normal"), ("retry", "Fail")], "setting string, value string"))
R("q10_idle_nodes", f"WITH {OPS} SELECT node, max(seq) FILTER (WHERE op = 3) < (SELECT max(seq) FROM ops) - 2000 AS idle FROM ops WHERE op = 3 GROUP BY node")(
    lambda s, d: ops(s, d).where("op = 3").groupBy("node").agg(F.max("seq").alias("last")).join(F.broadcast(ops(s, d).agg(F.max("seq").alias("top"))), how="cross").select("node", (F.col("last") < F.col("top") - 2000).alias("idle")))
R("q11_pin_names", f"SELECT user_id, 'pin_' || user_id AS symbol FROM ({_U})")(lambda s, d: table(s, d, "events").select("user_id").distinct().select("user_id", F.concat(F.lit("pin_"), F.col("user_id").cast("string")).alias("symbol")))
R("q17_runtime_events", f"WITH {RECORDS} SELECT session_id, max(pos) FILTER (WHERE opcode = 256) AS path, count(*) FILTER (WHERE opcode = 11) AS budget_events FROM rec GROUP BY session_id")(
    lambda s, d: records(s, d).groupBy("session_id").agg(F.max(F.when(F.col("opcode") == 256, F.col("pos"))).alias("path"), F.count_if(F.col("opcode") == 11).alias("budget_events")))
R("q19_trust_levels", f"WITH {OPS} SELECT seq, (['Advisory', 'Asserted', 'Attested'])[k % 3 + 1] AS trust FROM ops WHERE op = 13")(
    lambda s, d: ops(s, d).where("op = 13").select("seq", F.element_at(F.array(F.lit("Advisory"), F.lit("Asserted"), F.lit("Attested")), (F.col("k") % 3 + 1).cast("int")).alias("trust")))


@R("p1_builder", "SELECT * FROM (VALUES ('ready', 1), ('quorum', 1), ('alarm', -1), ('lazy', 0)) v(name, val)")
def builder(spark, sf_dir):
    """The Python builder: inputs, computed nodes, writes, a demand."""
    from ..graph import Graph

    g = Graph(spark)
    ins = [g.input(f"i{k}") for k in range(3)]
    made = {"ready": g.computed("ready", "and"), "quorum": g.computed("quorum", "majority"), "alarm": g.computed("alarm", "not"), "lazy": g.computed("lazy", "or", lazy=True)}
    for i in ins:
        g.connect(i, made["quorum"])
    g.connect(ins[0], made["ready"])
    g.connect(ins[1], made["alarm"])
    for i in ins:
        g.set(i, True)
    late = g.input("late")
    g.connect(late, made["lazy"])
    g.set(ins[0], True)
    for i in ins[:2]:
        g.set(i, True)
    g.set(late, False)
    g.demand(made["lazy"])
    names = spark.createDataFrame([(h.id, n) for n, h in made.items()], "node long, name string")
    return names.join(g.result().values, "node").select("name", "val")


R("p6_counts", f"WITH {OPS} SELECT count(DISTINCT node) FILTER (WHERE op = 1) AS nodes, count(*) FILTER (WHERE op = 2) - count(*) FILTER (WHERE op = 7) AS edges FROM ops")(
    lambda s, d: ops(s, d).agg(F.count_distinct(F.when(F.col("op") == 1, F.col("node"))).alias("nodes"), (F.count_if(F.col("op") == 2) - F.count_if(F.col("op") == 7)).alias("edges")))
