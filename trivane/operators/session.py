"""The session layer as joins, windows and first-match conditions over record headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates


def opcode_class(op):
    return (
        F.when(op.isin(1, 2, 6, 7, 9) | op.between(12, 18), "Control").when(op == 3, "SetValue").when(op == 4, "Propagate").when(op == 5, "Subscribe")
        .when(op == 8, "Demand").when(op == 10, "Data").when(op == 11, "Stabilize").when(op == 256, "Profile").otherwise("Unknown")
    )


def control_plane(cls):
    return cls.isin("Control", "Profile", "Subscribe")


def policy_axis(cls):
    """The policy mask that counts for a class; none for unknown ones."""
    return F.when(cls.isin("Subscribe", "Demand"), "observability").when(cls == "Profile", "delegation").when(cls != "Unknown", "assertion")


def admission(cls, depth, coalesce_at: int = 1000, shed_at: int = 5000):
    return (
        F.when(control_plane(cls), "ControlPlane").when(cls == "Demand", "Prioritize").when(cls == "Stabilize", "SlowLane")
        .when(cls == "SetValue", F.when(depth >= coalesce_at, "Coalesce").otherwise("Allow"))
        .when(cls == "Propagate", F.when(depth >= shed_at, "Drop").otherwise("Allow"))
        .when(cls == "Data", F.when(depth >= coalesce_at, "Delay").otherwise("Allow")).otherwise("Drop")
    )


def header_errors(records: DataFrame) -> DataFrame:
    """``records`` with the first check that fails: length, opcode, session, order of seq, order of epochs.

    A record that fails the seq check leaves no trace; one that fails the epoch check has used its seq.
    """
    plain = F.when(F.col("length") < 48, "InvalidLength").when(F.col("opcode") == 0, "InvalidOpcode").when(F.col("session_id") != F.col("stream_session"), "SessionIdMismatch")
    before = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    r = records.withColumn("_plain", plain)
    r = r.withColumn("_last", F.max(F.when(F.col("_plain").isNull(), F.col("stream_seq"))).over(before))
    r = r.withColumn("_seq_ok", F.col("_plain").isNull() & (F.col("_last").isNull() | (F.col("stream_seq") > F.col("_last"))))
    r = r.withColumn("_epoch", F.max(F.when(F.col("_seq_ok"), F.col("causal_epoch"))).over(before))
    error = F.coalesce("_plain", F.when(~F.col("_seq_ok"), "StreamSeqGap"), F.when(F.col("causal_epoch") < F.col("_epoch"), "EpochRegression"))
    return r.withColumn("error", error).drop("_plain", "_last", "_seq_ok", "_epoch")


def route(records: DataFrame, sessions: DataFrame, rows: DataFrame, partitions: DataFrame, pressure: DataFrame) -> DataFrame:
    """``records`` with cls and outcome, by the first step that rejects.

    sessions (session_id, s_tenant, floor, assertion, delegation, observability), rows (partition_id, cls,
    r_assertion, r_delegation, r_observability), partitions (partition_id, shard_id), pressure (shard_id,
    depth). Dimensions are small and left to Spark to broadcast by their size.
    """
    r = records.withColumn("cls", opcode_class(F.col("opcode")))
    r = r.join(sessions, "session_id", "left").join(rows, ["partition_id", "cls"], "left").join(partitions, "partition_id", "left")
    r = r.withColumn("shard_id", F.coalesce("shard_id", F.when(control_plane(F.col("cls")), F.lit(0)))).join(pressure, "shard_id", "left")
    axis = policy_axis(F.col("cls"))
    pick = lambda p: F.when(axis == "observability", F.col(f"{p}observability")).when(axis == "delegation", F.col(f"{p}delegation")).when(axis == "assertion", F.col(f"{p}assertion")).otherwise(F.lit(0))
    denied = F.col("r_assertion").isNotNull() & ~gates.has_all(F.coalesce(pick(""), F.lit(-1)).cast("long"), F.coalesce(pick("r_"), F.lit(0)).cast("long"))
    decision = admission(F.col("cls"), F.coalesce("depth", F.lit(0)))
    outcome = (
        F.when(F.col("s_tenant").isNull(), "SessionNotFound").when((F.col("tenant_id") != 0) & (F.col("tenant_id") != F.col("s_tenant")), "TenantMismatch")
        .when(F.col("stream_seq") < F.col("floor"), "StreamSeqReplay").when(denied, "AuthGateDenied").when(F.col("shard_id").isNull(), "UnknownPartition")
        .when(decision == "Drop", "Shed").when(decision == "Delay", "Delay").otherwise("Admitted")
    )
    return r.withColumn("decision", decision).withColumn("outcome", outcome)


def hop(a: dict, b: dict):
    return F.when(a["region"] != b["region"], 16).when(a["pod"] != b["pod"], 8).when(a["rack"] != b["rack"], 4).when(a["leaf"] != b["leaf"], 2).otherwise(1)


#: From the widest part of an address to the narrowest, and the hops between shards that first differ there.
ADDRESS, HOPS = ("region", "pod", "rack", "leaf"), (16, 8, 4, 2)


def _by_level(shards: DataFrame, value, name: str) -> DataFrame:
    """``shards`` and {name}0 .. {name}4: an aggregate over those that share no part of the address, one, ... all.

    Hops depend on the address alone, so a row an address level is all that is joined: no pairs of shards.
    """
    out = shards
    for k in range(len(ADDRESS) + 1):
        level = shards.groupBy(*ADDRESS[:k]).agg(value.alias(f"{name}{k}"))
        out = out.join(level, list(ADDRESS[:k])) if k else out.join(F.broadcast(level), how="cross")  # one row
    return out


def fabric_metrics(shards: DataFrame) -> DataFrame:
    """(a, radius, remote) of every shard: hops to the farthest other (null if alone), shards of other regions."""
    d = _by_level(shards, F.count(F.lit(1)), "n")
    radius = F.when(F.col("n4") > 1, 1)
    for k, hops in reversed(list(enumerate(HOPS))):
        radius = F.when(F.col(f"n{k}") > F.col(f"n{k + 1}"), hops).otherwise(radius)
    return d.select(F.col("shard_id").alias("a"), radius.alias("radius"), (F.col("n0") - F.col("n1")).alias("remote"))


def best_shards(shards: DataFrame, healthy) -> DataFrame:
    """(a, best) of every shard: the nearest healthy one, of several the smallest identifier; no row if none is."""
    d = _by_level(shards, F.min(F.when(healthy, F.col("shard_id"))), "m")
    return d.select(F.col("shard_id").alias("a"), F.coalesce("m4", "m3", "m2", "m1", "m0").alias("best")).where("best IS NOT NULL")


def locality_class(hops):
    return F.when(hops == 1, 1).when(hops == 2, 3).when(hops == 4, 7).when(hops == 8, 15).otherwise(-1).cast("long")


def health(depth, cursors, contested_at: int = 500):
    return F.when(cursors >= 1, -1).when(depth >= contested_at, 0).otherwise(1)


def transitions(states: DataFrame, key: str, value: str) -> DataFrame:
    """Rows at which a key's value differs from before (pending at first)."""
    s = states.withColumn("old", F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy("seq")), F.lit(-1)))
    return s.where(F.col("old") != F.col(value))


def expiry(last_active, quiescent, now, frontier, inactive: int, lag: int, frustrated: int):
    return F.when(now - last_active > inactive, "Inactivity").when(frontier - last_active > lag, "EpochLag").when(quiescent >= frustrated, "ZeroFrustration")


def streak(rows: DataFrame, key: str, hit, reset) -> DataFrame:
    """At each row, how many rows ``hit`` since the key's last ``reset``."""
    w = Window.partitionBy(key).orderBy("seq")
    g = rows.withColumn("_g", F.count(F.when(reset, 1)).over(w))
    return g.withColumn("streak", F.count(F.when(hit, 1)).over(Window.partitionBy(key, "_g").orderBy("seq"))).drop("_g")
