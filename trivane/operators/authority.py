"""Information-flow gates over edges: labels, emitted authority, enforcement and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gates

ALL_CAPABILITIES, UNIVERSAL = 255, -1


def gated_edges(edges: DataFrame, labels: DataFrame, bindings: DataFrame, partitions: DataFrame) -> DataFrame:
    """Every edge with its label (defaults where it has none) and what its source emits.

    labels (src, tgt, lattice, capability, scope), bindings (node, part), partitions (part, class,
    domain). The label's scope is narrowed by the domain of the source's partition. For local edges
    the capability and scope that count are the label's own, so only the lattice can fail there.
    """
    e = edges.join(labels, ["src", "tgt"], "left").join(bindings.withColumnRenamed("node", "src"), "src", "left").join(partitions, "part", "left")
    scope = F.coalesce("scope", F.lit(UNIVERSAL)).cast("long").bitwiseAND(F.coalesce("domain", F.lit(UNIVERSAL)).cast("long"))
    cap = F.coalesce("capability", F.lit(ALL_CAPABILITIES))
    lattice = F.coalesce("lattice", F.lit(0)).cast("long")
    reason = gates.authority_reason(cap, scope, lattice, cap, scope, F.coalesce("class", F.lit(0)).cast("long"))
    return e.select(*edges.columns, "part", cap.alias("capability"), scope.alias("scope"), lattice.alias("lattice"), F.when(F.col("class").isNull(), "UnboundSource").otherwise(reason).alias("reason"))


def decide(reason, mode: str, unbound: str):
    """(passes, audited) by mode Advisory, Audit or Enforced and policy Allow, AuditOnly or Deny for unbound sources."""
    if mode == "Advisory":
        return F.lit(True), F.lit(False)
    is_unbound = reason == "UnboundSource"
    passes = reason.isNull() | (is_unbound & F.lit(unbound != "Deny")) | F.lit(mode == "Audit")
    audited = F.when(is_unbound, F.lit(unbound == "AuditOnly" or (unbound == "Deny" and mode == "Audit"))).otherwise(reason.isNotNull() & F.lit(mode == "Audit"))
    return F.coalesce(passes, F.lit(True)), F.coalesce(audited, F.lit(False))


def guarded_deletes(deletes: DataFrame, edges: DataFrame) -> DataFrame:
    """Deletions of nodes (seq, node) with whether a remote edge at the node forbids them."""
    remote = edges.where("remote").select(F.explode(F.array("src", "tgt")).alias("node")).distinct().withColumn("forbidden", F.lit(True))
    return deletes.join(remote, "node", "left").withColumn("forbidden", F.coalesce("forbidden", F.lit(False)))
