"""Frontiers, mask interning, observation and boundary streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates


def frontier(times: DataFrame, *key: str) -> DataFrame:
    """The antichain of each group: distinct times that no other time of the group strictly dominates."""
    dims = list(gates.DIMS)
    d = times.select(*key, *dims).distinct()
    o = d.select(*[F.col(k).alias(f"_{k}") for k in (*key, *dims)])
    over = F.lit(True)
    for k in key:
        over = over & (F.col(k) == F.col(f"_{k}"))
    more = F.lit(False)
    for k in dims:
        over = over & (F.col(f"_{k}") >= F.col(k))
        more = more | (F.col(f"_{k}") > F.col(k))
    return d.join(o, over & more, "left_anti")


def intern(masks: DataFrame, *cols: str) -> DataFrame:
    """Distinct masks with dense numbers in their order. Masks are a small dimension by nature."""
    return masks.select(*cols).distinct().withColumn("mask_id", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in cols])))


def scope_matches(subscriptions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(stream_id, node): scopes by identifier, identifier set, partition or type, each an equi-join."""
    n = nodes.select("node", "partition", "typ")
    s = subscriptions
    by_uid = s.where("scope_kind in ('uid', 'uid_set')").select("stream_id", F.explode("uids").alias("node")).join(n, "node", "left_semi")
    by_part = s.where("scope_kind = 'partition'").select("stream_id", "partition").join(n, "partition").select("stream_id", "node")
    by_type = s.where("scope_kind = 'typed'").select("stream_id", "typ").join(n, "typ").select("stream_id", "node")
    return by_uid.select("stream_id", "node").union(by_part).union(by_type).distinct()


def emitted(val, zero_kind):
    """What crosses a boundary: a pending value, a typed contest, or a value."""
    return F.when(val == -1, "Pending").when(zero_kind.isNotNull(), F.concat(F.lit("TypedZero:"), zero_kind)).otherwise(F.concat(F.lit("Value:"), val.cast("string")))
