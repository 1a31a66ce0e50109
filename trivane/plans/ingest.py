"""From bytes to values: binary logs are framed, checked, decoded and applied by the op-log engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import session
from ..sources import codec
from ..storage import written
from . import engine

#: Records that one stream may have: streams are applied one after the other, in order of their path numbers.
STREAM = 1 << 32


def accepted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(operations, refused) of the binary logs below ``path``.

    A record is refused for what is wrong with its frame, its header (length, opcode, session, order of seq and
    epochs) or its payload, and leaves no trace otherwise. Unknown opcodes and profiles are stepped over.
    """
    records = written(codec.read_log(spark, path), "ingest-records")
    framed = records.where("error is null")
    checked = framed.drop("error").withColumn("_at", F.col("pos")).withColumn("pos", F.col("path") * STREAM + F.col("pos"))
    checked = written(session.header_errors(checked), "ingest-checked")
    known = checked.where(F.col("error").isNull() & F.col("opcode").between(1, 18))
    ops = written(codec.operations(known.drop("error")), "ingest-operations")
    bad = lambda d, pos: d.where("error is not null").select("path", pos.cast("int").alias("pos"), F.col("opcode").cast("int").alias("opcode"), "error")
    refused = bad(records, F.col("pos")).union(bad(checked, F.col("_at"))).union(bad(ops, F.col("_at")))
    return ops.where("error is null").withColumn("seq", F.col("pos")).drop("pos", "_at", "error", "opcode"), refused


def apply_logs(spark: SparkSession, path: str, authority: str = "Advisory", unbound: str = "Allow") -> tuple[engine.Result, DataFrame]:
    """What the logs below ``path`` come to, and the records refused."""
    ops, refused = accepted(spark, path)
    return engine.run(ops, authority, unbound), refused
