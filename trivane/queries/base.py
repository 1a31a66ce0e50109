"""Registration, and the graphs that queries read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Collects queries and their oracle SQL."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def band(c):
    """-1 below 10, 0 below 30, else 1."""
    return F.when(c < 10, -1).when(c < 30, 0).otherwise(1)


def band_sql(c: str) -> str:
    return f"CASE WHEN {c} < 10 THEN -1 WHEN {c} < 30 THEN 0 ELSE 1 END"


def writes(spark, sf_dir) -> DataFrame:
    """Every event writes the banded value to the input of its user and type: seq, sub, src, val."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("sub"), F.col("event_type").alias("src"), band(F.col("value")).alias("val"))


WRITES = f"writes AS (SELECT event_id AS seq, user_id AS sub, event_type AS src, {band_sql('value')} AS val FROM events)"
EFFECTIVE = f"""{WRITES}, o AS (SELECT *, coalesce(lag(val) OVER (PARTITION BY sub, src ORDER BY seq), -1) AS old FROM writes),
    eff AS (SELECT seq, sub, src, old, val FROM o WHERE old <> val)"""


def ops(spark, sf_dir) -> DataFrame:
    """Events read as a log of graph operations: seq, op, k, node, other, val (k: operand, other: second node)."""
    e = table(spark, sf_dir, "events")
    m, k = F.col("event_id") % 20, F.floor("value").cast("int")
    rare = F.element_at(F.array(*[F.lit(x) for x in (4, 11, 12, 14, 16, 17, 18)]), (k % 7 + 1).cast("int"))
    op = F.when(m < 2, 1).when(m < 5, 2).when(m < 11, 3).when(m == 11, 7).when(m == 12, 6).when(m == 13, 8).when(m == 14, 9).when(m == 15, 10).when(m == 16, 5).when(m == 17, 13).when(m == 18, 15).otherwise(rare)
    return e.select(F.col("event_id").alias("seq"), op.cast("int").alias("op"), k.alias("k"), F.col("user_id").alias("node"), (k % 150).cast("long").alias("other"), band(F.col("value")).alias("val"))


OPS = f"""ops AS (SELECT event_id AS seq, CASE WHEN m < 2 THEN 1 WHEN m < 5 THEN 2 WHEN m < 11 THEN 3 WHEN m = 11 THEN 7 WHEN m = 12 THEN 6 WHEN m = 13 THEN 8
    WHEN m = 14 THEN 9 WHEN m = 15 THEN 10 WHEN m = 16 THEN 5 WHEN m = 17 THEN 13 WHEN m = 18 THEN 15 ELSE ([4, 11, 12, 14, 16, 17, 18])[k % 7 + 1] END::INT AS op,
    k, user_id AS node, (k % 150)::BIGINT AS other, {band_sql('value')} AS val FROM (SELECT *, event_id % 20 AS m, floor(value)::INT AS k FROM events))"""
