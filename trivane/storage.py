"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths made below the shared folder, by application, so that they can be dropped.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a temporary folder where that is unset, as in local tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.trivane.scratch", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trivane-")
        spark.conf.set("spark.trivane.scratch", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes.

    ``replaces`` is an earlier result of this function that nothing needs any more, such as the last
    round's state; its files go once the new ones are there.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trivane_path = path
    if replaces is not None and getattr(replaces, "_trivane_path", None):
        drop(spark, replaces._trivane_path)
    return out


def drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
    made = _made.get(sc.applicationId, [])
    if path in made:
        made.remove(path)


def release(spark: SparkSession) -> None:
    """Drop all tables that this application wrote to the shared folder. Results still unread need them."""
    for path in list(_made.get(spark.sparkContext.applicationId, [])):
        drop(spark, path)
