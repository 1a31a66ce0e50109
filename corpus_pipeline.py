"""A corpus pipeline: each stage applies one operator to what its predecessor kept.

Toxic documents go, one document of each group of near copies stays, documents that hold benchmark
items go, personal data become pseudonyms, and the sources that are left are mixed to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm.common import written
from trivane.llm.decontaminate import decontaminate
from trivane.llm.jaccard import jaccard_groups
from trivane.llm.mixing import mix_sources
from trivane.llm.pii import pseudonymise
from trivane.llm.toxicity import score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 one row: that of the smallest doc_id.

    Rows count one by one, whatever their doc_id: of repeated rows one stays, two texts under one doc_id have
    a group each, a null doc_id comes after all others. Rows without words have no copies and all stay.
    """
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard_groups(rows.select(F.col("_row").alias("doc_id"), "text"), shingle=5, percent=80)
    member = groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).join(rows.select("_row", "doc_id"), "_row")
    member = written(member, "pipeline-members")
    best = member.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "_row")).alias("k"))
    best = best.where("n > 1").select("_group", F.col("k._row").alias("_stays"))
    gone = written(member.join(best, "_group").where("_row <> _stays").select("_row"), "pipeline-gone")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data replaced."""
    out = pseudonymise(docs)
    return out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, with how often, and words taken."""
    return mix_sources(docs).where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("PII", private),
    ("mixing sources", mixture),
]

#: The fitted model and the hashes of the last stage have no SQL; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
