"""A stream of events gives what the batch operators give, also over two runs."""

from conftest import SF
from pyspark.sql import functions as F

from trivane.queries import QUERIES
from trivane.queries.base import band
from trivane.streaming import engine


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half)):
        part.coalesce(1).write.mode("append").parquet(src)
        s = engine.read_events(spark, src)
        w = s.select(F.col("event_id").alias("seq"), F.col("user_id").alias("sub"), F.col("event_type").alias("src"), band(F.col("value")).alias("val"))
        engine.run_to_table(engine.retained_meet(w, 5), out, check)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("sub", "seq", "out").collect())
    want = sorted(tuple(r) for r in QUERIES["e5_retained_meet"](spark, SF).select("sub", "seq", "out").collect())
    assert got == want
