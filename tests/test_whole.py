"""Queries that answer for everything: brute force on small tables, SQL on larger ones."""

import random

import duckdb
import pytest
from conftest import TABLES, same_rows
from pyspark.sql import functions as F

from trivane.operators import session as ss
from trivane.operators import solve
from trivane.plans import levels
from trivane.queries import ORACLES, QUERIES

WIDE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def wide():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WIDE}/{t}.parquet'")
    return c


def test_every_shard_is_answered(spark):
    draw = random.Random(3)
    shards = [(i, *[draw.randrange(n) for n in (3, 4, 2, 2)], draw.random() < 0.3) for i in range(60)] + [(60, 7, 7, 7, 7, False)]
    df = spark.createDataFrame(shards, "shard_id long, region int, pod int, rack int, leaf int, ok boolean")
    hop = lambda a, b: next((h for k, h in enumerate((16, 8, 4, 2), 1) if a[k] != b[k]), 1)
    radius = {a[0]: (max(hop(a, b) for b in shards if a != b), sum(hop(a, b) == 16 for b in shards)) for a in shards}
    best = {a[0]: min((hop(a, b), b[0]) for b in shards if b[5])[1] for a in shards}
    assert {r.a: (r.radius, r.remote) for r in ss.fabric_metrics(df).collect()} == radius
    assert {r.a: r.best for r in ss.best_shards(df, F.col("ok")).collect()} == best
    assert ss.fabric_metrics(df.where("shard_id = 60")).first().radius is None and ss.best_shards(df, F.lit(False)).isEmpty()


def test_all_shards_of_a_larger_fabric(spark, wide):
    for name in ("m17_fabric_metrics", "m20_best_shard"):
        a, b = same_rows(QUERIES[name](spark, WIDE), wide.execute(ORACLES[name]))
        assert a == b and len(a) == 100


def test_closures_run_to_their_end(spark, monkeypatch):
    chain = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(12, 12), (5, 12)], "src long, tgt long")  # with cycles
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in levels.closure(chain, seeds).collect()} == {i: i for i in range(13)}
    contested = spark.createDataFrame([(i, 0) for i in range(9)] + [(9, 1)], "node long, val int")
    assert {r.node: r.member for r in solve.section(contested, chain, seeds).collect()} == {i: i < 9 for i in range(10)}
    monkeypatch.setattr(levels, "STEP_LIMIT", 5)
    with pytest.raises(levels.StepLimitExceeded):
        levels.closure(chain, seeds)


@pytest.mark.parametrize("name", ["f2_demand_set", "f4_frontier_depth", "h5_section"])
def test_whole_closures_of_a_larger_log(spark, wide, name):
    a, b = same_rows(QUERIES[name](spark, WIDE), wide.execute(ORACLES[name]))
    assert a == b and len(a) >= {"f2": 146, "f4": 2, "h5": 36}[name[:2]]
