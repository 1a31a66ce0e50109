"""Laws over all combinations of values."""

import itertools

import pytest
from pyspark.sql import functions as F

from trivane.functions import ternary as t

V = (-1, 0, 1)


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(list(itertools.product(V, V, V)), "a int, b int, c int").cache()


def holds(df, x, y):
    return df.where(~x.eqNullSafe(y)).count() == 0


def test_laws(triples):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert holds(triples, t.mv_neg(t.mv_neg(a)), a)
    assert holds(triples, t.mv_add(F.lit(-1), a), a) and holds(triples, t.mv_mul(F.lit(1), a), a)
    assert holds(triples, t.mv_add(a, t.mv_neg(a)), F.lit(1)) and holds(triples, t.mv_sub(a, a), F.lit(-1))
    assert holds(triples, t.mv_sub(a, b), t.mv_neg(t.mv_add(t.mv_neg(a), b))) and holds(triples, t.mv_impl(a, b), t.mv_add(t.mv_neg(a), b))
    for f in (t.mv_add, t.mv_mul, t.meet, t.join, t.bochvar_add, t.bochvar_mul, t.bochvar_meet):
        assert holds(triples, f(a, b), f(b, a)) and holds(triples, f(f(a, b), c), f(a, f(b, c)))
    for f in (t.bochvar_add, t.bochvar_mul, t.bochvar_meet):
        assert holds(triples, f(F.lit(0), a), F.lit(0))
    assert holds(triples, t.merge(a, b, b), b) and holds(triples, t.merge(a, b, c), t.merge(a, c, b))


def test_folds_of_nothing(spark):
    e = spark.createDataFrame([], "v int").agg(t.meet_all(F.col("v")).alias("m"), t.join_any(F.col("v")).alias("j"), t.fold_add(F.col("v")).alias("f"), t.propagation_state(F.col("v")).alias("s"), t.quiescent(F.col("v")).alias("q")).first()
    assert tuple(e) == (1, -1, -1, "Ready", True)


def test_flags(spark):
    r = spark.createDataFrame([(True,), (False,), (None,)], "f boolean").select(t.from_flag(F.col("f")).alias("v"), t.to_flag(t.from_flag(F.col("f"))).alias("f")).collect()
    assert [tuple(x) for x in r] == [(1, True), (0, False), (-1, None)]
