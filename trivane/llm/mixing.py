"""Mixing sources to target weights by entropy balancing (native).

Among all rates ``0 <= r_d <= cap`` of documents that meet each source's token target, entropy
balancing takes the one closest to "everything once" in relative entropy. Its convex dual has one
multiplier a source, and the rates are the exponential tilt ``r_d = min(cap, exp(lambda_s * x_d))``
with ``x_d`` the document's size over its source's mean size (over words). Newton steps on the dual
run for all sources at once: every step is one aggregation of a histogram (source, size, count),
which is all that the rates depend on, so texts are read twice only (sizes, final rounding).

Rates become copies by rounding ``r_d`` up or down by a keyed hash of the document; a last search
over the hash threshold makes the words taken miss the target by no more than about one document.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: A step that lowers the largest relative miss below this ends the Newton iterations.
TOLERANCE = 1e-7
#: Halving the bracket alone would do by then; a miss that is left is told by a warning.
MAX_STEPS = 60
#: The threshold search splits its interval in so many parts, so many times.
PARTS, ROUNDS = 256, 3


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn and share 100% of all words.
    A target stops at ``cap`` times the source's size; what is cut off is shared out again by
    weight among the others until none is above. The table has a row a source, not a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", turn).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # Water filling in closed form: sources are capped in order of cap over weight.
    by_fill = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    all_words = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (all_words - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source that the level does not fill, and all later ones, share by weight.
    per = per.withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    per = per.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.withColumn("target", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))))
    return per.select("source", "source_size", "target")


def _rate(lam, x, cap):
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def balance(hist: DataFrame, targets: DataFrame, cap: int = 3) -> DataFrame:
    """Solve the dual: one row a source with its multiplier ``lam``.

    ``hist`` has (source, size, n). Each Newton step is one map-side combined aggregation; the
    multipliers, a row a source, are written between steps, so nothing is gathered on the driver
    but the largest miss. Steps are kept inside a shrinking bracket, which makes the iteration
    safe where the cap bends the dual's gradient.
    """
    spark = hist.sparkSession
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = (
        targets.join(mean, targets.source.eqNullSafe(mean.source)).drop(mean.source)
        .where("source_size > 0")
        .select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("miss"))
    )
    state = written(state, "mix")
    for _ in range(MAX_STEPS):
        h = hist.join(state, hist.source.eqNullSafe(state.source)).drop(hist.source)
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, cap)
        words = F.sum(F.col("n") * F.col("size") * r)
        slope = F.sum(F.when(r < cap, F.col("n") * F.col("size") * x * r).otherwise(F.lit(0.0)))
        step = h.groupBy("source", "target", "mean", "lam", "lo", "hi").agg(words.alias("words"), slope.alias("slope"))
        low = F.col("words") < F.col("target")
        step = step.withColumn("lo", F.when(low, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(low, F.col("hi")).otherwise(F.col("lam")))
        newton = F.col("lam") + (F.col("target") - F.col("words")) / F.greatest("slope", F.lit(1e-300))
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) < 64)
        # Outside the bracket: halve it, or double the way out where it is still open.
        half = F.when(F.col("hi") >= 1e6, F.greatest(F.col("lam") * 2, F.lit(1.0))).when(F.col("lo") <= -1e6, F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        miss = F.abs(F.col("words") - F.col("target")) / F.greatest("target", F.lit(1.0))
        done = miss <= TOLERANCE
        step = step.select("source", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(half).alias("lam"), "lo", "hi", miss.alias("miss"))
        state = written(step, "mix", replaces=state)
        worst = state.agg(F.max(F.when((F.col("hi") - F.col("lo") > 1e-9) & (F.col("lam") < 1e5), F.col("miss")))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        warnings.warn(f"after {MAX_STEPS} Newton steps a source's words miss its target by {worst:.2g} of it; rounding goes on from there", stacklevel=2)
    return state.select("source", "mean", "lam")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, rate, copies, taken.

    Nulls: a null text has size 0; a null source is a source of its own, last in the order; a null
    doc_id is a value like another. Size-0 documents are taken once and count no words. Repeated rows
    share one fate. An empty table gives an empty table. Columns of ``docs`` named like the new
    ones are replaced. Reruns agree: the only randomness is a hash of doc_id, size and ``seed``.
    """
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = written(sizes, "mix-sizes")  # three small columns: texts are not read again for the searches below
    hist = written(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = written(source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap), "mix-targets")
    lam = balance(hist, targets, cap)
    plan = targets.join(lam, targets.source.eqNullSafe(lam.source), "left").drop(lam.source)
    plan = plan.withColumn("lam", F.when(F.col("target") >= cap * F.col("source_size"), F.lit(1e5)).otherwise(F.coalesce("lam", F.lit(0.0))))

    def fates(d: DataFrame, p: DataFrame) -> DataFrame:
        d = d.withColumnRenamed("source", "_source")
        d = d.join(p, d._source.eqNullSafe(p.source)).drop("source").withColumnRenamed("_source", "source")
        rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("lam"), F.col("size") / F.greatest("mean", F.lit(1e-9)), cap))
        whole = F.floor(rate)
        unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52))
        d = d.withColumn("rate", rate).withColumn("whole", whole)
        # Rounded up where the key is below the source's threshold: 0 before the last search.
        return d.withColumn("key", F.when(F.col("rate") >= cap, F.lit(2.0)).otherwise(unit - (F.col("rate") - F.col("whole"))))

    sized = fates(sizes.where("size > 0"), plan.select("source", "mean", "lam"))
    # Rows of the rounding search: what a part of the key's range adds, a row a source and part.
    bounds = plan.select("source", "target", F.lit(-1.0).alias("lo"), F.lit(2.0).alias("width"))
    for k in range(ROUNDS):
        d = sized if k == 0 else sized.join(bounds.select(F.col("source").alias("_s"), "lo", "width"), sized.source.eqNullSafe(F.col("_s"))).drop("_s")
        if k == 0:
            d = d.withColumn("lo", F.lit(-1.0)).withColumn("width", F.lit(2.0))
        part = F.floor((F.col("key") - F.col("lo")) / F.col("width") * PARTS)
        part = F.when(F.col("key") < F.col("lo"), F.lit(-1)).when(part >= PARTS, F.lit(PARTS)).otherwise(part).cast("int")
        parts = d.groupBy("source", part.alias("part")).agg(F.sum(F.col("size") * F.col("whole")).alias("low"), F.sum("size").alias("more"))
        per = Window.partitionBy("source")
        parts = parts.withColumn("floor", F.sum("low").over(per))
        parts = parts.withColumn("upto", F.col("floor") + F.sum("more").over(per.orderBy("part")))
        p = parts.join(bounds.withColumnRenamed("source", "_s"), parts.source.eqNullSafe(F.col("_s"))).drop("_s")
        last = k == ROUNDS - 1
        fits = F.col("upto") <= F.col("target")  # parts that fit whole
        n = F.coalesce(F.max(F.when(fits & (F.col("part") < PARTS), F.col("part") + 1)), F.lit(0))
        full = p.groupBy("source", "target", "lo", "width").agg(F.greatest(n, F.lit(0)).alias("n"), F.min(F.when(~fits & (F.col("part") < PARTS), F.col("part"))).alias("next"))
        at = F.when(F.lit(last), F.col("n")).otherwise(F.coalesce(F.greatest("next", F.lit(0)), F.col("n")))
        bounds = written(full.select("source", "target", (F.col("lo") + F.col("width") * at / PARTS).alias("lo"), (F.col("width") / PARTS).alias("width")), "mix-round")
    cut = bounds.select("source", F.col("lo").alias("cut"))
    plan = plan.join(cut.withColumnRenamed("source", "_s"), plan.source.eqNullSafe(F.col("_s")), "left").drop("_s")
    up = F.when(F.col("key") < F.coalesce("cut", F.lit(0.0)), F.lit(1)).otherwise(F.lit(0))
    # What is still missing is less than the next document; the documents nearest to it fill it.
    filled = written(fates(sizes.where("size > 0"), plan).select("source", "size", "target", "key", (F.col("whole") + up).alias("copies"), (up == 1).alias("up")), "mix-fates")
    gap = filled.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"), F.lit(None).cast("double").alias("fill1"))
    for name in ("fill1", "fill2"):
        g = gap.withColumnRenamed("source", "_s")
        f = filled.where(~F.col("up") & (F.col("key") < 2)).join(g, filled.source.eqNullSafe(F.col("_s"))).where(~F.col("key").eqNullSafe(F.col("fill1")))
        f = f.withColumn("off", F.abs(F.col("gap") - F.col("size"))).where("off < abs(gap)")
        best = f.groupBy("source").agg(F.min(F.struct("off", "key", "size")).alias("b"))
        g = gap.join(best.withColumnRenamed("source", "_s"), gap.source.eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = written(g.select("source", (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap"), *(["fill1"] if name == "fill2" else []), F.col("b.key").alias(name)), "mix-gap")
    plan = plan.join(gap.select(F.col("source").alias("_s"), "fill1", "fill2"), plan.source.eqNullSafe(F.col("_s")), "left").drop("_s")

    plan = written(plan, "mix-plan")  # a row a source: Spark sees its size, and broadcasts it only if it is small
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    keep = [c for c in docs.columns if c not in new]
    out = docs.select(F.struct(*keep).alias("_row"), "doc_id", "source", "text")  # so that no other column clashes
    out = out.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    out = fates(out, plan)
    filler = F.col("key").eqNullSafe(F.col("fill1")) | F.col("key").eqNullSafe(F.col("fill2"))
    up = F.when(F.col("size") == 0, F.lit(0)).when((F.col("key") < F.coalesce("cut", F.lit(0.0))) | filler, F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", (F.col("whole") + up).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], *new)


def op7_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
