"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; a hash is the signed axis
nearest to the rotated vector, a bucket is ``k`` hashes of one table. ``k`` follows the number of vectors,
so that buckets stay small, and the number of tables follows ``k`` and the dimension (``tables_for``), so that
vectors at the threshold share a bucket with probability of 0.998 or more. Multiprobe: every vector also enters its
``PROBES`` next best buckets of each table, where it meets the vectors at home there.

Equal vectors become one node first. Small buckets travel together, large ones are split into blocks that
are joined pair by pair, so every group handed to Python is of bounded size. There
cosines are computed in double precision; a pair that meets in several buckets counts in the first
alone, which both sides can compute from their vectors. Tasks emit link counts and a spanning forest,
never pairs, so a large group of near copies costs its comparisons but no pair leaves a task.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written
from .components import components
from .jaccard import _batch

THRESHOLD = 0.9
PROBES = 2
#: Probability that two vectors at the threshold share a bucket, and pairs and tables that it is measured on.
RECALL, PAIRS, TRIALS = 0.998, 200, 16
MOST_HASHES = 5
BUCKET, BLOCK, GROUP = 16, 384, 1024
TOP = 4  # best axes of a hash that probes are made of


def _hadamard(x: np.ndarray) -> np.ndarray:
    h, (m, n) = 1, x.shape
    while h < n:
        y = x.reshape(m, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(m, n)
        h *= 2
    return x / math.sqrt(n)


def buckets(x: np.ndarray, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Home buckets (rows x tables) and probed buckets (rows x tables x PROBES; -1: none) of unit vectors."""
    rng = np.random.Generator(np.random.PCG64(31))
    n = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), n))
    padded[:, : x.shape[1]] = x
    combos = np.array(list(itertools.product(range(min(TOP, 2 * n)), repeat=k)))
    home, probes = np.zeros((len(x), tables), np.int64), np.full((len(x), tables, PROBES), -1, np.int64)
    row = np.arange(len(x))
    for t in range(tables):  # the first tables are the same whatever their number
        axes, gaps = [], []
        for _ in range(k):
            r = padded
            for signs in rng.choice([-1.0, 1.0], size=(3, n)):
                r = _hadamard(r * signs)
            r = np.round(np.concatenate([r, -r], 1), 12)
            best = np.argpartition(-r, TOP, axis=1)[:, :TOP] if r.shape[1] > TOP else np.argsort(-r, 1)
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(r, best, 1), 1, kind="stable"), 1)
            axes.append(best)
            gaps.append((r[row, best[:, 0]][:, None] - np.take_along_axis(r, best, 1)) ** 2)
        cost = sum(g[:, combos[:, i]] for i, g in enumerate(gaps))
        order = np.argsort(cost, 1, kind="stable")[:, : PROBES + 1]
        made = np.zeros(order.shape, np.int64)
        for i, a in enumerate(axes):
            made = made * (2 * n) + np.take_along_axis(a, combos[:, i][order], 1)
        home[:, t] = made[:, 0]
        probes[:, t, : made.shape[1] - 1] = made[:, 1:]
    return home, probes


@lru_cache(64)
def tables_for(dim: int, k: int, threshold: float = THRESHOLD) -> int:
    """How many tables pairs at ``threshold`` need, from how often random ones share a bucket of one table.

    Rotations of different tables are independent, and a pair's chance depends on its angle alone, so a
    rate measured on few tables tells the number of all; two standard errors are taken off.
    """
    rng = np.random.Generator(np.random.PCG64(77))
    a = _unit(rng.standard_normal((PAIRS, dim)))
    b = rng.standard_normal((PAIRS, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.sqrt((b * b).sum(1, keepdims=True))
    b = np.where(norm > 1e-9, b / np.maximum(norm, 1e-9), 0)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b
    home, probes = buckets(np.concatenate([a, _unit(b)]), k, TRIALS)
    x, y = slice(0, PAIRS), slice(PAIRS, None)
    meet = (home[x] == home[y]) | (probes[x] == home[y][:, :, None]).any(2) | (probes[y] == home[x][:, :, None]).any(2)
    p = meet.mean()
    p = min(max(p - 2 * math.sqrt(p * (1 - p) / meet.size), 1e-4), 0.999)
    return max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - p)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(v: Column) -> Column:
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda e: e != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link when the cosine of their embeddings, in double precision, is at least ``threshold``. Vectors
    that are null, empty or zero, or hold null, NaN or infinite components link with nothing and are
    components of their own; vectors of different lengths never link. Equal vectors always link. A
    null vec_id is never a component_id, unless alone, where it is null and kept. Rows that share a
    vec_id are rows like others. Extra columns are ignored; an empty table gives an empty result.
    """
    v = F.col("embedding")
    rows = written(vectors.select("vec_id", F.when(valid(v), v).alias("v")).select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h")), "vectors")
    # A node is a vector, compared by its components; the hash only names it where no other vector has it.
    nodes = rows.where("h is not null").groupBy("h", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    shared = written(nodes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(True).alias("shared")), "vector-hashes")
    size = nodes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count")).limit(1).first()
    if not size:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = 2 * max(2, 1 << (size["dim"] - 1).bit_length())
    k = min(MOST_HASHES, max(1, math.ceil(math.log(max(2.0, size["count"] / BUCKET)) / math.log(width))))
    known = {size["dim"]: tables_for(size["dim"], k, threshold)}  # of other dimensions where they are met
    tables = known[size["dim"]]

    out = pa.schema([("t", pa.int32()), ("bucket", pa.int64()), ("dim", pa.int32()), ("node", pa.int64()), ("first", pa.int64())])

    def enter(batches):
        for b in batches:
            node, lists = b.column(0).to_numpy(), b.column(1)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _unit(_matrix(lists.take(pa.array(at))))
                home, probes = buckets(x, k, known.get(dim) or tables_for(dim, k, threshold))
                for t in range(home.shape[1]):
                    both = np.concatenate([home[:, t, None], probes[:, t]], 1)
                    r, c = np.nonzero(both >= 0)
                    yield _batch(out, np.full(len(r), t, np.int32), both[r, c], np.full(len(r), dim, np.int32), node[at][r], home[r, 0])

    # Identifiers alone are dealt into buckets; vectors follow once the groups are known.
    entries = written(nodes.select("node", "v").mapInArrow(lean(enter), "t int, bucket long, dim int, node long, first long"), "vector-entries")
    key = ["t", "bucket", "dim"]
    sizes = written(entries.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "vector-buckets")
    few = sizes.where(F.col("m") <= BLOCK).agg(F.sum("m")).first()[0] or 0
    groups = max(1, math.ceil(few / tables / GROUP))
    sizes = sizes.withColumn("large", F.when(F.col("m") > BLOCK, F.col("bucket")))
    # Vectors with one home in the first table have met there: in a large bucket of a later table they get
    # blocks of their own, which are joined with other blocks only. A hot group is compared once, not once a table.
    met = entries.where("t > 0").join(sizes.where("large is not null").select(*key), key).groupBy(*key, "first").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= BLOCK // 2)
    met = met.withColumn("own", F.ceil(F.col("c") / BLOCK).cast("int"))
    met = written(met.withColumn("from", F.sum("own").over(Window.partitionBy(*key).orderBy("first")) - F.col("own")), "vector-met")
    sizes = sizes.join(met.groupBy(*key).agg(F.sum("own").cast("int").alias("owned"), F.sum("c").alias("c")), key, "left").fillna(0, ["owned", "c"])
    rest = F.when(F.col("large").isNull(), 1).otherwise(F.ceil((F.col("m") - F.col("c")) / BLOCK)).cast("int")
    sizes = written(sizes.withColumn("blocks", F.col("owned") + rest).drop("m", "c"), "vector-blocks")
    m = entries.join(sizes, key).join(met.drop("c"), [*key, "first"], "left")
    spread = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    m = m.withColumn("mine", F.when(F.col("from").isNull(), F.col("owned") + spread(F.col("blocks") - F.col("owned"))).otherwise(F.col("from") + spread(F.col("own"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.col("from").isNull() | (x < F.col("from")) | (x >= F.col("from") + F.col("own")))
    m = m.withColumn("other", F.explode(others))
    m = m.select("t", "large", "dim", "node", "bucket",
        F.when(F.col("large").isNull(), F.pmod(F.xxhash64("t", "bucket"), F.lit(groups)).cast("int")).otherwise(F.least("mine", "other")).alias("i"),
        F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    m = m.join(nodes.select("node", "copies", "v"), "node")
    found = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        t, large = table["t"][0].as_py(), table["large"][0].as_py()
        node, copies, side, bucket = (table[c].to_numpy() for c in ("node", "copies", "side", "bucket"))
        order = np.lexsort((node, bucket))
        node, copies, side, bucket = node[order], copies[order], side[order], bucket[order]
        u = _unit(_matrix(table["v"])[order])
        if large is not None:
            a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
            if side.max() >= 0:
                keep = side[a] != side[b]
                a, b = a[keep], b[keep]
        else:
            a, b = [], []
            for step in range(1, BLOCK):
                x = np.flatnonzero(bucket[step:] == bucket[:-step]) if len(bucket) > step else np.zeros(0, np.int64)
                if not len(x):
                    break
                x = x[np.einsum("ij,ij->i", u[x], u[x + step]) >= threshold]
                a.append(x)
                b.append(x + step)
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        if not len(a):
            return found.empty_table()
        # a is the smaller node. Which buckets the two share follows from the vectors alone.
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        home, probes = buckets(u[rows], k, t + 1)
        x, y = place[: len(a)], place[len(a) :]
        sees = lambda x, y, q: (home[x, q] == home[y, q]) | (probes[x, q] == home[y, q][:, None]).any(1)
        keep = np.ones(len(a), bool)
        for q in range(t):
            keep &= ~(sees(x, y, q) | sees(y, x, q))
        meet = np.where(sees(y, x, t), home[x, t], np.where(sees(x, y, t), home[y, t], -1))
        keep &= meet == bucket[a]
        a, b = a[keep], b[keep]
        if not len(a):
            return found.empty_table()
        ids, place = np.unique(node, return_inverse=True)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, place[a], copies[b])
        np.add.at(n, place[b], copies[a])
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[place[a]], label[place[b]])
            new = label.copy()
            np.minimum.at(new, place[a], low)
            np.minimum.at(new, place[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = n > 0
        return pa.table([pa.array(ids[some]), pa.array(ids[label][some]), pa.array(n[some])], schema=found)

    got = written(m.groupBy("t", "large", "dim", "i", "j").applyInArrow(compare, "node long, root long, links long"), "vector-links")
    roots = components(got.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = got.groupBy("node").agg(F.sum("links").alias("links"))
    n = nodes.select("node", "vec_id", "copies").join(links, "node", "left").join(roots, "node", "left")
    n = written(n.select("node", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-roots")
    label = n.join(n.groupBy("root").agg(F.min("vec_id").alias("component_id")), "root").select("node", "n_links", "component_id")
    named = nodes.join(shared, "h", "left").select("node", "h", F.when(F.col("shared"), F.col("v")).alias("same"))
    label = written(label.join(named, "node").drop("node").withColumnRenamed("h", "_h"), "vector-labels")
    r = rows.join(shared, "h", "left").select("vec_id", "h", F.when(F.col("shared"), F.col("v")).alias("v"))
    r = r.join(label, (r.h == label._h) & r.v.eqNullSafe(label.same), "left")
    r = r.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return r.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.vec_id),
    m AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
