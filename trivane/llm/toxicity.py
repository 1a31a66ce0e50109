"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed lower-case words. The machine scores it by
``w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)``, so that, beside each term's own weight, pairs of
terms (an insult with the mention of a group) have weights that they share through their factors.

The model is fitted on the driver from a bounded, documented sample of labelled rows (``SAMPLE``: those of
smallest identifier hash), where terms are screened by their association with the label, alone or in a pair
with any other term (a term that is neutral alone stays if a pair of it is not); it is some ten thousand numbers. Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bound_batches, lean, written
from .jaccard import _batch
from .textops import ALNUM, U, chunks, mix, word_hashes, word_spans

SAMPLE = 12_000
SLOTS = 1 << 22
MOST_TERMS, LEAST_DOCS, LEAST_CHI2 = 8192, 3, 15.0
LEAST_GAIN, PAIR_BLOCK = 60.0, 512  # what a pair's chi-squared has above that of either term; higher, as pairs are many
FACTORS, STEPS, RATE, DECAY = 8, 300, 0.1, 2e-4
DENSE_ROWS = 1500  # documents of the sample that are a matrix at a time
CUT = 0.7
FALSE_POSITIVE = 3.0  # weighs so many misses where the cut is chosen


def crc_fold(doc_id: Column, folds: int, held: int) -> Column:
    """Whether crc32 of the identifier as text leaves ``held``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, size: int) -> DataFrame:
    """(doc_id, y, text) of at most ``size`` labelled rows outside the held-out fold, by identifier hash.

    Rows without identifier or label do not count; of several labels of a document the largest does, of
    several texts under one identifier the first in order (null after all others).
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~crc_fold(F.col("doc_id"), folds, held))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = written(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size), "sample-ids")
    return docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("doc_id", "text", "y")


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of all words of a chunk."""
    starts, ends, first = word_spans(data, off, ALNUM)
    h = word_hashes(data, starts, ends, fold=True)
    return np.repeat(np.arange(len(off) - 1), np.diff(first)), (h & U(SLOTS - 1)).astype(np.int64)


def cut_point(z: np.ndarray, y: np.ndarray, weight: float = 1.0) -> float:
    """The middle of the widest interval of cuts with least errors; a false positive counts ``weight``."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    below = np.concatenate([[0], np.cumsum(y)])  # positives below each cut
    cost = below + weight * ((y == 0).sum() - (np.arange(len(y) + 1) - below))
    cost = np.where(np.diff(edges) > 0, cost, np.inf)
    best = np.flatnonzero(cost == cost.min())
    k = best[np.argmax(np.diff(edges)[best])]
    return float((edges[k] + edges[k + 1]) / 2)


@dataclass
class FactorizationMachine:
    """Sorted slots of the terms kept, their weights and factors."""

    slots: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    shift: float = 0.0  # moves the best cut to a score of 0.7

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.logits(rows, terms, n) + self.shift)

    def logits(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents from (row, index of term) of their distinct kept terms."""
        out = np.full(n, self.w0)
        out += np.bincount(rows, self.w[terms], n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            out += (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n)) / 2
        return out

    def kept(self, rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.slots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        hit = self.slots[at] == slots
        both = np.unique(rows[hit].astype(np.int64) * len(self.slots) + at[hit])
        return both // len(self.slots), both % len(self.slots)


    def kept_of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``kept`` of whole documents, some at a time."""
        parts = [self.kept(np.repeat(np.arange(k, min(k + 500, len(sets))), [len(s) for s in sets[k : k + 500]]), np.concatenate(sets[k : k + 500])) for k in range(0, len(sets), 500)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chi_squared(df, hit, n: int, pos: int):
    """Of the two by two tables of label and presence; ``hit`` of ``df`` documents have the label."""
    a, b, c = hit, df - hit, pos - hit
    d = n - pos - b
    return n * (a * d - b * c) ** 2 / np.maximum(df * (n - df) * float(pos) * (n - pos), 1e-9)


def one_of_copies(sets: list[np.ndarray]) -> np.ndarray:
    """Of documents that share much of their terms the first: such as agree in two of eight minimum hashes side by side."""
    some = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if not len(some):
        return some
    flat, starts = np.concatenate([sets[k] for k in some]).astype(U), np.cumsum([0, *[len(sets[k]) for k in some[:-1]]])
    least = [np.minimum.reduceat(mix(flat + U((j + 1) << 32)), starts) for j in range(8)]
    root = np.arange(len(some))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for j in range(0, 8, 2):
        met: dict[tuple[int, int], int] = {}
        for k, band in enumerate(zip(least[j].tolist(), least[j + 1].tolist(), strict=True)):
            a, b = find(met.setdefault(band, k)), find(k)
            root[max(a, b)] = min(a, b)
    return some[[k for k in range(len(some)) if find(k) == k]]


def pair_gains(sets: list[np.ndarray], y: np.ndarray, terms: np.ndarray, df: np.ndarray, hit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each of ``terms`` the most by which a pair's chi-squared exceeds both terms' own, 0 below ``LEAST_GAIN``.

    All pairs are counted, but of terms that are too rare for any pair to reach the bound even if all its
    documents had one label. Pairs are counted by blocks of products of 0/1 matrices.
    """
    n, pos = len(y), int(y.sum())
    out, clean = np.zeros(len(terms)), df - hit
    able = np.flatnonzero((hit * (n - pos) * n >= LEAST_GAIN * pos * (n - hit)) | (clean * pos * n >= LEAST_GAIN * (n - pos) * (n - clean)))
    place = np.full(SLOTS, -1, np.int32)
    place[terms[able]] = np.arange(len(able))
    chunks_ = []  # (label, row, column) of at most PAIR_BLOCK documents of a label
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        for i in range(0, len(of), PAIR_BLOCK):
            cols = [place[sets[k]] for k in of[i : i + PAIR_BLOCK]]
            rows, cols = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols)
            chunks_.append((label, rows[cols >= 0], cols[cols >= 0]))
    for i in range(0, len(able), PAIR_BLOCK):
        j = min(i + PAIR_BLOCK, len(able))
        both = [np.zeros((j - i, len(able) - i), np.float32) for _ in (0, 1)]
        for label, rows, cols in chunks_:
            x = np.zeros((PAIR_BLOCK, len(able) - i), np.float32)
            x[rows[cols >= i], cols[cols >= i] - i] = 1
            both[label] += x[:, : j - i].T @ x
        for k in range(j - i):
            h, docs = both[1][k].astype(float), both[0][k].astype(float) + both[1][k]
            gain = chi_squared(docs, h, n, pos) - np.maximum(own[able[i + k]], own[able[i:]])
            gain[(docs < 2 * LEAST_DOCS) | (gain < LEAST_GAIN)] = 0
            out[able[i:]] = np.maximum(out[able[i:]], gain)
            out[able[i + k]] = max(out[able[i + k]], gain.max())
    return out


def _counts(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each slot, and those with the label."""
    df, hit = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for s, k in zip(sets, y, strict=True):  # a set holds a slot once
        df[s] += 1
        if k:
            hit[s] += 1
    return df.astype(float), hit.astype(float)


def fit(sets: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
    """Screen terms and fit by Adam on the logistic loss; deterministic."""
    n, pos = len(y), int(y.sum())
    none = FactorizationMachine(np.zeros(0, np.int64), float(np.log((pos + 0.5) / (n - pos + 0.5))), np.zeros(0), np.zeros((0, FACTORS)))
    if not pos or pos == n:
        return none
    df, hit = _counts(sets, y)
    terms = np.flatnonzero(df >= LEAST_DOCS)
    df, hit = df[terms], hit[terms]
    chi2 = chi_squared(df, hit, n, pos)
    # A copied document would make pairs of all its terms: of copies one counts here.
    once = one_of_copies(sets)
    few = [sets[k] for k in once]
    df_1, hit_1 = _counts(few, y[once])
    n_1, pos_1 = len(once), int(y[once].sum())
    gain = pair_gains(few, y[once], terms, df_1[terms], hit_1[terms], chi_squared(df_1[terms], hit_1[terms], n_1, pos_1)) if 0 < pos_1 < n_1 else np.zeros(len(terms))
    good = np.flatnonzero((chi2 >= LEAST_CHI2) | (gain > 0))
    most = np.maximum(chi2, gain)
    good = np.sort(good[np.lexsort((good, -most[good]))][:MOST_TERMS])
    if not len(good):
        return none
    model = FactorizationMachine(terms[good], none.w0, np.zeros(len(good)), np.random.default_rng(5).normal(0, 0.05, (len(good), FACTORS)))
    r, t = model.kept_of(sets)
    present = np.zeros((n, len(good)), np.uint8)
    present[r, t] = 1
    m, q = [np.zeros((len(good), FACTORS + 1)), np.zeros(1)], [np.zeros((len(good), FACTORS + 1)), np.zeros(1)]
    decay = np.r_[np.full(FACTORS, 10 * DECAY), DECAY]
    for step in range(1, STEPS + 1):
        # Factors, then the weight, then the factors' squares; blocks of documents as matrix products.
        params = np.concatenate([model.v, model.w[:, None], (model.v**2).sum(1, keepdims=True)], 1).astype(np.float32)
        grad, bias, squares = np.zeros((len(good), FACTORS + 1)), 0.0, np.zeros(len(good))
        for i in range(0, n, DENSE_ROWS):
            x = present[i : i + DENSE_ROWS].astype(np.float32)
            s = x @ params
            z = model.w0 + s[:, FACTORS] + ((s[:, :FACTORS] ** 2).sum(1) - s[:, FACTORS + 1]) / 2
            g = (sigmoid(z) - y[i : i + DENSE_ROWS]) / n
            both = x.T @ np.concatenate([g[:, None] * s[:, :FACTORS], g[:, None]], 1).astype(np.float32)
            grad += both
            squares += both[:, FACTORS]
            bias += g.sum()
        grad[:, :FACTORS] -= squares[:, None] * model.v
        grad += decay * np.concatenate([model.v, model.w[:, None]], 1)
        steps = []
        for k, g in enumerate((grad, np.array([bias]))):
            m[k] = 0.9 * m[k] + 0.1 * g
            q[k] = 0.99 * q[k] + 0.01 * g**2
            steps.append(RATE * (1 - (step - 1) / STEPS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8))
        model.v, model.w, model.w0 = model.v - steps[0][:, :FACTORS], model.w - steps[0][:, FACTORS], model.w0 - float(steps[1][0])
    return model


def fit_with_cut(sets: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
    """Fit on all; the cut comes from two half models, each judged on the other half."""
    model = fit(sets, y)
    if not len(model.slots):
        return model
    z = np.zeros(len(y))
    for half in (0, 1):
        learn, judge = np.flatnonzero(np.arange(len(y)) % 2 != half), np.flatnonzero(np.arange(len(y)) % 2 == half)
        m = fit([sets[i] for i in learn], y[learn])
        z[judge] = m.logits(*m.kept_of([sets[i] for i in judge]), len(judge)) if len(m.slots) else m.w0
    model.shift = float(np.log(CUT / (1 - CUT)) - cut_point(z, y, FALSE_POSITIVE))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, size: int = SAMPLE) -> FactorizationMachine:
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("terms", pa.binary())])

    def run(batches):
        for b in batches:
            out = []
            for _, _, data, off in chunks(b.column(2)):
                rows, slots = _terms(data, off)
                cut = np.searchsorted(rows, np.arange(len(off)))
                out += [zlib.compress(np.unique(slots[cut[k] : cut[k + 1]]).astype(np.int32).tobytes(), 1) for k in range(len(off) - 1)]
            yield _batch(schema, b.column(0), b.column(1), out)

    with arrow_rows(docs.sparkSession, 1000):
        sample = labelled_sample(docs, labels, label, folds, held, size).select("doc_id", "y", "text")
        got = sorted((r["doc_id"], r["y"], r["terms"]) for r in sample.mapInArrow(lean(run), "doc_id long, y int, terms binary").collect())
    sets = [np.frombuffer(zlib.decompress(x[2]), np.int32) for x in got]
    return fit_with_cut(sets, np.array([x[1] for x in got]))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(all columns of ``docs``) and score, predicted: 1 where score is at least 0.7.

    Only the text is looked at. A null, empty or wordless text scores the model's bias. Repeated rows score
    alike; columns of ``docs`` named score or predicted are replaced; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    keep = docs.drop("score", "predicted")
    cast = keep.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches):
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i, j, data, off in chunks(b.column(b.schema.get_field_index("text"))):
                scores[i:j] = model.scores(*model.kept(*_terms(data, off)), j - i)
            more = [pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "score", "predicted"])

    return keep.mapInArrow(lean(run), cast)


def op3_toxicity(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", crc_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
