"""Quality: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a few bounded statistics. Either class has its mean and a covariance shrunk
towards the pooled one and towards its diagonal (regularised discriminant analysis); its Cholesky
factor is computed once and cached in the model. The score is the logistic of the difference of the
two log densities (Mahalanobis distances, log determinants, priors), moved on the
sample so that the best cut is 0.7.

The fit uses a bounded, documented sample (``SAMPLE`` labelled rows of smallest identifier hash), of which
only the statistics reach the driver. Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bound_batches, lean
from .jaccard import _batch
from .textops import ALNUM, NOT_SPACE, chunks, mix, word_hashes, word_spans
from .toxicity import crc_fold, cut_point, labelled_sample, sigmoid

SAMPLE = 12_000
CUT = 0.7
TOWARDS_POOLED, TOWARDS_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
REACH = 8.0  # standardised statistics are held within so many deviations

NAMES = ["log words", "mean word length", "spread of word lengths", "share of letters and digits", "share of digits", "share of capitals", "share of symbols", "share of symbol words", "distinct words", "most frequent word", "words repeating the last", "distinct word pairs", "log words a line", "repeated lines"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics a text; all finite, also for empty texts."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    starts, ends, first = word_spans(data, off, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    count = np.diff(first)
    some = np.maximum(count, 1).astype(float)
    row = np.repeat(np.arange(n), count)
    byte_row = np.repeat(np.arange(n), np.diff(off))
    share = lambda mask: np.bincount(byte_row[mask], minlength=n) / size
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / some
    var = np.maximum(np.bincount(row, length * length, n) / some - mean * mean, 0)
    alnum = ALNUM[data]
    digit = (data >= 48) & (data <= 57)
    symbol = ~alnum & NOT_SPACE[data]
    upper = (data >= 65) & (data <= 90)
    seen = np.concatenate([[0], np.cumsum(alnum)])
    bare = seen[ends] == seen[starts]  # words without letter or digit

    def repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the largest count of one, for each row."""
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, r[at], np.diff(np.append(at, len(k))))
        return np.bincount(r[at], minlength=n), top

    distinct, top = repeats(words, row)
    pair = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    pairs = mix(words[:-1] + mix(words[1:]))[pair] if len(words) else words
    pair_row = row[1:][pair] if len(row) else row
    n_pairs = np.maximum(np.bincount(pair_row, minlength=n), 1)
    distinct_pairs, _ = repeats(pairs, pair_row)
    same = np.bincount(row[1:][pair & (words[1:] == words[:-1])], minlength=n) if len(row) else np.zeros(n)
    line = NOT_SPACE.copy()
    line[:] = True
    line[10] = False
    ls, le, lf = word_spans(data, off, line)
    lines = np.diff(lf)
    line_row = np.repeat(np.arange(n), lines)
    distinct_lines, _ = repeats(word_hashes(data, ls, le), line_row)
    one = np.maximum(lines, 1)
    root = lambda x: np.sqrt(np.clip(x, 0, 1))
    return np.stack([
        np.log1p(count), np.log1p(mean), np.log1p(np.sqrt(var)), share(alnum), root(share(digit)), root(share(upper)), root(share(symbol)),
        root(np.bincount(row[bare], minlength=n) / some), distinct / some, root(top / some), root(same / some), distinct_pairs / n_pairs, np.log1p(count / one), 1 - distinct_lines / one,
    ], 1)


@dataclass
class Discriminant:
    """Two Gaussians over standardised statistics, by cached inverse Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray
    slope: float
    shift: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -REACH, REACH)
        parts = [self.offsets[c] - (((z - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) / 2 for c in (0, 1)]
        return parts[1] - parts[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.difference(x) + self.shift)


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit; with one class only, every text scores that class's smoothed share."""
    d = x.shape[1]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if n.min() < 2:
        share = (n[1] + 0.5) / (n.sum() + 1)
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -REACH, REACH)
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    own = [(z[y == c] - means[c]).T @ (z[y == c] - means[c]) / n[c] for c in (0, 1)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    whiten, offsets = [], []
    for c in (0, 1):
        s = (1 - TOWARDS_POOLED) * own[c] + TOWARDS_POOLED * pooled
        s = (1 - TOWARDS_DIAGONAL) * s + TOWARDS_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(low))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    model = Discriminant(centre, scale, means, np.stack(whiten), np.array(offsets), 1.0, 0.0)
    t = model.difference(x)
    cut = cut_point(t, y)
    model.slope = float(3 / max(1.0, np.median(np.abs(t - cut))))
    model.shift = float(np.log(CUT / (1 - CUT)) - model.slope * cut)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, size: int = SAMPLE) -> Discriminant:
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            rows = [x.tobytes() for _, _, data, off in chunks(b.column(2)) for x in statistics(data, off)]
            yield _batch(schema, b.column(0), b.column(1), rows)

    with arrow_rows(docs.sparkSession, 1000):
        sample = labelled_sample(docs, labels, label, folds, held, size).select("doc_id", "y", "text")
        got = sorted((r["doc_id"], r["y"], r["x"]) for r in sample.mapInArrow(lean(run), "doc_id long, y int, x binary").collect())
    x = np.array([np.frombuffer(r[2]) for r in got]) if got else np.zeros((0, len(NAMES)))
    return fit(x, np.array([r[1] for r in got]))


def score_quality(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(all columns of ``docs``) and score, predicted: 1 where score is at least 0.7.

    Only the text is looked at. A null text scores like an empty one. Repeated rows score alike; columns of
    ``docs`` named score or predicted are replaced; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    keep = docs.drop("score", "predicted")
    cast = keep.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches):
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i, j, data, off in chunks(b.column(b.schema.get_field_index("text"))):
                scores[i:j] = model.scores(statistics(data, off))
            more = [pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "score", "predicted"])

    return keep.mapInArrow(lean(run), cast)


def op6_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", crc_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
