"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x), with one weight vector over hashed text features
shared by all grades and ordered thresholds theta. From it come each text's expected grade
and its tail probability P(grade >= keep_from), by which ``selected`` is decided.

Features are frequencies, on a log scale, of hashed words, word shapes and the gaps between
words, and a few whole-text figures (repetition, size). Training takes about ``sample``
rated texts of at most ``sample_bytes`` each (parameters) to the driver; scoring is one pass
over every whole text without a shuffle, with a model of fixed size.

Defined results: a null or empty text has only the figures of an empty text; null ids are
carried along; repeated rows get the same scores; an empty table gives an empty result; extra
columns are not read. If all ratings agree, that grade is expected everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, hash_sample, mix, slices, string_buffers, word_slices

WORDS, SHAPES, GAPS, FIGURES = 512, 512, 1024, 16
WIDTH = WORDS + SHAPES + GAPS + FIGURES

_KIND = np.zeros(256, np.int64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3


@dataclass
class QualityModel:
    grades: list[int]
    weights: np.ndarray  # float32, WIDTH
    thresholds: np.ndarray  # float64, one less than grades
    keep_from: int


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDTH frequencies for each text of a slice."""
    w, n = Words(raw, offsets), len(offsets) - 1
    row, h = w.text_of(), w.hashes()
    words = np.diff(w.bounds)
    per = 1.0 / np.maximum(words, 1)
    counts = np.zeros((n, WIDTH), np.float32)

    def add(rows, feature, first, width):
        counts[:, first : first + width] = np.bincount(rows * width + feature, minlength=n * width).reshape(n, width)

    add(row, (h >> np.uint64(55)).astype(np.int64), 0, WORDS)
    if len(row):
        kind = _KIND[raw]
        first, last = kind[w.start], kind[w.end - 1]
        size = np.minimum(w.end - w.start, 31)
        add(row, (first * 4 + last) * 32 + size, WORDS, SHAPES)
        # The gap after a word, up to the next word or the text's end.
        stop = np.append(w.start[1:], len(raw))
        stop = np.minimum(stop, offsets[1:][row])
        gap = w.hashes(w.end, stop)
        add(row, (mix(gap) >> np.uint64(54)).astype(np.int64), WORDS + SHAPES, GAPS)
    x = np.log2(1 + 1000 * counts * per[:, None].astype(np.float32)) / 10
    at = WORDS + SHAPES + GAPS
    order = np.lexsort((h, row))
    new = np.ones(len(row), bool)
    if len(row):
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        same = np.zeros(len(row), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        pair = np.zeros(len(row), np.uint64)
        pair[1:] = mix(h[1:] * np.uint64(3) + h[:-1])
        o2 = np.lexsort((pair, row))
        new2 = np.ones(len(row), bool)
        new2[1:] = (pair[o2][1:] != pair[o2][:-1]) | (row[o2][1:] != row[o2][:-1])
        x[:, at] = np.bincount(row[order], new, n) * per
        x[:, at + 1] = np.bincount(row[o2], new2, n) * per
        x[:, at + 2] = np.bincount(row, same, n) * per
        x[:, at + 3] = np.bincount(row, w.end - w.start, n) * per / 16
    length = np.diff(offsets)
    x[:, at + 4] = np.log2(1 + words) / 16
    x[:, at + 5] = words == 0
    x[:, at + 6] = words < 20
    letters = np.add.reduceat(np.append(_KIND[raw] == 3, 0), np.minimum(offsets[:-1], len(raw))) * (length > 0)
    x[:, at + 7] = letters / np.maximum(length, 1)
    for k, edge in enumerate((0.2, 0.35, 0.5, 0.65, 0.8)):
        x[:, at + 8 + k] = x[:, at + 1] < edge
    x[:, at + 13] = x[:, at + 2] > 0.1
    return x


def _features(column: pa.Array):
    raw, offsets = string_buffers(column)
    for a, b in slices(offsets):
        yield a, b, text_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], ratings: list[int], keep_from: int, l2: float = 2e-5, steps: int = 400, rate: float = 0.05) -> QualityModel:
    """Maximum likelihood of the cumulative-link model by Adam; thresholds stay ordered as sums of exponentials."""
    grades = sorted(set(ratings))
    weights = np.zeros(WIDTH, np.float32)
    if len(grades) < 2:
        return QualityModel(grades or [keep_from], weights, np.empty(0), keep_from)
    x = np.concatenate([f for _, _, f in _features(pa.array([t or "" for t in texts], pa.string()))])
    y = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y)
    theta = np.log(share / (1 - share))
    base = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    mean = x.mean(0)
    x -= mean
    params = np.concatenate([np.zeros(WIDTH), base])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, base = params[:WIDTH], params[WIDTH:]
        theta = np.cumsum(np.concatenate([base[:1], np.exp(base[1:])]))
        z = x @ w.astype(np.float32)
        upper = _sigmoid(np.concatenate([theta, [np.inf]])[y] - z)
        lower = np.where(y > 0, _sigmoid(theta[np.maximum(y - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p / d theta_y, -d theta_{y-1}
        gz = (du - dl) / len(y)
        gtheta = (-np.bincount(y, du, k + 1)[:k] + np.bincount(y, dl, k + 1)[1:]) / len(y)
        tail = np.cumsum(gtheta[::-1])[::-1]
        gbase = np.concatenate([tail[:1], tail[1:] * np.exp(base[1:])])
        g = np.concatenate([x.T @ gz.astype(np.float32) + l2 * w, gbase])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = params[:WIDTH].astype(np.float32)
    base = params[WIDTH:]
    theta = np.cumsum(np.concatenate([base[:1], np.exp(base[1:])])) + float(mean @ weights)
    return QualityModel(grades, weights, theta, keep_from)


def score_texts(column: pa.Array, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, tail probability) for each text."""
    grades = np.asarray(model.grades, float)
    z = np.empty(len(column))
    for a, b, x in _features(column):
        z[a:b] = x @ model.weights
    at_most = np.concatenate([_sigmoid(model.thresholds[None, :] - z[:, None]), np.ones((len(z), 1))], 1)
    p = np.diff(at_most, axis=1, prepend=0)
    return p @ grades, p[:, grades >= model.keep_from].sum(1)


def train(docs: DataFrame, ratings: DataFrame, grade, keep_from: int, usable=None, sample: int = 5000, sample_bytes: int = 1 << 16, **options) -> QualityModel:
    """Fit on about ``sample`` rows of ratings (doc_id and the grade expression), by a hash of the id."""
    rows = ratings.select(F.col("doc_id").alias("_id"), grade.cast("int").alias("_y")).where("_y is not null and _id is not null")
    if usable is not None:
        rows = rows.where(usable(F.col("_id")))
    rows = hash_sample(rows.groupBy("_id").agg(F.min("_y").alias("_y")), "_id", sample)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.octet_length("text") <= sample_bytes)
    got = texts.join(F.broadcast(rows), "_id").select("_id", "_text", "_y").toArrow().sort_by("_id")
    return fit(got["_text"].to_pylist(), got["_y"].to_pylist(), keep_from, **options)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Every row of docs as (doc_id, expected_grade, p_keep, selected)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            expected, tail = score_texts(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "p_keep"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("expected_grade", DoubleType()), StructField("p_keep", DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("selected", F.col("p_keep") >= threshold)
