"""Toxicity: a counterfactual-regularised linear classifier over hashed words and word prefixes.

Training takes a bounded sample of labelled texts (about ``sample`` rows, each of
``sample_bytes`` at most; both are parameters) to the driver, keeps the features that tell the classes apart
there, and fits a logistic regression with an L1 term. Labelled sentences that hold an
identity term are copied with the term swapped for each other one of its group, and
``swap_weight`` times the squared change of their scores is added to the loss; a bounded
number of labelled sentences get a term put in, so that the penalty also acts on terms that
the sample lacks. Scoring is one pass over every whole text, in vectors over Arrow batches,
without a shuffle; the model is a fixed-size table.

Defined results: a null or empty text has no feature and gets the score of the intercept
alone; a text of any length is scored whole; a null id is carried along; repeated rows get the
same score; an empty table gives an empty result; only the named columns are read, so extra
columns don't matter. With no usable labelled row of one class the score is the smoothed rate
of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_sample, slices, string_buffers, word_slices

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)

# Identity terms by group; terms of one group are swapped for each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("mujeres", "hombres", "musulmanes", "cristianos"),
    ("frauen", "männer", "muslime", "christen"),
    ("femmes", "hommes", "musulmans", "chrétiens"),
)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, 2**BITS
    intercept: float


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text row, feature) of every word and word prefix, with repeats."""
    row, shift = w.text_of(), np.uint64(64 - BITS)
    rows, found = [row], [(w.hashes() >> shift).astype(np.int64)]
    for n in PREFIXES:
        at = np.flatnonzero(w.end - w.start > n)
        rows.append(row[at])
        found.append((w.hashes(w.start[at], w.start[at] + n) * np.uint64(2 * n + 1) >> shift).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _text_features(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b, w in word_slices(pa.array(texts, pa.string())):
        row, f = _features(w)
        both = np.unique((row << BITS) | f)
        out += np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, b - a)))
    return out


def _swaps(texts: list[str], most: int) -> list[tuple[str, str]]:
    """Pairs of sentences that differ by an identity term alone."""
    group = {t: g for g in IDENTITY_GROUPS for t in g}
    pairs: list[tuple[str, str]] = []
    plain: list[str] = []
    for text in texts:
        for sentence in text.replace("\n", ". ").split(". "):
            words = sentence.split()
            at = [i for i, x in enumerate(words) if x.lower().strip(".,;:!?") in group]
            for i in at[:2]:
                term = words[i].lower().strip(".,;:!?")
                pairs += [(sentence, " ".join([*words[:i], other, *words[i + 1 :]])) for other in group[term] if other != term]
            if not at and 3 <= len(words) <= 40 and len(plain) < most:
                plain.append(sentence)
        if len(pairs) >= 20 * most:
            break
    for k, sentence in enumerate(plain):
        g = IDENTITY_GROUPS[k % len(IDENTITY_GROUPS)]
        a, b = g[k // len(IDENTITY_GROUPS) % len(g)], g[(k // len(IDENTITY_GROUPS) + 1) % len(g)]
        pairs.append((f"{sentence} {a}", f"{sentence} {b}"))
    return pairs


def fit(texts: list[str], labels: list[int], swap_weight: float = 5.0, l1: float = 5e-5, steps: int = 300, swapped_sentences: int = 200, least_docs: int = 4, least_z: float = 2.5) -> ToxicityModel:
    """Logistic regression by accelerated proximal steps; see the module's docstring."""
    y = np.asarray(labels, np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(weights, float(np.log(rate / (1 - rate))))
    texts = [t or "" for t in texts]
    found = _text_features(texts)
    row = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    col = np.concatenate(found)
    pos = np.bincount(col[y[row] == 1], minlength=1 << BITS)
    seen = np.bincount(col, minlength=1 << BITS)
    expect = seen * rate
    z = (pos - expect) / np.sqrt(np.maximum(expect * (1 - rate), 1e-9))
    pairs = _swaps(texts, swapped_sentences)
    a, b = (_text_features([p[k] for p in pairs]) for k in (0, 1)) if pairs else ([], [])
    in_pairs = np.zeros(1 << BITS, bool)
    for f, g in zip(a, b, strict=True):
        in_pairs[np.setxor1d(f, g)] = True
    kept = np.flatnonzero((seen >= least_docs) & ((np.abs(z) >= least_z) | in_pairs))
    if not len(kept):
        return ToxicityModel(weights, float(np.log(rate / (1 - rate))))
    index = np.full(1 << BITS, -1)
    index[kept] = np.arange(len(kept))
    ok = index[col] >= 0
    row, col = row[ok], index[col[ok]]
    drow = np.repeat(np.arange(len(a)), [len(np.setxor1d(f, g)) for f, g in zip(a, b, strict=True)]) if pairs else np.empty(0, int)
    diff = [(np.setdiff1d(f, g), np.setdiff1d(g, f)) for f, g in zip(a, b, strict=True)]
    dcol = np.concatenate([np.concatenate(d) if d[0].size + d[1].size else np.empty(0, int) for d in diff]).astype(int) if pairs else np.empty(0, int)
    dval = np.concatenate([np.concatenate([np.ones(len(d[0])), -np.ones(len(d[1]))]) for d in diff]) if pairs else np.empty(0)
    # setxor1d sorts; keep rows in step with (only-in-a, only-in-b).
    ok = index[dcol] >= 0
    drow, dcol, dval = drow[ok], index[dcol[ok]], dval[ok]

    n, m, pairs_n = len(found), len(kept), max(1, len(pairs))
    w, c = np.zeros(m), float(np.log(rate / (1 - rate)))
    v, vc, t = w.copy(), c, 1.0
    # A diagonal that bounds the Hessian, so that rare features take long steps.
    bound = 0.25 * np.bincount(col, np.bincount(row, minlength=n)[row] + 1.0, m) / n
    if len(drow):
        bound += 2 * swap_weight * np.bincount(dcol, np.bincount(drow, minlength=pairs_n)[drow].astype(float), m) / pairs_n
    step = 1 / np.maximum(bound, 1e-9)
    step_c = 1 / (0.25 * (1 + len(col) / n))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], n) + vc, -30, 30)))
        g = np.bincount(col, (p - y)[row], m) / n
        if len(drow):
            gap = np.bincount(drow, v[dcol] * dval, pairs_n)
            g += 2 * swap_weight * np.bincount(dcol, gap[drow] * dval, m) / pairs_n
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_c = vc - step_c * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vc = new + (t - 1) / t2 * (new - w), new_c + (t - 1) / t2 * (new_c - c)
        w, c, t = new, new_c, t2
    weights[kept] = w
    return ToxicityModel(weights, c)


def score_texts(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    raw, offsets = string_buffers(column)
    out = np.full(len(column), model.intercept)
    for a, b in slices(offsets):
        w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        row, f = _features(w)
        on = model.weights[f] != 0
        both = np.unique((row[on] << BITS) | f[on])
        out[a:b] += np.bincount(both >> BITS, model.weights[both & ((1 << BITS) - 1)], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable=None, sample: int = 6000, sample_bytes: int = 1 << 16, **options) -> ToxicityModel:
    """Fit on about ``sample`` labelled rows, taken by a hash of the id; never over twice as many."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    if usable is not None:
        rows = rows.where(usable(F.col("_id")))
    rows = hash_sample(rows.groupBy("_id").agg(F.max("_y").alias("_y")), "_id", sample)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.octet_length("text") <= sample_bytes)
    got = texts.join(F.broadcast(rows), "_id").select("_id", "_text", "_y").toArrow().sort_by("_id")
    return fit(got["_text"].to_pylist(), got["_y"].to_pylist(), **options)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """Every row of docs as (doc_id, score, predicted)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), sent.value))], ["doc_id", "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([StructField("doc_id", kind), StructField("score", DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def below(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score threshold or more; columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at), sent.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
