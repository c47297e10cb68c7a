"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length within their dimension and cut into buckets of at most
``bucket_rows``; a bucket is one row of packed matrices. A query first gets a threshold, its k-th
best score among at most ``seed_rows`` of the longest vectors (the only rows that are sent to all
tasks); queries are then sorted by the length that a vector needs to reach it, packed alike, and
taken in groups of GROUP_BLOCKS blocks. A grid of cells deals groups of queries to groups of
buckets: a bucket goes to those groups alone of which some query can reach its longest vector, a
cell holds a bounded number of queries and reads its buckets one by one, and a larger query set
makes more cells, not larger ones. In a bucket with
greatest length l it needs a cosine of at least threshold / (|q| l): above 1 the bucket is
skipped; a high one prunes by coordinates (the two largest of the query bound what a candidate's
may be, found by binary search in sorted columns); a low one prunes by length alone (the
bucket's rows that are long enough). What is left is verified by exact integer products.
Thresholds rise as a cell goes on, and a cell sends at most k rows a query.

Vectors take part if they and their id are not null and every component is finite; a vector
meets those of its own dimension only. Defined results: repeated candidates count each,
queries with the same id and vector once; a query with fewer than k candidates gets them all;
ties go to the smaller id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, stash

_PACKED = "dim int, longest double, ids binary, vectors binary"
_CELL = ("dim", "group", "share")
GROUP_BLOCKS, SHARE_BUCKETS, MOST_GROUPS = 16, 64, 1 << 16


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """id, v (floor(scale * x) of each component), and norm2, of the vectors that take part."""
    x = F.col("embedding")
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    out = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).withColumn("dim", F.size("v"))


def _pack(most: int):
    def run(batches):
        for batch in batches:
            norm2 = batch.column(3).to_numpy()
            for rows, ids, v in _matrices(batch):
                for a in range(0, len(ids), most):
                    longest = float(np.sqrt(norm2[rows][a : a + most].max()))
                    yield pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([longest]), pa.array([ids[a : a + most].astype("<i8").tobytes()]), pa.array([v[a : a + most].astype("<i8").tobytes()])], ["dim", "longest", "ids", "vectors"])

    return run


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<i8").reshape(len(i), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64).copy()
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        on = scores >= self.least[q]
        if not on.any():
            return
        s, i = np.concatenate([self.scores[q], scores[on]]), np.concatenate([self.ids[q], ids[on]])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(s[order[-1]]))


def search_bucket(best: Best, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> dict[str, int]:
    """Update best for the queries numbered rows with a bucket's vectors; how each was pruned."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -length))
    ids, vectors, length = ids[order], vectors[order], length[order]
    q_length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    slack = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = best.least[rows] * slack / (q_length * length[0])
    local = np.where(q_length * length[0] == 0, np.where(best.least[rows] > 0, np.inf, -np.inf), local)
    skipped = local > 1
    by_coordinate = ~skipped & (local > 0.7) & (vectors.shape[1] > 0)
    columns = None
    for k in np.flatnonzero(by_coordinate):
        if columns is None:
            unit = vectors / np.where(length == 0, 1, length)[:, None]
            by = np.argsort(unit, axis=0, kind="stable")
            columns = np.take_along_axis(unit, by, 0)
        q, t = queries[k] / q_length[k], local[k]
        # A vector reaches the threshold only if its own cosine is at least t, for it is no longer than the longest.
        keep = None
        for f in np.argsort(-np.abs(q))[:2]:
            half = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f]))) + 1e-9
            lo, hi = np.searchsorted(columns[:, f], [t * q[f] - half, t * q[f] + half])
            if abs(q[f]) >= t:  # the cap holds the pole of this coordinate
                lo, hi = (lo, len(ids)) if q[f] > 0 else (0, hi)
            found = by[lo:hi, f]
            keep = found if keep is None else np.intersect1d(keep, found, assume_unique=True)
        keep = keep[ids[keep] != query_ids[k]]
        if len(keep):
            best.add(int(rows[k]), _products(queries[k : k + 1], vectors[keep])[0], ids[keep])
    rest = np.flatnonzero(~skipped & ~by_coordinate)
    for a in range(0, len(rest), 256):
        part = rest[a : a + 256]
        need = np.where(best.least[rows[part]] > 0, best.least[rows[part]] * slack / np.maximum(q_length[part], 1e-300), -1)
        enough = np.searchsorted(-length, -need, "right")
        most = int(enough.max(initial=0))
        scores = _products(queries[part], vectors[:most])
        for j, k in enumerate(part):
            n = enough[j]
            own = ids[:n] != query_ids[k]
            best.add(int(rows[k]), scores[j, :n][own], ids[:n][own])
    return {"skipped": int(skipped.sum()), "coordinate": int(by_coordinate.sum()), "length": len(rest)}


def top_k(rows: DataFrame, every: int = 20, k: int = 20, bucket_rows: int = 2048, block_rows: int = 1024, seed_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id ``every`` divides."""
    spark = rows.sparkSession
    vectors = stash(integer_vectors(rows), "vectors")
    order = [F.col("dim"), F.col("norm2").desc(), F.col("id")]
    n = shuffle_partitions(spark)
    dealt = vectors.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "v", "dim", "norm2")
    buckets = stash(dealt.mapInArrow(_pack(bucket_rows), _PACKED), "buckets")
    seeds = spark.sparkContext.broadcast(_longest(vectors, seed_rows))

    queries = vectors.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).select("id", "v", "dim", "norm2")
    queries = queries.mapInArrow(_thresholds(seeds, k), "id long, v array<bigint>, dim int, least double, need double")
    order = [F.col("dim"), F.col("need"), F.col("id")]
    queries = queries.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = stash(queries.mapInArrow(_pack_queries(block_rows), "dim int, group long, need double, ids binary, vectors binary, least binary"), "queries")

    shares = -(-max(1, buckets.count()) // SHARE_BUCKETS)
    groups = stash(blocks.groupBy("dim", "group").agg(F.min("need").alias("need")), "groups")
    groups = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups  # 20 bytes each
    share = F.pmod(F.xxhash64("ids"), F.lit(shares))
    met = buckets.join(groups, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select(*_CELL[:2], share.alias("share"), F.lit(1).alias("kind"), "longest", "ids", "vectors", F.lit(None).cast("binary").alias("least"))
    asked = blocks.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    asked = asked.select(*_CELL, F.lit(0).alias("kind"), F.lit(0.0).alias("longest"), "ids", "vectors", "least")
    cells = asked.unionByName(met).repartition(n, *_CELL).sortWithinPartitions(*_CELL, "kind", F.desc("longest"))
    out = cells.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _longest(vectors: DataFrame, seed_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """About the longest vectors, ``seed_rows`` of them at most: ids and matrix by dimension.

    Any vectors give a threshold that holds, so an approximate quantile will do for the cut.
    """
    total = vectors.count()
    cut = vectors.agg(F.percentile_approx("norm2", F.lit(max(0.0, 1 - seed_rows / total)), F.lit(10000))).first()[0] if total else 0.0
    got = vectors.where(F.col("norm2") >= cut).select("id", "v", "dim").limit(seed_rows).toArrow()
    out, dims = {}, got["dim"].to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        out[int(d)] = got["id"].to_numpy()[at], np.array([got["v"][int(i)].as_py() for i in at], "<i8").reshape(len(at), d)
    return out


def _matrices(batch: pa.RecordBatch):
    """(rows, ids, matrix) of each run of equal dimensions of a batch (id, v, dim, ...)."""
    ids, lists, dims = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    cut = np.flatnonzero(dims[1:] != dims[:-1]) + 1
    for lo, hi in zip(np.concatenate([[0], cut]), np.append(cut, len(ids)), strict=True):
        if hi > lo:
            yield slice(lo, hi), ids[lo:hi], values[at[lo] : at[hi]].reshape(hi - lo, dims[lo])


def _thresholds(seeds, k: int):
    """Each query's k-th best score among the seeds, and the length that a vector needs to reach it."""

    def run(batches):
        for batch in batches:
            least, need = np.full(len(batch), -np.inf), np.full(len(batch), -np.inf)
            for rows, ids, q in _matrices(batch):
                seed_ids, seed = seeds.value.get(q.shape[1], (np.empty(0, np.int64), np.empty((0, q.shape[1]), np.int64)))
                if len(seed) <= k:
                    continue
                best = np.full(len(q), -np.inf)
                for a in range(0, len(q), 1024):
                    s = _products(q[a : a + 1024], seed)
                    s = np.where(seed_ids[None, :] == ids[a : a + 1024][:, None], np.iinfo(np.int64).min, s)
                    kth = np.partition(s, len(seed) - k, axis=1)[:, len(seed) - k]
                    best[a : a + 1024] = np.where(kth > np.iinfo(np.int64).min, kth, -np.inf)
                least[rows] = best
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need[rows] = np.where(best > 0, best / np.maximum(length, 1e-300), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(least), pa.array(need)], ["id", "v", "dim", "least", "need"])

    return run


def _pack_queries(most: int):
    def run(batches):
        from pyspark import TaskContext

        n, before = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            least, need = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for rows, ids, q in _matrices(batch):
                for a in range(0, len(ids), most):
                    part = slice(rows.start + a, min(rows.start + a + most, rows.stop))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([q.shape[1]], pa.int32()), pa.array([before | n // GROUP_BLOCKS]), pa.array([float(need[part].min())]), pa.array([ids[a : a + most].astype("<i8").tobytes()]),
                        pa.array([q[a : a + most].astype("<i8").tobytes()]), pa.array([least[part].astype("<f8").tobytes()]),
                    ], ["dim", "group", "need", "ids", "vectors", "least"])
                    n += 1

    return run


def _searched(k: int):
    def found(best: Best, ids: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(s) for s in best.scores])), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    def run(batches):
        cell, held, ids, queries, best = None, [], None, None, None
        for batch in batches:
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (here := tuple(r[c] for c in _CELL)) != cell:
                    if best is not None:
                        yield found(best, ids)
                    cell, held, best = here, [], None
                if not r["kind"]:
                    held.append((*_unpacked(r["ids"], r["vectors"], r["dim"]), np.frombuffer(r["least"], "<f8")))
                    continue
                if best is None:
                    ids, queries, least = (np.concatenate(x) for x in zip(*held, strict=True))
                    best = Best(len(ids), k, least)
                search_bucket(best, np.arange(len(ids)), ids, queries, *_unpacked(r["ids"], r["vectors"], r["dim"]))
        if best is not None:
            yield found(best, ids)

    return run
