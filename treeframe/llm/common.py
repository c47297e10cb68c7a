"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes in numpy: an Arrow batch of strings already is one byte
buffer with offsets, so words, hashes and counts of a whole batch are a few vector
operations. A word is a maximal run of ASCII letters, digits and non-ASCII characters, with
A-Z lowered; every byte of a non-ASCII character is at least 0x80, so words can be told
from bytes alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vector pass takes at most, unless one text alone is longer.
PASS_BYTES = 1 << 18

#: Two multipliers of polynomial hashes.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _tables() -> tuple[np.ndarray, ...]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    value = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240517, 71)]
    return lower, word, *value


LOWER, IS_WORD, BYTE_VALUE, OTHER_VALUE = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits of a polynomial hash can be used."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = [np.empty(0, np.uint64)] * 4


def powers(n: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i below n, modulo 2**64, of the first or the other multiplier."""
    at = 2 * other
    if len(_powers[at]) < n:
        size = max(n, PASS_BYTES + 4096)
        m = _MULTIPLIERS[other]
        for k, x in enumerate((m, pow(m, -1, 1 << 64))):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[at + k] = np.multiply.accumulate(p)
    return _powers[at][:n], _powers[at + 1][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return (raw[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about limit bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of a slice of texts: start, end (bytes in the slice), hash, and the text each is in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[raw]
        self.offsets = offsets
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = IS_WORD[raw]
        # A text's end also ends a word: cut by counting runs apart at the offsets.
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        if len(cuts):
            cuts = np.unique(cuts)
            cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            if len(cuts):
                start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        self.start, self.end = start, end
        self.bounds = np.searchsorted(start, offsets)
        power, self.inverse = powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.low] * power[: len(raw)], out=self.prefix[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        start, end = self.start if start is None else start, self.end if end is None else end
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def text_of(self) -> np.ndarray:
        """For each word, the row of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def word_slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) for slices of a string column."""
    raw, offsets = string_buffers(column)
    for a, b in slices(offsets):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="treeframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/treeframe-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path.rpartition("/")[0]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no plan reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: edges (a, b) to rows (node, root), root the least node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until no
    edge changes. Minima and each round's edges are written to the shared folder: so both sides
    of a join are plain exchanges, of which Spark splits the one that holds a hub's edges. Nodes
    without edges to others do not appear, and an empty table gives an empty one.
    """
    last = now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # Large star: every neighbour above u gets u's least neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.where("u <> v").distinct(), "edges")
        # Small star: u's neighbours below it, and u, get the least of them.
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now = stash(small.distinct(), "edges")
        discard(last, least, large, low)
        last = now
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About size rows by a hash of key, and never over twice as many; all, if there are no more.

    A filter with a rate from a count, not a sort: no task or driver sees more than its share.
    """
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(size / n * (1 << 30))).limit(2 * size)
