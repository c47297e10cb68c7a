"""Benchmark decontamination: an FM-index per training shard, searched for benchmark windows.

A shard is a run of whole documents, of about ``shard_bytes``, within one Spark partition. Its
words become vocabulary numbers of the benchmark (0: any other word, or a text's end); runs of
known words too short for any window are left out, since no occurrence can lie in them. Over
the rest the shard's suffixes are sorted, and the index keeps their Burrows-Wheeler transform
as a wavelet matrix, the counts of smaller symbols, and the positions of every SAMPLE-th
suffix and of those that start a run. All windows are searched backwards at once; rows of a
match are located by walking to a sampled suffix; covered words are merged into spans. Each
document is settled in its shard, so nothing is shuffled.

The benchmark is sent to the executors in blocks of at most ``block_bytes`` of text, one pass
for each block; all passes search the given text, and their hits are written and merged by
document before anything is cut; so what is broadcast is bounded whatever the benchmark's
size. Words are compared by 64-bit hashes.

Defined results: null has no words; an item without words has no window; repeated rows each
get their own result; a null item_id takes part but is not listed; repeated item_ids count
once; an empty benchmark hits nothing; empty tables give empty results; texts of any length
are whole within a shard; only the named columns are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, shared_folder, slices, string_buffers, word_slices

WINDOW = 10
SAMPLE = 16


@dataclass
class TestPhrases:
    """Distinct windows of a block of items, and the items that hold each."""

    vocabulary: np.ndarray  # uint64, sorted
    windows: np.ndarray  # int32 [windows, WINDOW], numbers from 1, aligned right, 0 in front
    lengths: np.ndarray
    item_at: np.ndarray  # windows + 1: where each window's items start in item_of
    item_of: np.ndarray
    items: list[str]


def phrases(item_ids: list[str | None], texts: list[str | None], window: int = WINDOW) -> TestPhrases:
    per_item: list[np.ndarray] = []
    for a, b, w in word_slices(pa.array([t or "" for t in texts], pa.string())):
        h = w.hashes()
        per_item += [h[w.bounds[r] : w.bounds[r + 1]] for r in range(b - a)]
    vocabulary = np.unique(np.concatenate([*per_item, np.empty(0, np.uint64)]))
    items = sorted({i for i in item_ids if i is not None})
    number = {x: k for k, x in enumerate(items)}
    rows, owner = [], []
    for i, h in zip(item_ids, per_item, strict=True):
        if not len(h):
            continue
        s = np.searchsorted(vocabulary, h).astype(np.int32) + 1
        s = np.concatenate([np.zeros(window - len(s), np.int32), s]) if len(s) < window else s
        rows.append(np.lib.stride_tricks.sliding_window_view(s, window))
        owner.append(np.full(len(rows[-1]), number.get(i, -1)))
    if not rows:
        return TestPhrases(vocabulary, np.empty((0, window), np.int32), np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), items)
    windows, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(owner)], 1), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    return TestPhrases(vocabulary, windows, (windows > 0).sum(1), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1], items)


class FmIndex:
    """Backward search over symbols 0..top; a 0 ends a run and differs from every other 0."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(text)
        sa = self._suffixes(text, top)
        self.n = n
        bwt = text[sa - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels: list[tuple[int, int, np.ndarray]] = []
        seq = bwt
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, n - int(ones[-1]), ones))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.bwt = bwt
        kept = (sa % sample == 0) | (bwt == 0)
        self.sampled = np.where(kept, sa, -1)

    @staticmethod
    def _suffixes(text: np.ndarray, top: int) -> np.ndarray:
        """Suffix order by doubling; only suffixes still tied are sorted again."""
        n = len(text)
        zero = text == 0
        z = int(zero.sum())
        key = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + z)
        order = np.argsort(key, kind="stable")
        start = np.ones(n, bool)
        start[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        k = 1
        while True:
            tied = ~(start & np.append(start[1:], True))
            at = np.flatnonzero(tied)
            if not len(at):
                return order
            pos = order[at]
            key = rank[pos] * np.int64(n + 1) + rank[np.minimum(pos + k, n - 1)]
            o = np.argsort(key, kind="stable")
            order[at] = pos[o]
            key = key[o]
            first = np.ones(len(at), bool)
            first[1:] = key[1:] != key[:-1]
            start[at] = first
            rank[order[at]] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            k *= 2

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        base = np.zeros_like(row)
        for level, zeros, ones in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            r1, b1 = ones[row], ones[base]
            row = np.where(bit, zeros + r1, row - r1)
            base = np.where(bit, zeros + b1, base - b1)
        return row - base

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, row after) of windows that occur."""
        which = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for back in range(windows.shape[1]):
            going = lengths[which] > back
            at = np.flatnonzero(going)
            c = windows[which[at], windows.shape[1] - 1 - back].astype(np.int64)
            low[at] = self.smaller[c] + self.rank(c, low[at])
            high[at] = self.smaller[c] + self.rank(c, high[at])
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        at = np.arange(len(rows))
        while True:
            at = at[self.sampled[rows[at]] < 0]
            if not len(at):
                return self.sampled[rows] + walked
            c = self.bwt[rows[at]].astype(np.int64)
            rows[at] = self.smaller[c] + self.rank(c, rows[at])
            walked[at] += 1


def search_shard(column: pa.Array, tests: TestPhrases) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, list[str]]]]:
    """(words of each text, hit words of each text, [(row, hit mask of its words, items)])."""
    n = len(column)
    numbers, n_words = [], np.zeros(n, np.int64)
    raw, offsets = string_buffers(column)
    for a, b in slices(offsets):
        w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        h = w.hashes()
        n_words[a:b] = np.diff(w.bounds)
        if len(tests.vocabulary):
            at = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
            ids = np.where(tests.vocabulary[at] == h, at + 1, 0).astype(np.int32)
        else:
            ids = np.zeros(len(h), np.int32)
        numbers.append(np.insert(ids, w.bounds[1:], 0))  # a 0 after each text
    hits = np.zeros(n, np.int64)
    if not len(tests.windows):
        return n_words, hits, []
    x = np.concatenate([*numbers, np.zeros(1, np.int32)])
    known = np.concatenate([[0], (x > 0).astype(np.int8), [0]])
    first, last = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = last - first >= tests.lengths.min()
    first, last = first[long], last[long]
    if not len(first):
        return n_words, hits, []
    size = last - first + 1  # the 0 after each run, too
    origin = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    index = FmIndex(x[origin], len(tests.vocabulary))
    which, low, high = index.search(tests.windows, tests.lengths)
    if not len(which):
        return n_words, hits, []
    count = high - low
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    window = np.repeat(which, count)
    place = origin[index.locate(rows)]
    cover = np.zeros(len(x) + 1, np.int32)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + tests.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    begin = np.concatenate([[0], np.cumsum(n_words + 1)])
    doc = np.searchsorted(begin, place, "right") - 1
    pairs = np.unique(np.stack([doc, window], 1), axis=0)
    out = []
    for d in np.unique(doc):
        mask = hit[begin[d] : begin[d] + n_words[d]]
        hits[d] = mask.sum()
        found = {k for v in pairs[pairs[:, 0] == d, 1] for k in tests.item_of[tests.item_at[v] : tests.item_at[v + 1]]}
        out.append((int(d), mask, sorted(tests.items[k] for k in found)))
    return n_words, hits, out


def _shards(batches, limit: int):
    """Arrow batches joined to runs of whole rows of about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        step = max(1, len(batch) * limit // max(1, batch.nbytes))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def _parts(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark as (i, t), by blocks of bounded text."""
    b = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    n = -(-(b.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes)
    return [b] if n <= 1 else [b.where(F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)) == k) for k in range(2 * n)]


def _phrases(part: DataFrame) -> TestPhrases:
    got = part.toArrow()
    return phrases(got["i"].to_pylist(), got["t"].to_pylist())


def _scan_block(docs: DataFrame, sent: Broadcast[TestPhrases], shard_bytes: int) -> DataFrame:
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("_key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType(fields))
        for shard in _shards(batches, shard_bytes):
            n_words, _, found = search_shard(_one(shard["text"]), sent.value)
            spans, items = [[] for _ in n_words], [[] for _ in n_words]
            for d, mask, names in found:
                spans[d] = [{"first": int(a), "last": int(b)} for a, b in zip(*_runs(mask), strict=True)]
                items[d] = names
            columns = [_one(shard["doc_id"]), _one(shard["_key"]), pa.array(n_words), spans, items]
            for batch in pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches():
                yield batch

    return docs.select("doc_id", "text", F.xxhash64("text").alias("_key")).mapInArrow(run, T.StructType(fields))


def merged_spans(spans: Column) -> Column:
    """Sorted half-open ranges with overlapping and touching ones joined."""
    start = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")

    def step(done, x):
        top = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def _all_spans(docs: DataFrame, parts: list[DataFrame], shard_bytes: int) -> DataFrame:
    """(_d, _k, _spans, _items) of the texts that any block hits, each block searched in the text as it is.

    A block's hits are written to the shared folder before the next block's windows are built.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/treeframe-{uuid.uuid4().hex}/hits"
    for part in parts:
        sent = spark.sparkContext.broadcast(_phrases(part))
        hits = _scan_block(docs, sent, shard_bytes).where("size(spans) > 0").drop("n_words")
        hits.write.mode("append").parquet(path)
        sent.destroy()
    # One row for each distinct (id, text) and block; each gives the same spans for repeated rows.
    hits = spark.read.schema(hits.schema).parquet(path)
    merged = hits.groupBy("doc_id", "_key").agg(F.flatten(F.collect_set("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"))
    return merged.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), merged_spans(F.col("s")).alias("_spans"), F.col("i").alias("_items"))


def scan(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = 6 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """Each row of docs as (doc_id, n_words, spans, items): spans are ranges of word numbers."""
    parts = _parts(benchmark, block_bytes)
    broadcast = docs.sparkSession.sparkContext.broadcast
    if len(parts) == 1:
        return _scan_block(docs, broadcast(_phrases(parts[0])), shard_bytes).drop("_key")
    merged = _all_spans(docs, parts, shard_bytes)
    every = _scan_block(docs, broadcast(phrases([], [])), shard_bytes).select("doc_id", "_key", "n_words")
    out = every.join(merged, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    return out.select("doc_id", "n_words", F.coalesce("_spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The figures of scan: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return scan(docs, benchmark, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans; a space stands for each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : w.start[first]].tobytes())
        at = int(w.end[last - 1])
    out.append(raw[at:].tobytes())
    return b" ".join(x.strip(b" ") for x in out).decode().strip(" ")


def clean(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = 6 << 20, block_bytes: int = 8 << 20, mark: str | None = None) -> DataFrame:
    """docs with every word that is hit in the given text cut from it, at once; other columns unchanged.

    With mark, a boolean column of that name says whether the row's text was cut.
    """
    parts = _parts(benchmark, block_bytes)
    out = docs.withColumn(mark, F.lit(False)) if mark else docs
    schema, at = out.schema, out.columns.index("text")
    flag = out.columns.index(mark) if mark else None

    def cut(shard, spans):
        """The shard with spans, by row, cut."""
        if not spans:
            return shard
        values = shard.column(at).to_pylist()
        for d, ranges in spans.items():
            values[d] = cut_words(values[d], ranges)
        shard = shard.set_column(at, shard.schema.field(at), pa.array(values, shard.schema.field(at).type))
        return shard if flag is None else shard.set_column(flag, shard.schema.field(flag), pa.array([d in spans for d in range(len(values))], pa.bool_()))

    if len(parts) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(_phrases(parts[0]))

        def run(batches):
            for shard in _shards(batches, shard_bytes):
                _, _, found = search_shard(_one(shard.column(at)), sent.value)
                yield from cut(shard, {d: list(zip(*_runs(mask), strict=True)) for d, mask, _ in found}).to_batches()

        return out.mapInArrow(run, schema)
    merged = _all_spans(docs, parts, shard_bytes).drop("_items")
    joined = out.join(merged, out["doc_id"].eqNullSafe(F.col("_d")) & F.xxhash64(out["text"]).eqNullSafe(F.col("_k")), "left").select(*[out[c] for c in out.columns], "_spans")

    def run_joined(batches):
        for batch in batches:
            spans = {d: [(x["first"], x["last"]) for x in r] for d, r in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if r}
            yield from cut(pa.Table.from_batches([batch]).drop_columns(["_spans"]), spans).to_batches()

    return joined.mapInArrow(run_joined, schema)
