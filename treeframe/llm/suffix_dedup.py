"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier.

Every window of LENGTH bytes is dealt out by its minimizer, the least hash of its K-byte
strings: equal windows have equal minimizers, and consecutive windows that share one form a
piece, about one for each (LENGTH - K) / 2 bytes. Pieces are first counted by minimizer; those
whose minimizer occurs once, and once within the piece, hold no repeated window and end there.
Equal pieces are aggregated to their first occurrence (the others are covered whole). Only
where different pieces share a minimizer, or one repeats its own, are bytes looked at: whole
minimizer groups are joined to chunks of bounded size, and in each the suffixes are sorted, the
Burrows-Wheeler transform is taken, and common prefixes are derived breadth-first by backward
extension, by levels that double: neighbours that share l bytes share l + s (s at most l) if no
boundary of level l lies between the rows of their suffixes s bytes on. Levels run from 1 to
LENGTH and no further; what no boundary parts then is a repeated window. Its earliest start,
by (doc_id, position), stays; the others are covered.

A group whose different pieces hold more than GROUP_BYTES (a very common line in changing
surroundings) doesn't fit a chunk. Its pieces are cut again, where the minimizer of a smaller
region of the window changes, and the parts, most of which are equal, go through the same steps
as pieces; CUTS names the regions, each for groups that the one before left too large. What is
too large after the last has parts of a few windows each that agree at both ends; those windows
are aggregated one by one, by two independent 64-bit hashes, which has no hot key.

Defined results: null is an empty text; a null id counts as the least of all; of texts under
one doc_id, equal starts are not earlier than each other, so a repeated row gets the same
result as its double; texts of any length are used whole, in overlapping slices; an empty
table gives an empty result; only doc_id and text are read. Texts of one id are told apart by
64 bits of a hash. Pieces are taken as equal if a 64-bit hash of all their bytes and that of
their minimizer agree, so a false match needs a collision of 64 bits among the pieces of one
minimizer; windows of the last step if 128 bits agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_VALUE, OTHER_VALUE, PASS_BYTES, discard, mix, powers, release, shuffle_partitions, slices, stash, string_buffers

LENGTH = 100
K = 24
PIECE = 256
CHUNK_BYTES, GROUP_BYTES = 1 << 18, 1 << 18
#: (first byte, bytes, gram) of the regions of a window by which groups that don't fit are cut again.
CUTS = ((0, 24, 8), (LENGTH - 24, 24, 8), (0, 8, 4), (LENGTH - 8, 8, 4))
FIRST_ID = -(1 << 63)
#: A piece's place as one number: its start, then whether its minimizer repeats within it, then its windows less one.
_START, _OWN = 9, 8


class Hashed:
    """Polynomial hashes of any string of a byte slice; other: by another multiplier and table of byte values."""

    def __init__(self, raw: np.ndarray, other: bool = False):
        self.power, self.inverse = powers(len(raw) + 1, other)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((OTHER_VALUE if other else BYTE_VALUE)[raw] * self.power[: len(raw)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        x = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(x ^ np.uint64(salt)) if salt else mix(x)


def _window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n, step = len(h), 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[: n - width + 1], h[rest : rest + n - width + 1]) if rest else h[: n - width + 1]


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(minimizer, whether it repeats, text, first window, windows, bytes' hash) for a slice of texts.

    Window starts are relative to the slice; without whole only the first two are returned.
    """
    n = len(raw)
    if n < length:
        return tuple(np.empty(0, d) for d in (np.uint64, bool, np.int64, np.int64, np.int64, np.uint64))[: 6 if whole else 2]
    hashed = Hashed(raw)
    at = np.arange(n - k + 1)
    h = hashed.of(at, at + k)
    least = _window_minimum(h, length - k + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    good = at[: len(least)] + length <= offsets[1:][text]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])
    run = np.flatnonzero(new)
    since = at[: len(least)] - np.repeat(run, np.diff(np.append(run, len(least))))
    start = np.flatnonzero((since % PIECE == 0) & good)
    stop = np.minimum(np.append(start[1:], len(least)), start + PIECE)
    # A piece ends with its run, which may be before the next piece if windows between are not good.
    run_end = np.append(run[1:], len(least))
    stop = np.minimum(stop, run_end[np.searchsorted(run, start, "right") - 1])
    size = stop - start
    m = least[start]
    # Occurrences of the minimizer among the K-byte strings of the piece.
    span = size + length - k
    inner = np.repeat(start - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
    often = np.add.reduceat(h[inner] == np.repeat(m, span), np.concatenate([[0], np.cumsum(span)[:-1]])) > 1 if len(start) else np.empty(0, bool)
    if not whole:
        return m, often
    return m, often, text[start], start, size, hashed.of(start, stop + length - 1, 0x2545F4914F6CDD1D) + size.astype(np.uint64)


def _sliced(raw: np.ndarray, offsets: np.ndarray):
    """(first row, texts' bytes, offsets, shift): slices of whole texts, or overlapping slices of a long one."""
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b == a + 1 and hi - lo > 2 * PASS_BYTES:
            for s in range(lo, hi - LENGTH + 1, PASS_BYTES):
                e = min(hi, s + PASS_BYTES + LENGTH - 1)
                yield a, raw[s:e], np.array([0, e - s]), s - lo
        else:
            yield a, raw[lo:hi], offsets[a : b + 1] - lo, 0


_PLACE = "m long, h long, d long, k long, at long"


def _minimizers(docs: DataFrame) -> DataFrame:
    """The minimizer of each piece, and 2 if it repeats within, else 1."""

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffers(batch.column(0))
            out = [pieces(part, off, whole=False) for _, part, off, _ in _sliced(raw, offsets)]
            if out:
                m, own = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(own + np.int64(1))], ["m", "n"])

    return docs.select("text").mapInArrow(run, "m long, n long")


def _places(docs: DataFrame) -> DataFrame:
    """A row for each piece: m, h, d (the id), k (the text's hash) and at (its place)."""

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            out = []
            for a, part, off, shift in _sliced(raw, offsets):
                m, own, text, start, size, whole = pieces(part, off)
                at = ((start - off[text] + shift) << _START) | (own.astype(np.int64) << _OWN) | (size - 1)
                out.append((m.view(np.int64), whole.view(np.int64), ids[a + text], keys[a + text], at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["m", "h", "d", "k", "at"])

    return docs.select("d", "text", "k").mapInArrow(run, _PLACE)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes, by their first ``depth`` symbols or more, where each 0 ends a string and differs from every other 0.

    Seven symbols are packed for the first sort; prefixes are then doubled up to depth, and only
    suffixes still tied are sorted again. Deeper order would not matter: levels below depth see
    no boundary between suffixes tied to it, whichever way they stand.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the next 0
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(left > j, padded[j : j + n], np.uint64(0))
    order = np.argsort(key)
    key = key[order]
    start = np.ones(n, bool)
    start[1:] = (key[1:] != key[:-1]) | (left[order[1:]] < 7)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    k = 7
    while True:
        at = np.flatnonzero(~(start & np.append(start[1:], True)))
        if not len(at) or k >= depth:
            return order
        pos = order[at]
        key = rank[pos] * np.int64(n + 1) + rank[np.minimum(pos + k, n - 1)]
        o = np.argsort(key)
        order[at], key = pos[o], key[o]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        start[at] = first
        rank[order[at]] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        k *= 2


def repeated_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each row): rows of a class share a prefix of at least length symbols.

    Level l has a boundary between neighbours that share less than l symbols. Neighbours that
    share l, and whose suffixes s symbols on (s at most l) share l, share l + s; those suffixes'
    rows are s backward steps of the transform away, so the levels 1, 2, 4, ... and length do.
    """
    sa = suffix_order(text, length)
    step_rows = [np.argsort(text[sa - 1], kind="stable").astype(np.int32)]  # row j's suffix without its first symbol is row [j]
    first = text[sa]
    bound = np.ones(len(text), bool)
    bound[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    have = 1
    while have < length:
        step = min(have, length - have)
        while 1 << len(step_rows) <= step:
            step_rows.append(step_rows[-1][step_rows[-1]])
        level = np.cumsum(bound, dtype=np.int32)
        j = np.flatnonzero(~bound)
        here, above = j, j - 1
        for k, rows in enumerate(step_rows):
            if step >> k & 1:
                here, above = rows[here], rows[above]
        bound[j[level[here] != level[above]]] = True
        have += step
    return sa, np.cumsum(bound)


def covered_windows(strings: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that also starts earlier, by (id, position), in these strings."""
    size = np.array([len(s) for s in strings])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.zeros(int((size + 1).sum()), np.int16)
    body = np.ones(len(text), bool)
    body[begin + size] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    sa, label = repeated_classes(text, length)
    count = np.bincount(label)
    rows = np.flatnonzero(count[label] > 1)
    pos, label = sa[rows], label[rows]
    owner = np.searchsorted(begin, pos, "right") - 1
    offset = pos - begin[owner]
    d, p = ids[owner], starts[owner] + offset
    order = np.lexsort((p, d, label))
    label, d, p, owner, offset = label[order], d[order], p[order], owner[order], offset[order]
    head = np.ones(len(label), bool)
    head[1:] = label[1:] != label[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(label)), 0))
    later = (d != d[first]) | (p != p[first])
    return owner[later], offset[later]


def _ranges(owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive offsets of one owner as (owner, first, count)."""
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(new)
    return owner[at], offset[at], np.diff(np.append(at, len(owner)))


_COVER = "d long, k long, first long, n long"


def _cover(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(p, np.int64)) for p in parts], ["d", "k", "first", "n"])


def _by_expansion(rows: DataFrame) -> DataFrame:
    """Covered windows of pieces (m, d, k, at, bytes), whole minimizer groups at a time."""

    def settle(table):
        start, key, ids = table["at"].to_numpy() >> _START, table["k"].to_numpy(), table["d"].to_numpy()
        owner, offset = covered_windows(table["bytes"].to_pylist(), ids, start)
        owner, first, n = _ranges(owner, offset)
        return _cover((ids[owner], key[owner], start[owner] + first, n))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += table.nbytes
            if size >= CHUNK_BYTES:
                table = pa.concat_tables(held)
                m = table["m"].to_numpy()
                cut = int(np.searchsorted(-(m[::-1] == m[-1]).astype(int), 0))  # rows of the last group, which may go on
                last = len(m) - cut
                if last:
                    yield settle(table.slice(0, last))
                held = [table.slice(last)]
                size = held[0].nbytes
        if held:
            yield settle(pa.concat_tables(held))

    rows = rows.select("m", "d", "k", "at", "bytes")
    return rows.repartition(shuffle_partitions(rows.sparkSession), "m").sortWithinPartitions("m").mapInArrow(run, _COVER)


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted pieces with their bytes: (m, d, k, at, bytes)."""
    lists = wanted.groupBy("d", "k").agg(F.collect_list("at").alias("at"), F.collect_list("m").alias("m"))  # at most a text's pieces
    return docs.select("d", "k", "text").join(lists.hint("shuffle_hash"), ["d", "k"]).select("d", "k", "text", "at", "m").mapInArrow(_with_bytes, "m long, d long, k long, at long, bytes binary")


def _flat(batch):
    """(ids, keys, raw, offsets, row of each piece, place, minimizer) of a batch of _fetched."""
    raw, offsets = string_buffers(batch.column(2))
    at, m = batch.column(3), batch.column(4)
    row = np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy()))
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), raw, offsets, row, at.flatten().to_numpy(), m.flatten().to_numpy()


def _with_bytes(batches):
    for batch in batches:
        d, k, raw, offsets, row, at, m = _flat(batch)
        step = 20_000
        for a in range(0, len(row), step):
            r, p = row[a : a + step], at[a : a + step]
            lo = offsets[r] + (p >> _START)
            size = (p & 0xFF) + LENGTH
            begin = np.concatenate([[0], np.cumsum(size)])
            taken = raw[np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])]
            out = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(taken.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(m[a : a + step]), pa.array(d[r]), pa.array(k[r]), pa.array(p), out], ["m", "d", "k", "at", "bytes"])


def _windows_of(batches, step: int = 2048):
    """Some pieces at a time (m, d, k, at, bytes): the batch, each window's piece, its start in the text, its start in the bytes, the pieces' bytes."""
    for batch in batches:
        for a in range(0, len(batch), step):
            part = batch.slice(a, step)
            n = (part.column(3).to_numpy() & 0xFF) + 1
            begin = part.column(3).to_numpy() >> _START
            size = n + LENGTH - 1
            body = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield part, np.repeat(np.arange(len(part)), n), np.repeat(begin, n) + offset, np.repeat(np.cumsum(size) - size, n) + offset, body


def _with_windows(batches):
    for part, piece, w, here, body in _windows_of(batches):
        h, g = (Hashed(body, other).of(here, here + LENGTH) for other in (False, True))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column(1).take(pa.array(piece)), part.column(2).take(pa.array(piece)), pa.array(w)], ["h", "g", "d", "k", "first"])


def _with_parts(cut: tuple[int, int, int]):
    """Pieces with bytes cut where the minimizer of a region of the window changes: as of _places, with bytes."""
    begin, width, gram = cut

    def run(batches):
        for part, piece, w, here, body in _windows_of(batches):
            hashed = Hashed(body)
            i = np.arange(len(body) - gram + 1)
            least = _window_minimum(hashed.of(i, i + gram, 0x3C6EF372FE94F82B), width - gram + 1)[here + begin]
            new = np.ones(len(w), bool)
            new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(w)))
            p, here = pa.array(piece[first]), here[first]
            m, d, k, at = (part.column(c).take(p) for c in range(4))
            key = mix(m.to_numpy().view(np.uint64) ^ (least[first] * np.uint64(0x9E3779B97F4A7C15)))
            whole = hashed.of(here, here + count + LENGTH - 1, 0x2545F4914F6CDD1D) + count.astype(np.uint64)
            place = (w[first] << _START) | (at.to_numpy() & (1 << _OWN)) | (count - 1)
            size = count + LENGTH - 1
            taken = body[np.repeat(here - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            bytes_ = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(taken.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), d, k, pa.array(place), bytes_], ["m", "h", "d", "k", "at", "bytes"])

    return run


def _repeated(docs: DataFrame) -> DataFrame:
    """The pieces whose minimizer occurs more than once."""
    often = stash(_minimizers(docs).groupBy("m").agg(F.sum("n").alias("_n")).where("_n > 1").select("m"), "often")
    release(docs)
    out = stash(_places(docs).join(often.hint("shuffle_hash"), "m"), "pieces")
    discard(often)
    return out


def _grouped(kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of stashed pieces (m, h, d, k, at, ...), which go: covered windows of equal ones, first occurrences that share a minimizer or repeat it, and the groups that don't fit."""
    others = [c for c in kept.columns if c not in ("m", "h", "d", "at")]
    first = kept.groupBy("m", "h").agg(F.min(F.struct("d", "at", *others)).alias("f"), F.count("*").alias("c"))
    first = stash(first.select("m", "h", "f.*", "c"), "first")
    release(kept)
    again = first.where("c > 1").select("m", "h", F.col("d").alias("fd"), F.col("at").alias("fat"))
    place = F.shiftright("at", _START)
    copies = kept.join(again, ["m", "h"]).where((F.col("d") != F.col("fd")) | (place != F.shiftright("fat", _START)))
    copies = stash(copies.select("d", "k", place.alias("first"), (F.col("at").bitwiseAND(F.lit(0xFF)) + 1).alias("n")), "copies")
    release(kept)
    discard(kept)

    own = F.shiftright("at", _OWN).bitwiseAND(F.lit(1))
    size = F.col("at").bitwiseAND(F.lit(0xFF)) + LENGTH
    groups = first.groupBy("m").agg(F.count("*").alias("_n"), F.max(own).alias("_own"), F.sum(size).alias("_bytes")).where("_n > 1 or _own > 0")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits a hot minimizer's.
    groups = stash(groups.select("m", "_bytes"), "groups")
    wanted = first.select("m", "d", "at", *others).join(groups.hint("shuffle_hash"), "m")
    return copies, wanted, groups.where(F.col("_bytes") > GROUP_BYTES)


def covered(docs: DataFrame) -> DataFrame:
    """Ranges of covered windows, (d, k, first, n), of docs (d, k, text)."""
    fits = F.col("_bytes") <= GROUP_BYTES
    kept = _repeated(docs)
    release(docs)
    out, wanted, large = _grouped(kept)
    out = out.unionByName(stash(_by_expansion(_fetched(docs, wanted.where(fits))), "covered"))
    release(docs)
    for level, cut in enumerate(CUTS):
        if large.isEmpty():
            return out
        rows = stash(_fetched(docs, wanted.where(~fits)) if not level else wanted.where(~fits).select("m", "d", "k", "at", "bytes"), "large")
        copies, wanted, large = _grouped(stash(rows.mapInArrow(_with_parts(cut), _PLACE + ", bytes binary"), "parts"))
        out = out.unionByName(copies).unionByName(stash(_by_expansion(wanted.where(fits)), "covered"))
        release(docs)
    if large.isEmpty():
        return out
    windows = stash(wanted.where(~fits).select("m", "d", "k", "at", "bytes").mapInArrow(_with_windows, "h long, g long, d long, k long, first long"), "windows")
    earliest = stash(windows.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("d", "first")).alias("f")).where("c > 1"), "earliest")
    later = windows.join(earliest, ["h", "g"]).where("d <> f.d or first <> f.first")
    return out.unionByName(later.select("d", "k", "first", F.lit(1).cast("long").alias("n")))


def _settled(raw: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """(mask of removed bytes, maximal removed runs) of one text."""
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + n - 1 + LENGTH, len(raw)), -1)
    gone = np.cumsum(step[:-1]) > 0
    return gone, int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Each row of docs as (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes if asked for."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID).cast("long")).alias("d"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k"))
    lists = covered(docs).groupBy("d", "k").agg(F.collect_list(F.struct("first", "n")).alias("c"))
    joined = docs.join(lists.hint("shuffle_hash"), ["d", "k"], "left").select("doc_id", "text", F.col("c.first").alias("first"), F.col("c.n").alias("n"))
    fields = [T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] * with_text

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            first, n = batch.column(2), batch.column(3)
            has = first.is_valid().to_numpy(zero_copy_only=False)
            cols = [[], [], [], [], []]
            for r in range(len(batch)):
                part, spans = raw[offsets[r] : offsets[r + 1]], 0
                size = len(part)
                if has[r]:
                    gone, spans = _settled(part, first[r].values.to_numpy(), n[r].values.to_numpy())
                    part = part[~gone]
                data = part.tobytes()
                for c, x in zip(cols, (size, size - len(part), spans, hashlib.sha256(data).hexdigest(), data), strict=True):
                    c.append(x)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in list(zip(cols, types, strict=True))[: len(fields) - 1])], [f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))
