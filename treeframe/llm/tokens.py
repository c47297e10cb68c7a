"""Token-ID output: whole texts encoded, written as Parquet list columns, read selectively.

A file set holds one row for each document, in ascending order of doc_id over its shards:
doc_id, shard, local_start (ids of the shard before it), n_tokens and ids (a list of 32-bit
integers). Ids are dictionary encoded where that is shorter and delta encoded otherwise
(format version 2); row groups and pages have set sizes, and column and offset indexes let a
reader skip pages, so metadata can be read without ids and a range of documents without the
others. Texts are dealt out by doc_id range before they are encoded, so each is encoded once.

The tokenizer's file is a parameter. If it lower-cases, drops white space and parts letters from
stops, as the default does (``by_words`` reads that from the file), a text is encoded by its
white-space separated words, since nothing reaches across them; words are looked up in a table
of at most ``most`` of those already encoded. Texts with the few control characters on which
Python and the tokenizer disagree about white space are encoded as they are, and so is every
text for any other tokenizer.

Defined results: null is an empty text, which has only the end id; null ids come first;
repeated rows each have a row, in the order of a hash of their text; texts of any length are
encoded whole; an empty table gives an empty file set; only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_folder, shuffle_partitions, slices, string_buffers

ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 64 << 10
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# Text that Python and the tokenizer lower-case alike, one character for one, and that is composed.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u024f]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Table(dict):
    """Numbers words as they come; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


def _plain_letters() -> str:
    """Letters below U+0250 whose lower case is one letter there; composition changes none of them."""
    low = [c.lower() for c in map(chr, range(0x250))]
    letter = [unicodedata.category(chr(c))[0] == "L" for c in range(0x250)]
    return "".join(chr(c) for c in range(0x250) if letter[c] and len(low[c]) == 1 and ord(low[c]) < 0x250 and letter[ord(low[c])])


# A word of plain letters, and stops after it: the tokenizer parts them there, and the letters, in
# lower case, are one unit, of which the byte-pair model alone makes ids.
_STOPS = ".,!?;:"
_STOPPED = re.compile(f"(?m)^(?:([{_plain_letters()}]+)([{_STOPS}]*)|.*)$")  # of lines that each hold a word
# What a tokenizer's file must hold for its texts to be encoded by words.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_words(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) lower-cases, drops white space and parts letters from stops, so that words can be encoded apart."""
    held = json.loads(tokenizer)
    added = [t for t in held.get("added_tokens", []) if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not re.fullmatch("<\\|\\S*", t["content"])]
    return held["model"]["type"] == "BPE" and not added and all(held.get(k) == v for k, v in _BY_WORDS.items())


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level model: visible ones for themselves, the others from U+0100 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Encoder:
    """Ids of texts by a table of words; if it gets long, words met once since then are forgotten."""

    def __init__(self, path: str, most: int = 350_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = by_words(self.tokenizer.to_str())
        self.table = _Table()
        self.table[""]  # number 0, without ids
        self.table.new = []
        self.ids, self.end = np.empty(1 << 16, np.int32), 0
        self.first, self.size, self.seen = (np.zeros(1 << 12, kind) for kind in (np.int64, np.int32, np.int32))

    def _append(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.end : self.end + len(ids)] = ids
        while len(self.table) > len(self.first):
            self.first, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.seen))
        self.first[numbers] = self.end + np.cumsum(size) - size
        self.size[numbers] = size
        self.end += len(ids)

    def _learn_units(self, words: list[str], numbers: list[int]) -> None:
        tokenize = self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS))] for w in words]
        self._append(np.array(numbers, np.int64), np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int32, len(lists)))

    def _learn_whole(self, words: list[str], numbers: list[int]) -> None:
        """Encoded as one text, where an id belongs to the word in which its characters start."""
        for a in range(0, len(words), 2048):
            part = words[a : a + 2048]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            start = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            owner = np.searchsorted(start, np.array([o[0] for o in e.offsets], np.int64), "right") - 1
            self._append(np.array(numbers[a : a + 2048]), np.array(e.ids, np.int32), np.bincount(owner, minlength=len(part)))

    def _learn(self) -> None:
        """Plain letters go to the model; with capitals or stops they get the ids of both parts; other words are encoded."""
        table, new = self.table, self.table.new
        table.new = []
        base = len(table) - len(new)  # new words are numbered as they came
        lines = "\n".join(new)
        kinds = _STOPPED.findall(lines) if lines.count("\n") == len(new) - 1 else [("", "") if "\n" in w else _STOPPED.findall(w)[0] for w in new]
        units, whole, parts = ([], []), ([], []), []
        for k, (letters, stops) in enumerate(kinds, base):
            if not letters:
                whole[0].append(new[k - base])
                whole[1].append(k)
                continue
            low = letters.lower()
            if stops or low != letters:
                parts.append((k, table[low], table[stops] if stops else 0))
            else:
                units[0].append(low)
                units[1].append(k)
        for k, word in enumerate(table.new, len(table) - len(table.new)):
            to = whole if word[0] in _STOPS else units
            to[0].append(word)
            to[1].append(k)
        table.new = []
        self._learn_units(*units)
        self._learn_whole(*whole)
        if parts:
            p = np.array(parts)
            pair = p[:, 1:].ravel()
            self._append(p[:, 0], self._gather(pair)[0], self.size[p[:, 1]] + self.size[p[:, 2]])

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[which]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.first[which] - total[:-1], size) + np.arange(total[-1])], total

    def _forget(self) -> None:
        """Keep the words met twice or more, halving their counts."""
        n = len(self.table)
        kept = [(w, k) for (w, k), seen in zip(self.table.items(), self.seen[:n].tolist(), strict=True) if seen > 1 and k]
        if len(kept) > self.most // 2:
            kept = []
        old = np.array([0, *(k for _, k in kept)], np.int64)
        ids, _ = self._gather(old)
        size, seen = self.size[old], self.seen[old] // 2
        self.table, self.end = _Table(), 0
        self.table.update(zip(["", *(w for w, _ in kept)], range(len(old)), strict=True))
        self.seen[:n] = 0
        self._append(np.arange(len(old)), ids, size)
        self.seen[: len(old)] = seen

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start (one more entry at the end)."""
        if len(self.table) > self.most:
            self._forget()
        if not self.by_words:
            lists = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.int32), np.cumsum([0, *map(len, lists)])
        split = [[t] if _ODD_SPACE.search(t) else t.lower().split() if "<|" not in t and (t.isascii() or _PLAIN.fullmatch(t)) else t.split() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        which = np.fromiter(map(self.table.__getitem__, chain.from_iterable(split)), np.int64, int(bounds[-1]))
        if self.table.new:
            self._learn()
        count = np.bincount(which)
        self.seen[: len(count)] += count
        ids, total = self._gather(which)
        return ids, total[bounds]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process, which keeps its table from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_STOP, _SPACE, _LETTER = _byte_set(_STOPS.encode()), _byte_set(b" \t\n\r"), _byte_set(bytes([*range(65, 91), *range(97, 123)]))


def stops_apart(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each stop that stands between an ASCII letter and white space or the end.

    The tokenizer parts them there and drops white space, so ids stay the same, and a word needs
    no entry of its own for each stop after it.
    """
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    after = edge[1:].copy()
    after[:-1] |= _SPACE[raw[1:]]
    before = np.zeros(len(raw), bool)
    before[1:] = _LETTER[raw[:-1]]
    at = np.flatnonzero(_STOP[raw] & before & ~edge[:-1] & after)
    return np.insert(raw, at, 32), offsets + np.searchsorted(at, offsets)


def encoded(column: pa.Array, encoder: Encoder):
    """(first row, last row, ids, bounds) for slices of a string column."""
    raw, offsets = string_buffers(column)
    for a, b in slices(offsets, 1 << 20):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if encoder.by_words:
            part, at = stops_apart(part, at)
        part = part.tobytes()
        yield a, b, *encoder.encode([part[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Encode docs and write the file set at path."""
    tokenizer = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shard, done, encoder = to_arrow_schema(schema), TaskContext.get().partitionId(), 0, encoder_of(tokenizer)
        for batch in batches:
            for a, b, ids, bounds in encoded(batch.column(1), encoder):
                ends = np.insert(ids, bounds[1:], end_id)
                at = bounds + np.arange(b - a + 1)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends, pa.int32())).cast(arrow.field("ids").type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, shard), pa.int32()), pa.array(done + at[:-1]), pa.array(np.diff(at)), lists], schema=arrow)
                done += int(at[-1])

    order = [F.asc_nulls_first("doc_id"), F.asc("_key")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    dealt = dealt.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.dictionary.page.size": 4 * PAGE_BYTES, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}
    dealt.select("doc_id", "text").mapInArrow(run, schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without reading ids."""
    return _with_start(spark.read.parquet(path).select("doc_id", "shard", "local_start", "n_tokens"))


def _with_start(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(shards, "shard").withColumn("start", F.col("_before") + F.col("local_start")).drop("shard", "_before", "local_start")


def read_tokens(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """doc_id and ids of the documents from first to last; their pages alone are read."""
    rows = spark.read.parquet(path).select("doc_id", "ids")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the files."""
    rows = spark.read.parquet(path)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], schema.names)

    counted = rows.select("doc_id", "shard", "local_start", "ids").mapInArrow(run, schema)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return counted.join(shards, "shard").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write a file set in the shared folder and give its figures as read back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/treeframe-{uuid.uuid4().hex}/tokens"
    write_tokens(docs, path, tokenizer)
    return checked(spark, path)
