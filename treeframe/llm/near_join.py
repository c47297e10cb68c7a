"""N-gram Jaccard join: a MinHash LSH forest proposes groups, exact set sizes decide links.

Every text becomes the set of hashes of its five-word shingles (of all its words, if it has
fewer than five). Equal sets, by 128 bits of their content, are one representative with a number
of its own and are never expanded into pairs. Each of TREES trees labels the representatives by
a path of DEPTH MinHash symbols of a byte, kept as one number whose leading bytes are its
prefixes: sorted, they are the tree's prefix trie.

Matched prefixes start whole and are shortened. At full depth nearly all that share a node are
alike: in each node members are compared with the first, with the first of those left, and so on,
and what agrees becomes one group, so that a crowd of near copies is one group from here on. The
prefix is then shortened to ``stop_depth``, the longest at which the share of pairs at the
threshold that some tree brings together reaches ``recall``; only nodes that hold more than one
group are opened, and there members of different groups are compared, all with all. Comparing is
by signature (all TREES * DEPTH symbols): pairs more than 4.5 standard errors below the threshold
are cut. A node's largest group is dealt once and the others to all its blocks, so a task holds a
bounded part of a node and rows are not dealt with the square of a crowd.

What is joined so is verified exactly. A group that fits a task has all its pairs counted there.
A larger one is dealt by blocks once, each block with the group's leading text (the one with most
copies); a text is then told by the shingles in which it differs from that, which gives the same
intersections: |x & y| is half of |x| + |y| less the symmetric difference, and that of two texts
is that of their differences from a third. Only these differences, not texts, meet in block pairs.

The result has one row for each row of docs: doc_id, class_id (the least doc_id of the
connected component of links) and n_links (other documents with a Jaccard similarity of at
least ``similarity``, copies counted).

Defined results: a text without words (null, empty) links to nothing and is its own class;
rows without an id have a null class and no links of their own; rows with equal ids and equal
texts count as copies of each other, and rows with equal ids and different texts stand for
themselves; texts of any length are used whole; empty tables give empty results; only doc_id
and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, components, discard, mix, shuffle_partitions, slices, stash, string_buffers

SHINGLE = 5
TREES, DEPTH = 24, 8
WIDTH = TREES * DEPTH
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 19
PAIR_ROWS, PAIR_BYTES = 1024, 1 << 24


def stop_depth(similarity: float, recall: float, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest matched prefix at which enough pairs at the threshold meet in some tree."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees don't bring {recall:.4%} of the pairs at a similarity of {similarity} together")


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice of texts, sorted within each, and the bounds of each text's."""
    w = Words(raw, offsets)
    h, row = w.hashes(), w.text_of()
    odd = np.uint64(2) * mix(np.arange(1, n + 1, dtype=np.uint64)) + np.uint64(1)
    count = np.diff(w.bounds)
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    if len(h) >= n:
        s = sum((h[k : len(h) - n + 1 + k] * odd[k] for k in range(1, n)), h[: len(h) - n + 1] * odd[0])
        whole = row[: len(h) - n + 1] == row[n - 1 :]
        rows.append(row[: len(h) - n + 1][whole])
        found.append(mix(s[whole]))
    for r in np.flatnonzero((count > 0) & (count < n)):
        part = h[w.bounds[r] : w.bounds[r + 1]]
        rows.append(np.array([r]))
        found.append(mix((part * odd[: len(part)]).sum(keepdims=True) + np.uint64(len(part))))
    row, s = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    row, s = row[new], s[new]
    return s, np.searchsorted(row, np.arange(len(offsets)))


def set_keys(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; equal sets have equal keys."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(salt)))])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash symbols, uint8 [texts, WIDTH]; texts without shingles have the largest throughout."""
    out = np.full((len(bounds) - 1, WIDTH), 0xFF, np.uint8)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        rng = np.random.default_rng(71)
        a = rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        high = s ^ (s >> np.uint64(31))
        for j in range(WIDTH):
            out[some, j] = np.minimum.reduceat((high * a[j]) >> np.uint64(32), bounds[some]) & np.uint64(0xFF)
    return out


def _symbols(paths: pa.Array) -> np.ndarray:
    """The symbols of a column of paths, uint8 [rows, WIDTH]."""
    return paths.flatten().to_numpy().astype(">i8").view(np.uint8).reshape(-1, WIDTH)


def _signed(docs: DataFrame) -> DataFrame:
    """Each row's set keys, set size and path in each tree."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("n", T.IntegerType()), T.StructField("paths", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                s, bounds = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                k1, k2 = set_keys(s, bounds)
                paths = signatures(s, bounds).view(">i8").astype(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(paths) + 1, TREES), pa.int32()), pa.array(paths))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds), pa.int32()), lists.cast(arrow.field("paths").type)], schema=arrow)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, schema)


def _together(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), *group).sortWithinPartitions(*group)


def _groups(batches, keys: tuple[str, ...]):
    """Consecutive rows with equal keys as one table; the input is sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows - 1, bool)
        for k in keys:
            v = table[k].to_numpy()
            same &= v[1:] == v[:-1]
        cut = np.flatnonzero(~same) + 1
        done = 0
        if len(cut):
            yield table.slice(0, cut[-1]).combine_chunks(), np.concatenate([[0], cut])
            done = int(cut[-1])
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def spanning(adjacent: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least index of each row's component."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _least(similarity: float) -> float:
    """The fewest equal symbols of a pair at the threshold, 4.5 standard errors below what is expected."""
    return similarity * WIDTH - 4.5 * math.sqrt(similarity * (1 - similarity) * WIDTH)


def _alike(sig: np.ndarray, n: np.ndarray, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
    near = (sig[others] == sig[one]).sum(1) >= _least(similarity)
    return near & (np.minimum(n[others], n[one]) >= similarity * np.maximum(n[others], n[one]))


def _edges(pairs: list[np.ndarray], seen: set[tuple[int, int]]):
    """New pairs as a batch of edges (a, b), if there are any; seen ones are forgotten now and then."""
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    new = [p for p in map(tuple, found[found[:, 0] != found[:, 1]].tolist()) if p not in seen]
    if len(seen) > 200_000:
        seen.clear()
    seen.update(new)
    if new:
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["a", "b"])


def _close_pairs(sig: np.ndarray, n: np.ndarray, group: np.ndarray, small: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All likely pairs within small groups (at most 12 rows each), a step at a time for all groups at once."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, 12):
        i = np.flatnonzero((group[step:] == group[:-step]) & small[step:]) if len(group) > step else np.empty(0, int)
        if not len(i):
            break
        near = ((sig[i] == sig[i + step]).sum(1) >= _least(similarity)) & (np.minimum(n[i], n[i + step]) >= similarity * np.maximum(n[i], n[i + step]))
        left.append(i[near])
        right.append(i[near] + step)
    return np.concatenate(left), np.concatenate(right)


def _gathered(rows: DataFrame, similarity: float, leaders: int = 16) -> DataFrame:
    """Edges (a, b) that make one group of the members of a block that are like its first, like the first of those left, and so on."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for table, bounds in _groups(batches, ("tree", "prefix", "block")):
            sid, n, sig = table["sid"].to_numpy(), table["n"].to_numpy().astype(float), _symbols(table["paths"].combine_chunks())
            size = np.diff(bounds)
            left, right = _close_pairs(sig, n, np.repeat(np.arange(len(size)), size), np.repeat(size <= 12, size), similarity)
            pairs = [np.stack([sid[left], sid[right]], 1)]
            for g in np.flatnonzero(size > 12):
                rest = np.arange(bounds[g], bounds[g + 1])
                for _ in range(leaders):
                    if len(rest) < 2:
                        break
                    near = _alike(sig, n, rest[0], rest, similarity)
                    near[0] = True
                    one = sid[rest[near]]
                    pairs.append(np.stack([one[:-1], one[1:]], 1))  # a chain, so that no node gets all edges
                    rest = rest[~near]
            yield from _edges(pairs, seen)

    return rows.select("tree", "prefix", "block", "sid", "n", "paths").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between groups of which two members in a cell are alike."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for table, bounds in _groups(batches, ("tree", "prefix", "_a", "_b")):
            root, own, n, sig = table["root"].to_numpy(), table["_own"].to_numpy(), table["n"].to_numpy().astype(float), _symbols(table["paths"].combine_chunks())
            a, b = table["_a"].to_numpy(), table["_b"].to_numpy()
            size = np.diff(bounds)
            left, right = _close_pairs(sig, n, np.repeat(np.arange(len(size)), size), np.repeat(size <= 12, size), similarity)
            pairs = [np.stack([root[left], root[right]], 1)]
            for g in np.flatnonzero(size > 12):
                rows = np.arange(bounds[g], bounds[g + 1])
                one, other = (rows, rows) if a[rows[0]] == b[rows[0]] else (rows[own[rows] == a[rows[0]]], rows[own[rows] == b[rows[0]]])
                for x in one:
                    y = other[root[other] != root[x]]
                    y = y[_alike(sig, n, x, y, similarity)]
                    to = np.unique(root[y])
                    pairs.append(np.stack([np.full(len(to), root[x]), to], 1))
            pairs = [np.sort(p, axis=1) for p in pairs]
            yield from _edges(pairs, seen)

    return rows.select("tree", "prefix", "_a", "_b", "_own", "root", "n", "paths").mapInArrow(run, "a long, b long")


def _nodes(reps: DataFrame, depth: int, *more) -> DataFrame:
    """(tree, prefix, *more, sid) of the representatives' prefixes of a depth."""
    return reps.select("sid", *more, F.posexplode("paths").alias("tree", "path")).select("tree", F.shiftrightunsigned("path", 64 - 8 * depth).alias("prefix"), "sid", *more)


def _blocks(rows: str, most: int) -> Column:
    return F.expr(f"({rows} + {most - 1}) div {most}")


def candidates(reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(sid, root) of all representatives (sid, n, paths): those whose links must be verified have one root."""
    node, signature = ["tree", "prefix"], reps.select("sid", "n", "paths")
    rows = _nodes(reps, DEPTH)
    shared = rows.join(rows.groupBy(*node).agg(F.count("*").alias("m")).where("m > 1"), node)
    shared = shared.withColumn("block", F.pmod(F.xxhash64("sid", "tree"), _blocks("m", 4 * BLOCK_ROWS))).join(signature, "sid")
    gathered = components(_gathered(_together(shared, [*node, "block"]), similarity))
    grouped = reps.join(gathered.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", "paths", F.coalesce("root", "sid").alias("root"))
    grouped = stash(grouped, "grouped")

    rows = _nodes(grouped, stop_depth(similarity, recall), "root")
    open_ = rows.groupBy(*node).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*node)
    rows = stash(rows.join(open_, node), "open")
    most = rows.groupBy(*node, "root").agg(F.count("*").alias("c")).groupBy(*node).agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"))
    most = most.withColumn("large", F.expr(f"CASE WHEN m > {BLOCK_ROWS} THEN top.c ELSE 0 END"))
    most = stash(most.select(*node, F.col("top.root").alias("main"), _blocks("large", BLOCK_ROWS).alias("mains"), _blocks("m - large", BLOCK_ROWS).alias("others")), "largest")
    # Blocks 0 to others - 1 are of other groups, those after of the node's largest group.
    is_main = F.expr("root = main AND mains > 0")
    own = F.when(is_main, F.col("others") + F.pmod(F.xxhash64("sid"), F.greatest(F.col("mains"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("sid"), F.col("others")))
    cells = rows.join(most, node).withColumn("_own", own).join(signature, "sid")
    meets = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    cells = cells.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    cells = cells.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))
    joined = components(_across(_together(cells.select(*node, "_a", "_b", "_own", "root", "n", "paths"), [*node, "_a", "_b"]), similarity))
    discard(rows, most)
    return grouped.select("sid", "root").join(joined.select(F.col("node").alias("root"), F.col("root").alias("_joined")), "root", "left").select("sid", F.coalesce("_joined", "root").alias("root"))


def linked(sets: list[np.ndarray], n: np.ndarray, side: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean links among sets, told by their differences from any one set; if side has two values, only across it."""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    size = np.array([len(x) for x in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True) if m else (np.empty(0), np.empty(0, int))
    row = np.repeat(np.arange(m), size)
    often = np.bincount(column, minlength=len(value))[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [first, first + step])
        part = np.zeros((m, step), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        both += part @ part.T
    rest = (n - size).astype(np.float32)
    both += (rest[:, None] + rest[None, :]) / 2
    link = both * (1 + similarity) >= similarity * (n[:, None] + n[None, :]) - 1e-3
    np.fill_diagonal(link, False)
    if m and side.min() != side.max():
        link &= side[:, None] != side[None, :]
    return link


def _links_of(sid: np.ndarray, copies: np.ndarray, link: np.ndarray) -> list[pa.Array]:
    """sid, linked documents, and a representative that each is joined with."""
    on = np.flatnonzero(link.any(1))
    label = spanning(link)
    chain = np.lexsort((np.arange(len(sid)), label))  # each joined with the one before in its group
    to = np.arange(len(sid))
    same = label[chain[1:]] == label[chain[:-1]]
    to[chain[1:][same]] = chain[:-1][same]
    return [pa.array(sid[on]), pa.array((link * copies[None, :]).sum(1)[on].astype(np.int64)), pa.array(sid[to[on]])]


_DIFFERENCES = "root long, sid long, copies long, n long, links long, to long, differs binary"


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    """Links of groups that fit one block; for larger ones each text's differences from the group's leader."""

    def run(batches):
        for table, bounds in _groups(batches, ("root", "block")):
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(int(lo), int(hi - lo))
                raw, offsets = string_buffers(part["text"].combine_chunks())
                s, at = shingle_sets(raw, offsets)
                k1, k2 = set_keys(s, at)
                sid, leads = part["sid"].to_numpy(), part["leader"].to_numpy()
                right = np.flatnonzero((k1 == part["k1"].to_numpy()) & (k2 == part["k2"].to_numpy()))
                right = right[np.unique(sid[right], return_index=True)[1]]  # repeated rows once
                sets = [s[at[r] : at[r + 1]] for r in right]
                sid, leads, copies, n = sid[right], leads[right], part["copies"].to_numpy()[right], part["n"].to_numpy()[right].astype(np.int64)
                root = part["root"][0].as_py()
                if part["blocks"][0].as_py() == 1:
                    a, links, to = _links_of(sid, copies, linked(sets, n, np.zeros(len(sid)), similarity))
                    none = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), root)), a, *none, links, to, pa.nulls(len(a), pa.binary())], [f.split()[0] for f in _DIFFERENCES.split(", ")])
                    continue
                base = sets[int(np.flatnonzero(sid == leads[0])[0])]
                mine = np.flatnonzero((sid != leads[0]) | (part["block"][0].as_py() == 0))  # the leader is in every block
                differs = [np.setxor1d(sets[i], base, assume_unique=True).astype("<u8").tobytes() for i in mine]
                none = [pa.nulls(len(mine), pa.int64()), pa.nulls(len(mine), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), root)), pa.array(sid[mine]), pa.array(copies[mine]), pa.array(n[mine]), *none, pa.array(differs, pa.binary())], [f.split()[0] for f in _DIFFERENCES.split(", ")])

    return rows.select("root", "block", "blocks", "leader", "sid", "copies", "n", "k1", "k2", "text").mapInArrow(run, _DIFFERENCES)


def _pairwise(rows: DataFrame, similarity: float) -> DataFrame:
    """Links of each pair of blocks of texts told by their differences."""

    def run(batches):
        for table, bounds in _groups(batches, ("root", "_a", "_b")):
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(int(lo), int(hi - lo))
                side = part["_own"].to_numpy()
                if part["_a"][0].as_py() != part["_b"][0].as_py() and side.min() == side.max():
                    continue
                sets = [np.frombuffer(x, "<u8") for x in part["differs"].to_pylist()]
                link = linked(sets, part["n"].to_numpy(), side, similarity)
                yield pa.RecordBatch.from_arrays(_links_of(part["sid"].to_numpy(), part["copies"].to_numpy(), link), ["sid", "links", "to"])

    return rows.select("root", "_a", "_b", "_own", "sid", "copies", "n", "differs").mapInArrow(run, "sid long, links long, to long")


def links_of(docs: DataFrame, reps: DataFrame, member: DataFrame, similarity: float) -> DataFrame:
    """(sid, links, to): exact links of the representatives (sid, doc_id, text_key, ...) by group, from their texts."""
    sized = member.join(reps.select("sid", "copies", "n"), "sid")
    total = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.max(F.struct("copies", F.negative("sid").alias("sid"))).alias("top")).where("m > 1")
    total = stash(total.select("root", F.negative("top.sid").alias("leader"), F.greatest(_blocks("m", BLOCK_ROWS), _blocks("s", BLOCK_SHINGLES)).alias("blocks")), "sized")
    wanted = member.join(total, "root").join(reps.select("sid", "doc_id", "text_key", "k1", "k2", "copies", "n"), "sid")
    texts = docs.where("doc_id is not null").withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"])
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    texts = texts.withColumn("block", F.explode(F.when(F.col("sid") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))))
    found = stash(_verified(_together(texts, ["root", "block"]), similarity), "verified")
    large = found.where("differs is not null").select("root", "sid", "copies", "n", "differs")
    size = stash(large.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.octet_length("differs")).alias("s")).select("root", F.greatest(_blocks("m", PAIR_ROWS), _blocks("s", PAIR_BYTES)).alias("_blocks")), "pairs")
    large = large.join(size, "root").withColumn("_own", F.pmod(F.xxhash64("sid"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    large = large.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))
    pairwise = _pairwise(_together(large, ["root", "_a", "_b"]), similarity)
    return found.where("differs is null").select("sid", "links", "to").unionByName(pairwise)


def classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, and text_key (a hash of the text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(_signed(docs), "signed")
    sets = signed.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"), F.count("doc_id").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"))
    sets = sets.select(F.monotonically_increasing_id().alias("sid"), "k1", "k2", "one.doc_id", "one.text_key", "copies", "n", "paths")
    reps = stash(sets, "sets").where("copies > 0")

    member = stash(candidates(reps, similarity, recall), "members")
    links = stash(links_of(docs, reps, member, similarity), "links")
    discard(member)
    joined = components(links.select(F.col("sid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "sid")
    least = stash(joined.join(reps.select("sid", "doc_id"), "sid").groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    joined = joined.join(least, "root").drop("root")
    count = links.groupBy("sid").agg(F.sum("links").alias("links"))
    known = reps.select("sid", "k1", "k2", "doc_id", "copies").join(count, "sid", "left").join(joined, "sid", "left")
    known = known.select("k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.where("n > 0").select("doc_id", "text_key", "k1", "k2").join(stash(known, "known"), ["k1", "k2"], "left")
    has_id = F.col("doc_id").isNotNull()
    out = out.select("doc_id", F.when(has_id, F.col("class_id")).alias("class_id"), F.when(has_id, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), "text_key")
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_key")
    return out.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose class has a lesser doc_id; rows without an id stay."""
    found = classes(docs, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("_drop_id"), F.col("text_key").alias("_drop_key")).distinct()
    return docs.join(found, (docs["doc_id"].cast("long") == found["_drop_id"]) & (F.xxhash64(docs["text"]) == found["_drop_key"]), "left_anti")
