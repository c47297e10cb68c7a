"""The commands of the library: each takes entries or a path and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .entries import InvalidArgument
from .operators import analyze as _analyze
from .operators import listing, merge, mutate
from .operators.links import last_writes
from .operators.ordering import kept
from .sinks import archives as sinks
from .sources import archives as sources
from .sources import detect, files, partitions


def ls(entries: DataFrame, path: str = "/", recursive: bool = False) -> DataFrame:
    rows = listing.recursive(entries, path) if recursive else listing.children(entries, path)
    return rows.orderBy("place") if recursive else rows.orderBy("name")


def cat(spark: SparkSession, archive: str, path: str, kind: str = "tar", codec: str | None = None) -> DataFrame:
    """The bytes of one member, the last of its name."""
    entries = sources.scan(spark, archive, kind, codec).where(F.col("path") == path)
    return sources.bodies(spark, last_writes(entries), archive, codec).select("path", "data")


def info(entries: DataFrame) -> DataFrame:
    return _analyze.archive_info(entries)


def analyze(entries: DataFrame, block_size: int = 4096) -> DataFrame:
    return _analyze.recommended_sizes(_analyze.analyze(entries, block_size))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Format, codec, container and mutability of every file under path."""
    return listing.mutability(detect.detected(spark, path).withColumnRenamed("format", "kind"))


def disk(spark: SparkSession, path: str) -> DataFrame:
    """Partitions of every disk image under path."""
    disks = spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content").withColumn("table", partitions.table_kind(F.col("content")))
    out = partitions.gpt(disks.where("table = 'gpt'")).unionByName(partitions.mbr(disks.where("table = 'mbr'")), allowMissingColumns=True)
    return out.unionByName(partitions.apm(disks.where("table = 'apm'")), allowMissingColumns=True)


def repack(spark: SparkSession, layers: list[str], out: str, kind: str = "tar", source_kind: str | list[str] = "tar", codec: str | None = None, shards: int | None = None) -> None:
    """Layers, from the bottom up, merged and written as shards with the bodies of the files that won.

    source_kind is one for all layers or one for each; ``dir`` is a folder that every executor can open.
    Bodies in plain archives at hand are read as the shards are written; others are dealt out first.
    """
    kinds = [source_kind] * len(layers) if isinstance(source_kind, str) else source_kind
    if len(kinds) != len(layers):
        raise InvalidArgument("a kind for each layer")
    scans = [files.layer(files.tree(spark, p)) if k == "dir" else sources.scan(spark, p, k, codec) for p, k in zip(layers, kinds, strict=True)]
    # Each step's rows are kept, or every use of them would scan all layers again.
    events = kept(merge.events_of(merge.concatenated(*[s.drop("layer") for s in scans])))
    tree = kept(merge.emission(kept(merge.with_parents(kept(merge.merge(events))))))
    if not codec and all(k != "dir" and sources.at_hand(spark, p) for p, k in zip(layers, kinds, strict=True)):
        return sinks.write(tree, out, kind, shards, filled=sources.with_data)
    # A file's body comes from its own layer, so each is read once and nothing is compared by content.
    made = tree.where("kind <> 'Regular' or layer is null").withColumn("data", F.lit(None).cast("binary"))
    for n, (p, k) in enumerate(zip(layers, kinds, strict=True)):
        won = tree.where((F.col("kind") == "Regular") & (F.col("layer") == n))
        made = made.unionByName(files.bodies(won) if k == "dir" else sources.bodies(spark, won, p, codec))
    sinks.write(made, out, kind, shards)


def add(entries: DataFrame, new: DataFrame, kind: str, codec: str | None = None) -> DataFrame:
    """entries of a container of this kind and new ones, whose parents must be folders there or among the new ones."""
    listing.require_mutable(kind, "add", codec)
    return mutate.create(entries, mutate.under_folders(entries, new))


def add_tree(spark: SparkSession, entries: DataFrame, root: str, at: str, kind: str, codec: str | None = None) -> DataFrame:
    """A folder's tree added at a new path, which becomes a folder."""
    listing.require_mutable(kind, "add", codec)
    found = files.tree(spark, root)
    below = found.withColumn("path", F.concat(F.lit(at.rstrip("/")), F.col("path")))
    return add(entries, mutate.folder(spark, at).unionByName(below.select(*[c for c in below.columns if c in entries.columns]), allowMissingColumns=True), kind)


def mkdir(spark: SparkSession, entries: DataFrame, path: str, kind: str, codec: str | None = None) -> DataFrame:
    listing.require_mutable(kind, "mkdir", codec)
    return add(entries, mutate.folder(spark, path), kind)


def rm(entries: DataFrame, path: str, kind: str, codec: str | None = None) -> DataFrame:
    listing.require_mutable(kind, "rm", codec)
    return mutate.remove(entries, path)
