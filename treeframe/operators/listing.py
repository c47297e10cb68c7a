"""Listing and lookup: one directory, a subtree, one entry, and the checks made while walking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..entries import Immutable, InvalidArgument, Streaming, with_defaults
from ..functions import paths

# Names that a walk leaves out, limits of a walk, and what formats can do.
RESERVED = (".", "..", "lost+found")
MOST_ENTRIES, MOST_DEPTH = 64 << 20, 4096
CAPABILITIES = {
    "ext": "Mutable", "fat32": "Mutable", "exfat": "Mutable", "xfs": "Mutable", "hfs+": "Mutable", "ntfs": "Mutable", "grf": "Mutable",
    "tar": "Streaming", "iso9660": "Immutable", "squashfs": "Immutable", "hfs": "Immutable", "apfs": "Immutable", "f2fs": "Immutable",
}
SHARING = ("xfs",)  # whole files


def children(entries: DataFrame, path: str) -> DataFrame:
    """Entries right under path; of equal names the first in stream order."""
    rows = entries.where(paths.parent(F.col("path")) == path).withColumn("name", paths.basename(F.col("path")))
    first = F.row_number().over(Window.partitionBy("name").orderBy("seq"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def subtree(entries: DataFrame, path: str) -> DataFrame:
    """path's entry and all below it. A filter on a prefix, which a scan can use."""
    return entries if path == "/" else entries.where((F.col("path") == path) | F.col("path").startswith(f"{path}/"))


def recursive(entries: DataFrame, path: str = "/") -> DataFrame:
    """All below path with ``header``, the directory each is listed under, and ``place``, the order of a depth-first listing."""
    rows = subtree(entries, path).where(F.col("path") != path)
    return rows.withColumns({"header": paths.parent(F.col("path")), "name": paths.basename(F.col("path")), "place": paths.segments(F.col("path"))})


def exists(entries: DataFrame, path: str) -> DataFrame:
    """One row: whether path, or anything below it, is there."""
    return subtree(entries, path).limit(1).agg((F.count("*") > 0).alias("found"))


def stat(entries: DataFrame, path: str) -> DataFrame:
    return with_defaults(entries.where(F.col("path") == path))


def lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries for each of wanted's paths, which are normalised first; left out if missing."""
    w = wanted.select(F.col("path").alias("asked"), paths.normalise_keeping(F.col("path")).alias("path"))
    return w.join(entries, "path")


def parent_of(entries: DataFrame) -> DataFrame:
    """Each entry with the mode and kind of its parent directory, if that is stored."""
    p = entries.select(F.col("path").alias("_parent"), F.col("kind").alias("parent_kind"), F.col("mode").alias("parent_mode"))
    return entries.join(p, paths.parent(F.col("path")) == F.col("_parent"), "left").drop("_parent")


def without_reserved(entries: DataFrame) -> DataFrame:
    """Entries of which no component is reserved, so that a reserved directory's subtree goes too."""
    return entries.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*RESERVED)))


def whiteout(name: Column) -> Column:
    """What a layer's member name asks for: opaque, delete or nothing, and delete's name."""
    return F.when(name == ".wh..wh..opq", F.struct(F.lit("opaque").alias("action"), F.lit(None).cast("string").alias("target"))).when(
        F.startswith(name, F.lit(".wh.")), F.struct(F.lit("delete").alias("action"), F.substring(name, 5, 1 << 20).alias("target"))
    )


def checked(entries: DataFrame, most: int = MOST_ENTRIES, deepest: int = MOST_DEPTH) -> DataFrame:
    """One row of the walk's safety figures; it fails if a limit is passed or a directory inode repeats."""
    dirs = entries.where("kind = 'Dir' and inode <> 0").groupBy("source", "inode").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("_twice"))
    figures = entries.agg(F.count("*").alias("entries"), F.coalesce(F.max(paths.depth(F.col("path"))), F.lit(0)).alias("deepest")).join(dirs)
    ok = (F.col("entries") <= most) & (F.col("deepest") <= deepest) & (F.col("_twice") <= 1)
    return figures.select("entries", "deepest", F.when(ok, True).otherwise(F.raise_error(F.lit("the tree is too large or has a cycle"))).alias("safe"))


def mutability(formats: DataFrame) -> DataFrame:
    """formats (kind) with what changes each takes, whether one asked for may go on, and whether copies can share a body."""
    table = F.create_map(*[F.lit(x) for kv in CAPABILITIES.items() for x in kv])
    how = F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("Immutable"))
    shares = F.when(F.col("kind").isin(*SHARING), "WholeFile").otherwise("None")
    return formats.withColumns({
        "capability": how, "add_remove": how.isin("Mutable", "WholeFileOnly"), "partial_writes": how == "Mutable",
        "clone": shares, "shares_extents": shares != "None", "supports_range": shares == "Range",
    })


def require_mutable(kind: str, what: str, codec: str | None = None) -> None:
    """An error if a container of this kind, or one that is compressed, does not take changes in place."""
    if codec:
        raise InvalidArgument(f"{what}: a container under {codec} is not changed in place; repack it")
    how = CAPABILITIES.get(kind, "Immutable")
    if how == "Streaming":
        raise Streaming(f"{what}: {kind} can only be written from its start")
    if how == "Immutable":
        raise Immutable(f"{what}: {kind} is not changed once it is written")
