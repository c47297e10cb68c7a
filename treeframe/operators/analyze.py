"""Counts, bytes and sizes of a tree, each one aggregate over narrow expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.bits import ceil_div, ceil_to

# Fixed values of the sizing formulas.
DIRECT, INODE_BYTES, GROUP_BYTES, LOST_FOUND, JOURNAL = 12, 128, 32, 16384, 1024
FAT_LEAST = 65525 * 1024
DEVICES = ("Char", "Block", "Fifo", "Socket")


def indirect_blocks(blocks: Column, block_size: int) -> Column:
    """Blocks that only point to others, for a file of so many data blocks."""
    per = block_size // 4
    over = blocks - DIRECT
    return F.when(over <= 0, 0).when(over <= per, 1).otherwise(ceil_div(over - per, per) + 2).cast("long")


def _number(x: int, block_size: int) -> tuple[int, int]:
    """(blocks, pointing blocks) of a fixed size."""
    b = -(-x // block_size)
    over, per = b - DIRECT, block_size // 4
    return b, 0 if over <= 0 else 1 if over <= per else 2 + -(-(over - per) // per)


def analyze(entries: DataFrame, block_size: int = 4096, by: Sequence[str] = (), links_take_inodes: bool = True) -> DataFrame:
    """One row (for each value of ``by``): counts by kind, bytes, the inode and block estimates, recommended sizes.

    Hard links are counted apart from files; while a plain tree's estimate leaves an inode and
    an empty file for each, a merged tree's does not (links_take_inodes=False).
    """
    kind, size = F.col("kind"), F.coalesce(F.col("size"), F.lit(0)).cast("long")
    blocks = ceil_div(size, block_size)
    target = F.octet_length("link_target") if "link_target" in entries.columns else F.lit(0)
    out = entries.groupBy(*by).agg(
        F.count_if(kind == "Regular").alias("files"), F.count_if(kind == "Dir").alias("dirs"), F.count_if(kind == "Symlink").alias("symlinks"),
        F.count_if(kind.isin(*DEVICES)).alias("devices"), F.count_if(kind == "HardLink").alias("hardlinks"),
        F.coalesce(F.sum(F.when(kind == "Regular", size)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(kind == "Regular", blocks + indirect_blocks(blocks, block_size))), F.lit(0)).alias("_data"),
        F.count_if((kind == "Symlink") & (target > 60)).alias("_long"),
    )
    n = F.col("files") + F.col("dirs") + F.col("symlinks") + F.col("devices")
    n = n + F.col("hardlinks") if links_take_inodes else n
    inodes = ceil_to(n + 11, 8)
    lost, lost_more = _number(LOST_FOUND, block_size)
    first = 1 if block_size == 1024 else 0

    def ext_blocks(journal: bool) -> Column:
        j = JOURNAL if journal else 0
        over = j - DIRECT
        per = block_size // 4
        jp = 0 if over <= 0 else 1 if over <= per else 2 + -(-(over - per) // per)
        data = F.col("_data") + F.col("dirs") + lost + lost_more + F.col("_long") + j + jp
        meta = ceil_div(F.col("inodes") * INODE_BYTES, block_size) + 1 + -(-GROUP_BYTES // block_size) + 2
        # The slack is a product of doubles.
        return ceil_to(F.greatest(F.lit(64).cast("long"), F.ceil((data + meta + first).cast("double") * F.lit(1.1))), 8)

    out = out.withColumn("inodes", inodes)
    out = out.withColumns({"ext2_blocks": ext_blocks(False), "ext4_blocks": ext_blocks(True), "fat32_size": ceil_to(F.greatest(F.col("bytes") * 2, F.lit(FAT_LEAST).cast("long")), 512)})
    out = out.withColumns({"ext2_size": F.col("ext2_blocks") * block_size, "ext4_size": F.col("ext4_blocks") * block_size})
    return out.select(*by, "files", "dirs", "symlinks", "devices", "hardlinks", "bytes", "inodes", "ext2_blocks", "ext4_blocks", "ext2_size", "ext4_size", "fat32_size")


def recommended_sizes(figures: DataFrame) -> DataFrame:
    """figures with the sizes as a map, sorted by format; formats that stream have none."""
    pairs = [("ext2", "ext2_size"), ("ext3", "ext4_size"), ("ext4", "ext4_size"), ("fat32", "fat32_size"), ("vfat", "fat32_size")]
    return figures.withColumn("recommended_size", F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c))]))


def report_json(figures: DataFrame) -> DataFrame:
    return figures.select(F.to_json(F.struct(*figures.columns)).alias("report"))


def archive_sizes(entries: DataFrame) -> DataFrame:
    """Size of an image that takes an archive's members: hard links count as files, with their size."""
    file = F.col("kind").isin("Regular", "HardLink")
    out = entries.agg(F.count_if(file).alias("files"), F.count("*").alias("members"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"))
    inodes = F.col("members") + 16
    ext = ceil_to(F.greatest(F.lit(8 << 20).cast("long"), F.col("bytes") + inodes * 4096 + (1 << 20)), 4096)
    return out.withColumns({"inodes": inodes, "ext_size": ext, "other_size": F.col("bytes") + (16 << 20)})


def archive_info(entries: DataFrame) -> DataFrame:
    """What an archive holds: members by kind, bytes, attributes, and names at the top."""
    kind = F.col("kind")
    top = F.element_at(F.split(F.ltrim(F.col("path"), F.lit("/")), "/"), 1)
    attributes = F.sum(F.coalesce(F.size("xattrs"), F.lit(0))) if "xattrs" in entries.columns else F.lit(0)
    return entries.agg(
        F.count("*").alias("total"), F.count_if(kind.isin("Regular", "HardLink")).alias("files"), F.count_if(kind == "HardLink").alias("hardlinks"), F.count_if(kind == "Dir").alias("dirs"), F.count_if(kind == "Symlink").alias("symlinks"),
        F.count_if(kind.isin(*DEVICES)).alias("devices"), F.coalesce(F.sum(F.when(kind == "Regular", F.col("size"))), F.lit(0)).alias("bytes"), attributes.cast("long").alias("xattrs"), F.count_distinct(top).alias("top_level"),
    )


def layout_sizes(figures: DataFrame) -> DataFrame:
    """Sizes to start from for formats without an estimate of their own, from ``bytes``."""
    b = F.col("bytes")
    return figures.select("bytes", (b + (32 << 20)).alias("iso"), (b + (64 << 10)).alias("grf"), (b * 2 + (16 << 20)).alias("archive"), (b * 2 + (64 << 20)).alias("generic"))


def inode_density(figures: DataFrame, block_size: int, bytes_per_inode: int = 16384) -> DataFrame:
    """Inodes raised to the density of a destination of so many blocks."""
    return figures.withColumn("inodes", F.greatest("inodes", F.call_function("div", F.col("blocks") * block_size, F.lit(bytes_per_inode))))


def progress(done_bytes: Column, total_bytes: Column, done_files: Column, total_files: Column) -> Column:
    """Share done: by bytes if there are any, else by files."""
    return F.when(total_bytes > 0, done_bytes / total_bytes).when(total_files > 0, done_files / total_files).otherwise(F.lit(0.0))


def resource_counts(resources: DataFrame) -> DataFrame:
    """Types, resources and bytes of an inventory (type, id, size)."""
    return resources.agg(F.count_distinct("type").alias("types"), F.count("*").alias("resources"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def wasted(entries: DataFrame, block_size: int) -> DataFrame:
    """Bytes that whole blocks take beyond the content."""
    return entries.where("kind = 'Regular'").agg(F.sum(ceil_to(F.col("size"), block_size) - F.col("size")).alias("wasted"))


def top_level(entries: DataFrame) -> DataFrame:
    return entries.select(F.element_at(paths.segments(F.col("path")), 1).alias("name")).distinct()
