"""Changes to an entry relation: each takes entries and gives the changed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entries import Unsupported
from ..functions import paths

# The device nodes of a minimal root.
MINIMAL = (("console", 5, 1, 0o600), ("null", 1, 3, 0o666), ("zero", 1, 5, 0o666), ("ptmx", 5, 2, 0o666), ("tty", 5, 0, 0o666), ("fuse", 10, 229, 0o666), ("random", 1, 8, 0o666), ("urandom", 1, 9, 0o666))
# The others of a standard root: (name, major, first minor, mode), and disks.
KERNEL = (("kmsg", 1, 11, 0o644), ("mem", 1, 1, 0o640), ("port", 1, 4, 0o640))
DISKS = (("hda", 3, 0), ("hdb", 3, 64), ("hdc", 22, 0), ("hdd", 22, 64), ("sda", 8, 0), ("sdb", 8, 16), ("sdc", 8, 32), ("sdd", 8, 48))


def _at(path: str) -> Column:
    return F.col("path") == path


def create(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries and new ones; an error if a path is taken."""
    taken = new.join(entries.select("path"), "path", "left_semi").withColumn("path", F.raise_error(F.concat(F.lit("exists: "), F.col("path"))))
    return entries.unionByName(new, allowMissingColumns=True).unionByName(taken, allowMissingColumns=True)


def under_folders(entries: DataFrame, new: DataFrame) -> DataFrame:
    """new, with an error for an entry whose parent is no folder in entries or in new."""
    up = F.coalesce(paths.parent(F.col("path")), F.lit("/"))
    folders = entries.where("kind = 'Dir'").select(F.col("path").alias("_up")).unionByName(new.where("kind = 'Dir'").select(F.col("path").alias("_up"))).distinct()
    # Entries at the top need no join; the root is always there.
    below = new.withColumn("_up", up).where("_up <> '/'").join(folders.withColumn("_is", F.lit(True)), "_up", "left")
    path = F.when(F.col("_is"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no such folder: "), F.col("_up"))).cast("string"))
    return new.where(up == "/").unionByName(below.withColumn("path", path).select(*new.columns))


def folder(spark, path: str) -> DataFrame:
    """An empty folder as an entry."""
    return spark.createDataFrame([(path, "Dir", 0o755, 0, 0, 0, 0)], "path string, kind string, mode int, uid long, gid long, size long, mtime long")


def remove(entries: DataFrame, path: str) -> DataFrame:
    """entries without path; an error if it is a directory that is not empty."""
    below = entries.where(F.col("path").startswith(f"{path}/")).limit(1).select(*[F.raise_error(F.lit(f"not empty: {path}")).cast(f.dataType).alias(f.name) for f in entries.schema.fields])
    return entries.where(~_at(path)).unionByName(below)


def remove_tree(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(~(_at(path) | F.col("path").startswith(f"{path}/")))


def rename(entries: DataFrame, old: str, new: str) -> DataFrame:
    """old and all below it moved to new; inodes stay."""
    moved = F.concat(F.lit(new), F.substring(F.col("path"), len(old) + 1, 1 << 20))
    return entries.withColumn("path", F.when(_at(old) | F.col("path").startswith(f"{old}/"), moved).otherwise(F.col("path")))


def set_attributes(entries: DataFrame, patch: DataFrame) -> DataFrame:
    """entries with patch's values by path; a null there keeps what is."""
    names = [c for c in patch.columns if c != "path"]
    p = patch.select("path", *[F.col(c).alias(f"_{c}") for c in names])
    out = entries.join(p, "path", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*entries.columns)


def set_size(entries: DataFrame, path: str, size: int) -> DataFrame:
    return entries.withColumn("size", F.when(_at(path), F.lit(size).cast("long")).otherwise(F.col("size")))


def hard_link(entries: DataFrame, path: str, new: str) -> DataFrame:
    """A second name for path, with the same inode; both count the names."""
    copy = entries.where(_at(path)).withColumn("path", F.lit(new))
    both = entries.unionByName(copy)
    node = entries.where(_at(path)).select(F.col("inode").alias("_node"))
    out = both.join(F.broadcast(node.limit(1)), F.col("inode") == F.col("_node"), "left")
    return out.withColumn("nlink", F.when(F.col("_node").isNotNull(), F.col("nlink") + 1).otherwise(F.col("nlink"))).select(*entries.columns)


def clone(entries: DataFrame, path: str, new: str) -> DataFrame:
    """A copy of path with an inode of its own that shares the body; an error if new is taken or path is no file."""
    top = entries.agg((F.coalesce(F.max("inode"), F.lit(0)) + 1).alias("_next"))
    copy = entries.where(_at(path)).join(top).withColumns({"path": F.lit(new), "inode": F.col("_next"), "nlink": F.lit(1).cast("long")})
    copy = copy.withColumn("path", F.when(F.col("kind") == "Regular", F.col("path")).otherwise(F.raise_error(F.lit(f"not a file: {path}")).cast("string")))
    return create(entries, copy.select(*entries.columns))


def clone_range(kind: str) -> None:
    """Always an error: no kind of container here shares a part of a file's body (see listing.mutability)."""
    raise Unsupported(f"{kind} does not share a part of a file")


def set_attribute(xattrs: Column, name: str, value: bytes) -> Column:
    """An attribute list with name set: in its place if it is there, else at the end."""
    item = F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    has = F.exists(xattrs, lambda x: x["name"] == name)
    return F.when(has, F.transform(xattrs, lambda x: F.when(x["name"] == name, item).otherwise(x))).otherwise(F.concat(xattrs, F.array(item)))


def replace_attributes(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with the whole attribute lists of new (path, xattrs) in place of their own; others keep theirs."""
    lists = new.select("path", F.col("xattrs").alias("_new"), F.lit(True).alias("_set"))
    out = entries.join(lists, "path", "left").withColumn("xattrs", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("xattrs")))
    return out.select(*entries.columns)


def remove_attribute(xattrs: Column, name: str) -> Column:
    return F.filter(xattrs, lambda x: x["name"] != name)


def attribute_names(xattrs: Column) -> Column:
    return F.transform(xattrs, lambda x: x["name"])


def devices(spark, which: str = "standard") -> DataFrame:
    """Device nodes of a root: none, minimal, or standard with consoles, serial ports and disks."""
    schema = "name string, kind string, major long, minor long, mode int"
    if which == "none":
        return spark.createDataFrame([], schema)
    rows = [(n, "Char", a, b, m) for n, a, b, m in MINIMAL]
    if which == "standard":
        rows += [(n, "Char", a, b, m) for n, a, b, m in KERNEL]
    base = spark.createDataFrame(rows, schema)
    if which == "minimal":
        return base
    ttys = spark.range(16).select(F.concat(F.lit("tty"), "id").alias("name"), F.lit("Char").alias("kind"), F.lit(4).cast("long").alias("major"), F.col("id").alias("minor"), F.lit(0o620).alias("mode"))
    serial = spark.range(4).select(F.concat(F.lit("ttyS"), "id").alias("name"), F.lit("Char").alias("kind"), F.lit(4).cast("long").alias("major"), (F.col("id") + 64).alias("minor"), F.lit(0o660).alias("mode"))
    disks = spark.createDataFrame(list(DISKS), "disk string, major long, first long").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    disks = disks.select(F.concat("disk", F.when(F.col("n") > 0, F.col("n").cast("string")).otherwise("")).alias("name"), F.lit("Block").alias("kind"), "major", (F.col("first") + F.col("n")).alias("minor"), F.lit(0o660).alias("mode"))
    return base.unionByName(ttys).unionByName(serial).unionByName(disks)


def volume(entries: DataFrame, block: int, blocks: int) -> DataFrame:
    """One row of capacity: blocks in all and free, and entries."""
    used = F.sum(F.expr(f"(coalesce(size, 0) + {block - 1}) div {block}"))
    return entries.agg(F.lit(block).alias("block_size"), F.lit(blocks).cast("long").alias("blocks"), (F.lit(blocks) - F.coalesce(used, F.lit(0))).alias("blocks_free"), F.count("*").alias("files"))


def parent_exists(entries: DataFrame, path: str) -> DataFrame:
    return entries.where((F.col("path") == paths.parent(F.lit(path))) & (F.col("kind") == "Dir"))
