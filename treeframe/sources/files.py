"""Folders of plain files as entry relations.

``scan`` lists regular files on any store that Spark reads. ``tree`` walks a folder that every
executor can open, with directories, symbolic links, devices and hard links; it goes level by
level, and the folders of a level are dealt out, so no task holds more than one folder's names.
"""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..entries import ENTRIES, InvalidArgument, InvalidImage, OutOfBounds
from ..functions import paths
from ..operators.links import link_groups
from ..operators.listing import MOST_DEPTH
from ..operators.ordering import kept

_KINDS = {stat.S_IFREG: "Regular", stat.S_IFDIR: "Dir", stat.S_IFLNK: "Symlink", stat.S_IFCHR: "Char", stat.S_IFBLK: "Block", stat.S_IFIFO: "Fifo", stat.S_IFSOCK: "Socket"}
_ROWS = 5000


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Regular files under root; contents are not read, since only names, lengths and times are asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = F.lit(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    return f.select(F.lit(root).alias("source"), F.substring(path, F.length(top) + 1, F.lit(1 << 20)).alias("path"), F.lit("Regular").alias("kind"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def _utf8(name: str, what: str) -> str:
    try:
        name.encode()
    except UnicodeEncodeError as e:
        raise InvalidArgument(f"{what} is not UTF-8: {name!r}") from e
    return name


def _found(root: str, at: str):
    """The entries of one folder; links are not followed."""
    with os.scandir(root + at) as names:
        for e in names:
            path = f"{at.rstrip('/')}/{_utf8(e.name, 'a name')}"
            s = e.stat(follow_symlinks=False)
            kind = _KINDS.get(stat.S_IFMT(s.st_mode))
            if kind is None:
                continue
            device = kind in ("Char", "Block")
            target = _utf8(os.readlink(e.path), "a link's target") if kind == "Symlink" else None
            size = s.st_size if kind == "Regular" else 0
            body = {"tag": "host", "path": e.path, "offset": 0, "clen": size, "ulen": size, "method": "stored"} if size else None
            yield {
                "source": root, "layer": 0, "seq": None, "path": path, "kind": kind, "mode": stat.S_IMODE(s.st_mode), "uid": s.st_uid, "gid": s.st_gid, "size": size, "mtime": min(max(int(s.st_mtime), 0), 0xFFFFFFFF),
                "dev_major": os.major(s.st_rdev) if device else 0, "dev_minor": os.minor(s.st_rdev) if device else 0, "link_target": target, "inode": s.st_ino, "nlink": s.st_nlink, "xattrs": [], "body": body,
            }


def tree(spark: SparkSession, root: str, deepest: int = MOST_DEPTH) -> DataFrame:
    """Everything under root, not root itself. A name that is not UTF-8 is an error, and so is a folder that cannot be read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    top = os.path.abspath(root.removeprefix("file://").removeprefix("file:"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        schema = to_arrow_schema(ENTRIES)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                held = []
                for entry in _found(top, at):
                    held.append(entry)
                    if len(held) == _ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    level, out = kept(spark.createDataFrame([("/",)], "path string").mapInArrow(run, ENTRIES)), None
    for _ in range(deepest):
        out = level if out is None else out.unionByName(level)
        folders = level.where("kind = 'Dir'").select("path")
        if folders.isEmpty():
            return out
        level = kept(folders.repartition(tasks, "path").mapInArrow(run, ENTRIES))
    raise InvalidImage(f"folders deeper than {deepest}")


def _marked(path: Column) -> Column:
    """Whether an entry stands inside a folder whose name is a marker."""
    return F.exists(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda s: s.startswith(".wh."))


def layer(found: DataFrame) -> DataFrame:
    """A tree as a layer to merge: folders, files and symbolic links, further names of a file as hard links.

    A folder has no order of its own, so all its markers act before its entries; what stands
    inside a folder with a marker's name does not count.
    """
    rows = found.where(F.col("kind").isin("Dir", "Regular", "Symlink") & ~_marked(F.col("path")))
    mark = paths.basename(F.col("path")).startswith(".wh.")
    named = link_groups(rows.where(~mark)).unionByName(rows.where(mark).withColumn("link_to", F.lit(None).cast("string")))
    linked = F.col("link_to").isNotNull()
    return named.withColumns({
        "kind": F.when(linked, "HardLink").otherwise(F.col("kind")), "link_target": F.coalesce("link_to", "link_target"), "body": F.when(~linked, F.col("body")),
        "seq": F.when(mark, 0).otherwise(1).cast("long"),
    }).drop("link_to")


def bodies(entries: DataFrame) -> DataFrame:
    """Regular files of a tree with ``data``, their bytes; a file of another length than when it was listed is an error."""

    @pandas_udf(BinaryType())
    def read(path, size):
        def one(p, n):
            with open(p, "rb") as f:
                data = f.read(n + 1)
            if len(data) != n:
                raise OutOfBounds(f"{p} changed its length")
            return data

        return path.combine(size, lambda p, n: one(p, int(n)) if p else b"")

    return entries.where("kind = 'Regular'").withColumn("data", read(F.col("body.path"), F.coalesce("size", F.lit(0))))

