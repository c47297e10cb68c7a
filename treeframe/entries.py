"""The entry relation: one row for each file, directory, link or device of a tree.

Absent attributes are defaults, not null: see ``with_defaults``. Bodies are not in the rows;
``body`` says where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import paths

XATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.BinaryType())]))
BODY = T.StructType([T.StructField("tag", T.StringType()), T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("clen", T.LongType()), T.StructField("ulen", T.LongType()), T.StructField("method", T.StringType())])
ENTRIES = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("mode", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()),
    T.StructField("dev_major", T.LongType()), T.StructField("dev_minor", T.LongType()), T.StructField("link_target", T.StringType()), T.StructField("inode", T.LongType()), T.StructField("nlink", T.LongType()),
    T.StructField("xattrs", XATTRS), T.StructField("body", BODY),
])


class ImageError(Exception):
    """Any failure of this library."""


class InvalidImage(ImageError):
    pass


class InvalidArgument(ImageError):
    pass


class Unsupported(ImageError):
    pass


class Immutable(ImageError):
    pass


class OutOfBounds(ImageError):
    pass


class Streaming(ImageError):
    pass


def with_places(entries: DataFrame) -> DataFrame:
    """entries with parent, name and depth derived from path."""
    return entries.withColumns({"parent": paths.parent(F.col("path")), "name": paths.basename(F.col("path")), "depth": paths.depth(F.col("path"))})


def with_defaults(entries: DataFrame) -> DataFrame:
    """The attributes that a listing shows where a format has none."""
    kind = F.col("kind")
    values = {
        "mode": F.when(kind == "Dir", 0o755).when(kind == "Symlink", 0o777).otherwise(0o644), "nlink": F.when(kind == "Dir", 2).otherwise(1).cast("long"),
        **{c: F.lit(0).cast("long") for c in ("uid", "gid", "size", "mtime", "dev_major", "dev_minor")},
    }
    out = entries.withColumns({c: F.coalesce(F.col(c), v) if c in entries.columns else v for c, v in values.items()})
    return out.withColumn("blocks", F.expr("(size + 511) div 512"))
