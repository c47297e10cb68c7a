"""What a file is, from its first bytes, its last ones, or its name: expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (format, offset, bytes in hex, ...), tried in this order; every pair must match.
MAGIC = (
    ("fat32", 510, "55AA", 82, "4641543332"), ("exfat", 3, "4558464154202020"), ("ntfs", 3, "4E54465320202020"), ("xfs", 0, "58465342"), ("squashfs", 0, "68737173"),
    ("grf", 0, "4D6173746572206F66204D6167696300"), ("zip", 0, "504B0304"), ("zip", 0, "504B0506"), ("cpio", 0, "303730373031"), ("cpio", 0, "303730373032"), ("cpio", 0, "303730373037"),
    ("ar", 0, "213C617263683E0A"), ("7z", 0, "377ABCAF271C"), ("rar", 0, "526172211A07"), ("cab", 0, "4D534346"), ("lha", 2, "2D6C", 6, "2D"), ("lzx", 0, "4C5A5800"), ("sit", 0, "53495421"), ("sit", 0, "53747566664974"),
    ("tar", 257, "7573746172"), ("iso9660", 32769, "4344303031"), ("apfs", 32, "4E585342"), ("ext", 1080, "53EF"), ("hfs+", 1024, "482B"), ("hfs+", 1024, "4858"), ("hfs", 1024, "4244"), ("f2fs", 1024, "1020F5F2"), ("f2fs", 5120, "1020F5F2"),
)
CODEC_MAGIC = (("gzip", "1F8B"), ("xz", "FD377A585A00"), ("zstd", "28B52FFD"), ("lz4", "04224D18"), ("lzma", "5D0000"))
CODEC_SUFFIXES = (("gzip", (".gz", ".tgz")), ("xz", (".xz", ".txz")), ("lzma", (".lzma",)), ("lz4", (".lz4",)), ("zstd", (".zst", ".zstd")), ("lzo", (".lzo",)))
HEAD_BYTES = 40960


def _has(content: Column, at: int, wanted: str) -> Column:
    return F.hex(F.substring(content, at + 1, len(wanted) // 2)) == wanted


def file_format(content: Column) -> Column:
    """The first format of MAGIC that matches; one old archive format has no magic and comes last; null if none."""
    out = F.when((F.hex(F.substring(content, 1, 1)) == "1A") & F.hex(F.substring(content, 2, 1)).between("01", "0B"), "arc")
    for name, *pairs in reversed(MAGIC):
        ok = _has(content, pairs[0], pairs[1])
        if len(pairs) > 2:
            ok = ok & _has(content, pairs[2], pairs[3])
        out = F.when(ok, name).otherwise(out)
    return out


def codec_of_name(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for codec, suffixes in reversed(CODEC_SUFFIXES):
        ok = F.lit(False)
        for s in suffixes:
            ok = ok | F.endswith(low, F.lit(s))
        out = F.when(ok, codec).otherwise(out)
    return out


def codec_of_bytes(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for codec, magic in reversed(CODEC_MAGIC):
        out = F.when(_has(content, 0, magic), codec).otherwise(out)
    return out


def codec(path: Column, content: Column) -> Column:
    """By name first, then by the first bytes."""
    return F.coalesce(codec_of_name(path), codec_of_bytes(content))


def archive_codec(path: Column) -> Column:
    """How a named tar is compressed: short suffixes, or a codec behind ``.tar.``; none for another name."""
    low = F.lower(path)
    return F.when(F.endswith(low, F.lit(".tgz")) | F.endswith(low, F.lit(".txz")) | F.contains(low, F.lit(".tar.")), codec_of_name(path))


def container(content: Column) -> Column:
    """What holds a disk: a sparse copy-on-write image, a compressed or an old disk image, or the raw bytes."""
    n = F.octet_length(content)
    return F.when(_has(content, 0, "514649FB"), "qcow2").when(F.hex(F.substring(content, n - 511, F.lit(4))) == "6B6F6C79", "dmg").when(_has(content, 82, "0100"), "diskcopy").otherwise("raw")


def target(spec: Column) -> Column:
    """``path:N`` as (path, partition from 0); N below 1 is an error, no N is the whole."""
    m = F.regexp_extract(spec, "^(.*):([0-9]+)$", 2)
    number = F.when(m != "", F.when(m.cast("long") >= 1, m.cast("long") - 1).otherwise(F.raise_error(F.lit("partitions count from 1")).cast("long")))
    return F.struct(F.when(m != "", F.regexp_extract(spec, "^(.*):([0-9]+)$", 1)).otherwise(spec).alias("path"), number.alias("partition"))


def source_kind(spec: Column) -> Column:
    """Whether a source is layers, a compressed or plain tar, or an image."""
    return F.when(F.contains(spec, F.lit("+")), "layered").when(archive_codec(spec).isNotNull(), "compressed tar").when(F.endswith(F.lower(spec), F.lit(".tar")), "tar").otherwise("image")


def detected(spark: SparkSession, path: str) -> DataFrame:
    """path, length, format, codec and container of every file under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, HEAD_BYTES)
    return f.select("path", "length", file_format(head).alias("format"), codec(F.col("path"), head).alias("codec"), container(F.col("content")).alias("container"))
