"""Partition tables decoded from the bytes of a disk by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import big, c_string, little, mixed_uuid
from ..operators.layout import PARTITION_TYPES

SECTOR = 512


def _kind_of(value: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for row in PARTITION_TYPES:
        if row[at] is not None:
            out = F.when(value == row[at], row[0]).otherwise(out)
    return out


def mbr(disks: DataFrame) -> DataFrame:
    """The four records (number, kind, start_lba, size_lba, bootable) of disks (id, content) that are in use."""
    ok = disks.where(F.hex(F.substring("content", 511, 2)) == "55AA")
    rows = ok.select("id", F.posexplode(F.array(*[F.substring("content", 447 + 16 * k, 16) for k in range(4)])).alias("number", "r"))
    byte = little(F.col("r"), 4, 1)
    kind = F.coalesce(_kind_of(byte, 1), F.concat(F.lit("Mbr:"), byte.cast("string")))
    return rows.where(byte != 0).select("id", "number", kind.alias("kind"), little(F.col("r"), 8, 4).alias("start_lba"), little(F.col("r"), 12, 4).alias("size_lba"), (little(F.col("r"), 0, 1) == 128).alias("bootable"))


def gpt(disks: DataFrame) -> DataFrame:
    """Records of disks (id, content) whose header and entries have right checksums."""
    c = F.col("content")
    header = F.substring(c, SECTOR + 1, 92)
    h = disks.where(F.hex(F.substring(c, SECTOR + 1, 8)) == "4546492050415254").select("id", "content", header.alias("h"))
    zeroed = F.concat(F.substring("h", 1, 16), F.lit(b"\0" * 4), F.substring("h", 21, 72))
    h = h.where(F.crc32(zeroed) == little(F.col("h"), 16, 4)).select("id", "content", (little(F.col("h"), 72, 8) * SECTOR).alias("at"), little(F.col("h"), 80, 4).alias("n"), little(F.col("h"), 84, 4).alias("size"), little(F.col("h"), 88, 4).alias("crc"))
    table = F.substring(F.col("content"), (F.col("at") + 1).cast("int"), (F.col("n") * F.col("size")).cast("int"))
    h = h.withColumn("t", table).where(F.crc32("t") == F.col("crc"))
    rows = h.select("id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.substring(F.col("t"), (k * F.col("size") + 1).cast("int"), F.col("size").cast("int")))).alias("number", "r"))
    r = F.col("r")
    kind = F.coalesce(_kind_of(mixed_uuid(F.substring(r, 1, 16)), 2), F.concat(F.lit("Gpt:"), mixed_uuid(F.substring(r, 1, 16))))
    name = F.regexp_extract(F.decode(F.substring(r, 57, 72), "UTF-16LE"), "^([^\\x00]*)", 1)
    start, last = little(r, 32, 8), little(r, 40, 8)
    return rows.where(F.hex(F.substring(r, 1, 16)) != "0" * 32).select("id", "number", kind.alias("kind"), mixed_uuid(F.substring(r, 17, 16)).alias("uuid"), start.alias("start_lba"), (last - start + 1).alias("size_lba"), name.alias("name"))


def apm(disks: DataFrame, block: int = SECTOR) -> DataFrame:
    """Records of an Apple partition map, which stand in blocks of their own after the first."""
    c = F.col("content")
    n = big(F.substring(c, block + 1, 8), 4, 4)
    ok = disks.where(F.hex(F.substring(c, block + 1, 2)) == "504D")
    rows = ok.select("id", F.posexplode(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.substring(c, (k * block + 1).cast("int"), F.lit(block)))).alias("number", "r"))
    r = F.col("r")
    return rows.select("id", "number", F.concat(F.lit("Apm:"), c_string(F.substring(r, 49, 32))).alias("kind"), big(r, 8, 4).alias("start_lba"), big(r, 12, 4).alias("size_lba"), c_string(F.substring(r, 17, 32)).alias("name"))


def table_kind(content: Column) -> Column:
    """none for a FAT volume's own boot sector, then gpt, apm, mbr with a type that is not 0, else none."""
    types = F.array(*[F.hex(F.substring(content, 451 + 16 * k, 1)) for k in range(4)])
    fat = F.hex(F.substring(content, 83, 5)) == "4641543332"
    signed = F.hex(F.substring(content, 511, 2)) == "55AA"
    return F.when(fat, "none").when(F.hex(F.substring(content, SECTOR + 1, 8)) == "4546492050415254", "gpt").when(F.hex(F.substring(content, SECTOR + 1, 2)) == "504D", "apm").when(signed & F.exists(types, lambda t: t != "00"), "mbr").otherwise("none")
