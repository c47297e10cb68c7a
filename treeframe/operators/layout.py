"""Extents, offsets, partitions and chunks: order-dependent placement as windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import ceil_to
from .ordering import running_sum, with_next

# Partition kinds with their type byte and type identifier, and their spellings.
PARTITION_TYPES = (
    ("Empty", 0x00, "00000000-0000-0000-0000-000000000000"), ("LinuxFilesystem", 0x83, "0FC63DAF-8483-4772-8E79-3D69D8477DE4"), ("LinuxSwap", 0x82, "0657FD6D-A4AB-43C4-84E5-0933C84B4F4F"),
    ("EfiSystem", 0xEF, "C12A7328-F81F-11D2-BA4B-00A0C93EC93B"), ("BiosBoot", None, "21686148-6449-6E6F-744E-656564454649"), ("Fat32", 0x0C, None), ("MicrosoftBasicData", 0x07, "EBD0A0A2-B9E5-4433-87C0-68B6B72699C7"),
)
PARTITION_NAMES = {
    "esp": "EfiSystem", "efi": "EfiSystem", "efi-system": "EfiSystem", "linux": "LinuxFilesystem", "linux-filesystem": "LinuxFilesystem", "linux-swap": "LinuxSwap", "swap": "LinuxSwap",
    "bios-boot": "BiosBoot", "bios": "BiosBoot", "fat": "Fat32", "fat32": "Fat32", "msdata": "MicrosoftBasicData", "microsoft-basic-data": "MicrosoftBasicData", "basic-data": "MicrosoftBasicData", "empty": "Empty",
}
ALIGNMENT, LONGEST_RUN = 2048, 32768


def extents(blocks: DataFrame, longest: int = LONGEST_RUN, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Runs of (logical, physical) blocks of each file: logical, physical, length; physical 0 is a hole and ends a run.

    Neighbours differ equally in both numbers, so a run is a group of equal differences; runs
    longer than ``longest`` are cut by their row within the run.
    """
    real = blocks.where("physical <> 0")
    rows = Window.partitionBy(*by).orderBy("logical")
    new = (F.col("logical") != F.lag("logical").over(rows) + 1) | (F.col("physical") != F.lag("physical").over(rows) + 1)
    run = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(rows)
    numbered = real.withColumn("_run", run)
    within = F.col("logical") - F.min("logical").over(Window.partitionBy(*by, "_run"))
    numbered = numbered.withColumn("_cut", F.call_function("div", within, F.lit(longest)))
    return numbered.groupBy(*by, "_run", "_cut").agg(F.min("logical").alias("logical"), F.min("physical").alias("physical"), F.count("*").alias("length")).drop("_run", "_cut")


def member_offsets(entries: DataFrame, by: tuple[str, ...] = ("source",), header: int = 512, align: int = 512) -> DataFrame:
    """Where each member's header and body stand in an archive that has no extended headers."""
    body = ceil_to(F.coalesce(F.col("size"), F.lit(0)), align)
    out = running_sum(entries, body + header, by, "seq", "header_offset")
    return out.withColumn("body_offset", F.col("header_offset") + header)


def overlaps(partitions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Partitions that run past the start of the next one that is not empty."""
    rows = with_next(partitions.where("kind <> 'Empty'"), by, "start_lba", "next_start")
    return rows.withColumn("end_lba", F.col("start_lba") + F.col("size_lba") - 1).where("next_start <= end_lba")


def place_partitions(disk: DataFrame, table: str = "gpt", sector: int = 512) -> DataFrame:
    """disk (id, total_lba, parts: array of (name, kind, bytes), null bytes for what remains, last only) to placed partitions.

    A fold over the ordered array, since each start is the aligned end of the one before.
    """
    usable = F.col("total_lba") - (34 if table == "gpt" else 1)
    empty = "cast(array() as array<struct<name:string,kind:string,start_lba:bigint,size_lba:bigint>>)"

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        start = ceil_to(F.coalesce(last["start_lba"] + last["size_lba"], F.lit(ALIGNMENT).cast("long")), ALIGNMENT)
        size = F.coalesce(F.call_function("div", p["bytes"] + (sector - 1), F.lit(sector)), F.col("total_lba") - (34 if table == "gpt" else 1) - start + 1)
        return F.concat(done, F.array(F.struct(p["name"].alias("name"), p["kind"].alias("kind"), start.alias("start_lba"), size.alias("size_lba"))))

    placed = disk.withColumn("_p", F.aggregate("parts", F.expr(empty), step)).withColumn("_usable", usable)
    out = placed.select("id", "_usable", F.posexplode("_p").alias("number", "_q")).select("id", "number", "_q.*", "_usable")
    fits = F.col("start_lba") + F.col("size_lba") - 1 <= F.col("_usable")
    return out.withColumn("fits", fits & (F.col("size_lba") > 0)).drop("_usable")


def slice_of(partitions: DataFrame, number: int, block: int = 512) -> DataFrame:
    """Byte range of partition ``number`` (from 1); an error if there is none."""
    rows = partitions.where(F.col("number") == number - 1).select((F.col("start_lba") * block).alias("offset"), (F.col("size_lba") * block).alias("length"))
    counted = rows.agg(F.max("offset").alias("offset"), F.max("length").alias("length"))
    return counted.select(F.coalesce("offset", F.raise_error(F.lit("no such partition")).cast("long")).alias("offset"), "length")


def partition_kind(text: Column) -> Column:
    """A kind's name from its spelling, a type byte as ``0x83``, or a type identifier."""
    t = F.lower(text)
    out = F.lit(None).cast("string")
    for name, kind in PARTITION_NAMES.items():
        out = F.when(t == name, kind).otherwise(out)
    known = F.lit(None).cast("string")
    for kind, byte, uuid in PARTITION_TYPES:
        if byte is not None:
            known = F.when(t.rlike(f"^0x0*{byte:x}$"), kind).otherwise(known)
        if uuid:
            known = F.when(F.upper(text) == uuid, kind).otherwise(known)
    other = F.when(t.rlike("^0x[0-9a-f]{1,2}$"), F.concat(F.lit("Mbr:"), F.conv(F.substring(t, 3, 2), 16, 10))).when(t.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.concat(F.lit("Gpt:"), F.upper(text)))
    return F.coalesce(out, known, other)


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that are not all zero bytes; the others need not be written."""
    return chunks.where(F.length(F.regexp_replace(F.hex("data"), "0", "")) > 0)


def runs_of_deltas(runs: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Delta-coded runs (seq, length, delta) to first, start and length: start is a running sum; a null delta is sparse and moves nothing."""
    upto = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.sum(F.coalesce("delta", F.lit(0))).over(upto)
    start = F.when(F.col("delta").isNull(), F.lit(None)).when(base < 0, F.raise_error(F.lit("a run starts before 0")).cast("long")).otherwise(base)
    return runs.withColumns({"first": F.coalesce(F.sum("length").over(before), F.lit(0)), "start": start})
