"""Hard links, surrogate numbers and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from .ordering import kept, numbered

MOST_HOPS = 8


def link_groups(entries: DataFrame, by: tuple[str, ...] = ("inode",)) -> DataFrame:
    """Each entry with link_to: the first path of its inode, null for that one and for files with one name.

    The first is the least path by components. Found by a grouped minimum and a join, so that
    no group has to be sorted in one task.
    """
    place = paths.segments(F.col("path"))
    may = F.coalesce((F.col("kind") == "Regular") & (F.col("inode") != 0) & (F.col("nlink") > 1) & (F.coalesce(F.col("size"), F.lit(1)) > 0), F.lit(False))
    first = entries.where(may).groupBy(*by).agg(F.min(F.struct(place.alias("p"), F.col("path").alias("path"))).getField("path").alias("_first"))
    joined = entries.where(may).join(first, list(by)).select(*entries.columns, F.when(F.col("path") != F.col("_first"), F.col("_first")).alias("link_to"))
    # Files with one name, and all without an inode, take no part in the join.
    return joined.unionByName(entries.where(~may).withColumn("link_to", F.lit(None).cast("string")))


def link_targets(entries: DataFrame) -> DataFrame:
    """Each hard link with its target's kind and size; ``problem`` where that is missing or no file."""
    links = entries.where("kind = 'HardLink'").select("path", paths.normalise_popping(F.col("link_target")).alias("target"))
    files = entries.where("kind <> 'HardLink'").select(F.col("path").alias("target"), F.col("kind").alias("target_kind"), F.col("size").alias("target_size"))
    problem = F.when(F.col("target_kind").isNull(), "missing").when(F.col("target_kind") != "Regular", "not a file")
    return links.join(files, "target", "left").withColumn("problem", problem)


def resolve_links(entries: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """Hard links followed through other hard links, ``hops`` of them at most: path, resolved (null at a dead end), hops.

    Links are joined among themselves, by doubling, and with the other entries once.
    """
    now = entries.where("kind = 'HardLink'").select("path", paths.normalise_keeping(F.col("link_target")).alias("at"), F.lit(1).alias("hops"))
    for _ in range(max(0, (hops - 1).bit_length())):
        far = now.select(F.col("path").alias("at"), F.col("at").alias("_far"), F.col("hops").alias("_more"))
        now = now.join(far, "at", "left").select("path", F.coalesce("_far", "at").alias("at"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))
        now = kept(now)
    files = entries.where("kind <> 'HardLink'").select(F.col("path").alias("at"), F.lit(True).alias("_file"))
    found = F.col("_file") & (F.col("hops") <= hops)
    return now.join(files, "at", "left").select("path", F.when(found, F.col("at")).alias("resolved"), F.when(found, F.col("hops")).alias("hops"))


def last_writes(entries: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """The last entry of each path (or of each path in each layer), with ``slot``, the place of the first."""
    rest = [c for c in entries.columns if c not in by]
    got = entries.groupBy(*by).agg(F.max(F.struct(F.col("seq").alias("_seq"), *rest)).alias("e"), F.min("seq").alias("slot"))
    return got.select(*by, *[F.col(f"e.{c}").alias(c) for c in rest], "slot")


def winners(entries: DataFrame, model: DataFrame) -> DataFrame:
    """Entries that a merged model kept, by path, layer and place in the layer."""
    return entries.join(model.select("path", "layer", "seq"), ["path", "layer", "seq"], "left_semi")


def tombstones_applied(inserts: DataFrame, removals: DataFrame) -> DataFrame:
    """Inserts (path, layer, seq, ...) that no later removal of their very path follows."""
    t = F.struct("layer", "seq")
    latest = removals.groupBy("path").agg(F.max(t).alias("_removed"))
    return inserts.join(latest, "path", "left").where(F.col("_removed").isNull() | (F.col("_removed") <= t)).drop("_removed")


def as_of(versions: DataFrame, probes: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """For each probe (oid, at) the value with the greatest xid up to at; null if there is none.

    An object's versions are dealt by buckets of ``bucket`` numbers. A probe takes the last
    version in its bucket up to it, by one sorted pass, or else the last of the bucket before
    that has any, which is carried over one row for each bucket.
    """
    here = lambda c: F.call_function("div", F.col(c), F.lit(bucket))
    none = F.lit(None)
    v = versions.where("oid is not null and xid is not null").select("oid", here("xid").alias("_b"), F.col("xid").alias("_t"), F.struct("xid", "val").alias("_v"))
    own = Window.partitionBy("oid", "_b").orderBy("_t", F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    p = probes.select("oid", here("at").alias("_b"), F.col("at").alias("_t"), none.cast(v.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_asked"))
    both = v.withColumn("_asked", F.lit(False)).unionByName(p).withColumn("_own", F.last("_v", ignorenulls=True).over(own)).where("_asked")
    last = v.groupBy("oid", "_b").agg(F.max_by("_v", "_t").alias("_last"))
    asked = p.select("oid", "_b").distinct().withColumn("_last", none.cast(v.schema["_v"].dataType))
    before = Window.partitionBy("oid").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(asked).withColumn("_before", F.last("_last", ignorenulls=True).over(before)).groupBy("oid", "_b").agg(F.max("_before").alias("_before"))
    found = both.join(carried, both["oid"].eqNullSafe(carried["oid"]) & both["_b"].eqNullSafe(carried["_b"]), "left").select(both["oid"], F.col("_t").alias("at"), F.coalesce("_own", "_before").alias("_f"))
    return found.select("oid", "at", F.col("_f.xid").alias("xid"), F.col("_f.val").alias("val"))


def number_values(rows: DataFrame, columns: tuple[str, ...] = ("uid", "gid")) -> DataFrame:
    """(value, id): the distinct values of several columns, numbered from 0 in the order first seen.

    Within a row the columns count in the order given. There are at most 65,535 values; more is
    an error.
    """
    seen = rows.select(F.explode(F.array(*[F.struct(F.col("seq"), F.lit(k).alias("k"), F.col(c).cast("long").alias("value")) for k, c in enumerate(columns)])).alias("s"))
    first = seen.groupBy("s.value").agg(F.min(F.struct("s.seq", "s.k")).alias("first"))
    rows = numbered(first, F.col("first"), name="id").select("value", (F.col("id") - 1).alias("id"))
    return rows.withColumn("id", F.when(F.col("id") < 65535, F.col("id")).otherwise(F.raise_error(F.lit("more than 65,535 values"))).cast("int"))


def number_attribute_sets(rows: DataFrame) -> DataFrame:
    """(xattrs, id): whole attribute lists numbered in the order first seen; the empty one is 4294967295."""
    first = rows.where(F.size("xattrs") > 0).groupBy("xattrs").agg(F.min("seq").alias("first"))
    some = numbered(first, F.col("first"), name="id").select("xattrs", (F.col("id") - 1).cast("long").alias("id"))
    return some.unionByName(rows.where(F.size("xattrs") == 0).select("xattrs").limit(1).withColumn("id", F.lit(0xFFFFFFFF).cast("long")))
