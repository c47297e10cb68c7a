"""Layered merge: ordered logs of inserts and removals become one tree.

An event is (layer, seq, event, path, kind, ...): I puts an entry, X removes a path and all
below it, O removes all strictly below. Putting something else where a live directory stood
removes what was below that. Instead of replaying events in order, each path's last insert is
kept unless a later removal of it or of an ancestor exists: one grouped maximum, and one
equi-join on exploded ancestors. Only removals by a change of kind depend on each other, and
only down a path, so they are settled depth by depth, for the depths that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from .links import last_writes, resolve_links
from .listing import whiteout


def _time() -> Column:
    return F.struct("layer", "seq")


def events_of(entries: DataFrame) -> DataFrame:
    """Events of archive layers: marker names and 0/0 devices remove, all else inserts.

    Members of one name in a layer count once, with the last one's values in the first one's place.
    """
    rest = [c for c in entries.columns if c not in ("layer", "path", "seq")]
    one = entries.groupBy("layer", "path").agg(F.max(F.struct("seq", *rest)).alias("e"), F.min("seq").alias("slot"))
    one = one.select("layer", F.col("slot").alias("seq"), paths.normalise_keeping(F.col("path")).alias("path"), *[F.col(f"e.{c}").alias(c) for c in rest])
    mark = whiteout(paths.basename(F.col("path")))
    device = (F.col("kind") == "Char") & (F.col("dev_major") == 0) & (F.col("dev_minor") == 0) if "dev_major" in entries.columns else F.lit(False)
    up = F.coalesce(paths.parent(F.col("path")), F.lit("/"))
    out = one.withColumn("_m", mark).withColumn("event", F.when(F.col("_m.action") == "opaque", "O").when((F.col("_m.action") == "delete") | device, "X").otherwise("I"))
    # A delete marker without a name removes its own directory.
    target = F.when(F.col("_m.action") == "opaque", up).when(F.col("_m.action") == "delete", F.when(F.col("_m.target") == "", up).otherwise(paths.join(up, F.col("_m.target")))).otherwise(F.col("path"))
    return out.withColumn("path", target).drop("_m")


def _lineage(path: Column) -> Column:
    """(path, own): a path itself, its ancestors and the root, to be matched with removals."""
    up = F.transform(paths.ancestors(path), lambda a: F.struct(a.alias("path"), F.lit(False).alias("own")))
    root = F.when(path != "/", F.array(F.struct(F.lit("/").alias("path"), F.lit(False).alias("own")))).otherwise(F.expr("cast(array() as array<struct<path:string,own:boolean>>)"))
    return F.concat(F.array(F.struct(path.alias("path"), F.lit(True).alias("own"))), up, root)


def _alive(spans: DataFrame, kills: DataFrame) -> DataFrame:
    """Rows of spans (q, t0, t1) for which no removal of q falls between t0 and t1."""
    keyed = spans.withColumn("_l", F.explode(_lineage(F.col("q")))).select("q", "t0", "t1", F.col("_l.path").alias("_at"), F.col("_l.own").alias("_own"))
    hit = keyed.join(kills, F.col("_at") == F.col("kpath")).where((F.col("kt") > F.col("t0")) & (F.col("kt") < F.col("t1")) & (~F.col("_own") | F.col("kself")))
    return spans.join(hit.select("q", "t0", "t1").distinct(), ["q", "t0", "t1"], "left_anti")


def merge(events: DataFrame) -> DataFrame:
    """The surviving inserts, with their columns; parents are not made up (see with_parents)."""
    inserts = events.where("event = 'I'").drop("event").withColumn("_t", _time())
    kills = events.where("event <> 'I'").select(F.col("path").alias("kpath"), _time().alias("kt"), (F.col("event") == "X").alias("kself"))

    before = Window.partitionBy("path").orderBy("_t")
    steps = inserts.select("path", "kind", "_t", F.lag("kind").over(before).alias("_was"), F.lag("_t").over(before).alias("t0"))
    changes = steps.where("_was = 'Dir' and kind <> 'Dir'").select(F.col("path").alias("q"), "t0", F.col("_t").alias("t1"))
    depths = [r[0] for r in changes.select(paths.depth(F.col("q"))).distinct().collect()]  # at most the depth of the tree
    for d in sorted(depths):
        live = _alive(changes.where(paths.depth(F.col("q")) == d), kills)
        kills = kills.unionByName(live.select(F.col("q").alias("kpath"), F.col("t1").alias("kt"), F.lit(False).alias("kself")))

    rest = [c for c in inserts.columns if c not in ("path", "_t")]
    last = inserts.groupBy("path").agg(F.max(F.struct("_t", *rest)).alias("e")).select("path", F.col("e._t").alias("_t"), *[F.col(f"e.{c}").alias(c) for c in rest])
    latest = kills.groupBy("kpath").agg(F.max("kt").alias("kt"), F.max(F.when(F.col("kself"), F.col("kt"))).alias("kt_self"))
    # Removals meet the distinct directories, not every path under them; those of the root are one row.
    last = last.withColumn("_dir", F.coalesce(paths.parent(F.col("path")), F.lit("/")))
    up = last.where("_dir <> '/'").select("_dir").distinct().select("_dir", F.explode(F.concat(F.array("_dir"), paths.ancestors(F.col("_dir")))).alias("kpath"))
    above = up.join(latest.select("kpath", "kt"), "kpath").groupBy("_dir").agg(F.max("kt").alias("_above"))
    root = latest.where("kpath = '/'").agg(F.max("kt").alias("_root"))
    out = last.join(above, "_dir", "left").join(latest.select(F.col("kpath").alias("path"), F.col("kt_self").alias("_self")), "path", "left").crossJoin(F.broadcast(root))
    dead = (F.col("_above") > F.col("_t")) | (F.col("_self") > F.col("_t")) | ((F.col("path") != "/") & (F.col("_root") > F.col("_t")))
    return out.where(~F.coalesce(dead, F.lit(False))).select("path", *rest)


def missing_parents(entries: DataFrame) -> DataFrame:
    """Ancestors (path) that no entry stands at."""
    up = entries.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return up.join(entries.select("path").distinct(), "path", "left_anti")


def with_parents(entries: DataFrame) -> DataFrame:
    """entries and a directory, mode 0755 and time 0, for each missing ancestor; other ancestors stay what they are."""
    made = {"kind": F.lit("Dir"), "mode": F.lit(0o755), "uid": F.lit(0).cast("long"), "gid": F.lit(0).cast("long"), "mtime": F.lit(0).cast("long"), "size": F.lit(0).cast("long")}
    types = {f.name: f.dataType for f in entries.schema.fields}
    rows = missing_parents(entries).select("path", *[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in entries.columns if c != "path"])
    return entries.unionByName(rows.select(*entries.columns))


def emission(entries: DataFrame) -> DataFrame:
    """The order in which a merged tree is written, as columns to sort by: ``rank`` and ``place``.

    Directories by path; then files in the order of their layers; then hard links whose target
    survives; then symbolic links and devices by path. Dead links go.
    """
    live = resolve_links(entries).where("resolved is not null").select("path")
    links = F.col("kind") == "HardLink"
    kept = entries.where(~links).unionByName(entries.where(links).join(live, "path", "left_semi").select(*entries.columns)).where("path <> '/'")
    rank = F.when(F.col("kind") == "Dir", 0).when(F.col("kind") == "Regular", 1).when(links, 2).otherwise(3)
    return kept.withColumns({"rank": rank, "place": paths.segments(F.col("path"))})


def concatenated(*layers: DataFrame) -> DataFrame:
    """Layers from the bottom up as one relation; each gets its number."""
    out = layers[0].withColumn("layer", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        out = out.unionByName(layer.withColumn("layer", F.lit(k)), allowMissingColumns=True)
    return out


def merge_archives(entries: DataFrame) -> DataFrame:
    """Archive layers (layer, seq, path, kind, ...) to a whole tree."""
    return with_parents(merge(events_of(entries)))


__all__ = ["concatenated", "emission", "events_of", "last_writes", "merge", "merge_archives", "missing_parents", "with_parents"]
