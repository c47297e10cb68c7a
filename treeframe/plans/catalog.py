"""Queries over the given tables, one or more for each operator, with equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, display, encodings, hashes, paths
from ..operators import analyze, layout, links, listing, lookups, merge, mutate, ordering
from .. import api
from ..sinks import archives as sinks
from ..sources import archives, detect, files
from ..streaming import layers
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- aggregates

_SIZES = """SELECT {by} count(*) AS files, CAST(0 AS BIGINT) AS dirs, CAST(0 AS BIGINT) AS symlinks, CAST(0 AS BIGINT) AS devices, CAST(0 AS BIGINT) AS hardlinks, CAST(sum(size) AS BIGINT) AS bytes,
  CAST(sum(b + CASE WHEN b <= 12 THEN 0 WHEN b - 12 <= 1024 THEN 1 ELSE 2 + ((b - 12 - 1024) + 1023) // 1024 END) AS BIGINT) AS data FROM (SELECT *, (size + 4095) // 4096 AS b FROM files) {group}"""
_INODES = "((files + 11 + 7) // 8) * 8"
# Fixed parts at a block size of 4096: lost+found 4 blocks, journal 1024 blocks and 1 that points to them, 4 blocks of metadata.
_BLOCKS = "CAST((CAST(greatest(64, ceil(CAST(data + 4 + {j} + 4 + (({i}) * 128 + 4095) // 4096 AS DOUBLE) * 1.1::DOUBLE)) AS BIGINT) + 7) // 8 * 8 AS BIGINT)"


def _analyze_sql(by: str) -> str:
    ext2, ext4 = (_BLOCKS.format(j=j, i=_INODES) for j in (0, 1025))
    g = f"{by}," if by else ""
    return f"""WITH {V.DOCUMENT_ENTRIES}, a AS ({_SIZES.format(by=g, group=f"GROUP BY {by}" if by else "")})
SELECT {g} files, dirs, symlinks, devices, hardlinks, bytes, {_INODES} AS inodes, {ext2} AS ext2_blocks, {ext4} AS ext4_blocks, {ext2} * 4096 AS ext2_size, {ext4} * 4096 AS ext4_size,
  CAST((greatest(bytes * 2, 65525 * 1024) + 511) // 512 * 512 AS BIGINT) AS fat32_size FROM a"""


@query(_analyze_sql(""))
def analyze_documents(spark, sf):
    return analyze.analyze(V.document_entries(spark, sf))


@query(_analyze_sql("source"))
def analyze_by_source(spark, sf):
    return analyze.analyze(V.document_entries(spark, sf), by=("source",))


@query(f"WITH {V.LAYER_EVENTS} SELECT count(*) FILTER (kind = 'Regular') AS files, count(*) FILTER (kind = 'Dir') AS dirs, count(*) FILTER (kind = 'Symlink') AS symlinks, CAST(sum(CASE WHEN kind = 'Regular' THEN size ELSE 0 END) AS BIGINT) AS bytes, (count(*) + 11 + 7) // 8 * 8 AS inodes FROM log WHERE event = 'I'")
def analyze_mixed_kinds(spark, sf):
    return analyze.analyze(V.layer_events(spark, sf).where("event = 'I'"), links_take_inodes=False).select("files", "dirs", "symlinks", "bytes", "inodes")


@query("WITH " + V.DOCUMENT_ENTRIES + ", a AS (SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files) SELECT files, files AS members, bytes, files + 16 AS inodes, (greatest(8388608, bytes + (files + 16) * 4096 + 1048576) + 4095) // 4096 * 4096 AS ext_size, bytes + 16777216 AS other_size FROM a")
def tar_index_size(spark, sf):
    return analyze.archive_sizes(V.document_entries(spark, sf))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT count(*) AS total, count(*) AS files, CAST(0 AS BIGINT) AS hardlinks, CAST(0 AS BIGINT) AS dirs, CAST(0 AS BIGINT) AS symlinks, CAST(0 AS BIGINT) AS devices, CAST(sum(size) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS xattrs, count(DISTINCT source) AS top_level FROM files")
def archive_info(spark, sf):
    return analyze.archive_info(V.document_entries(spark, sf))


@query("WITH " + V.DOCUMENT_ENTRIES + ", a AS (SELECT CAST(sum(size) AS BIGINT) AS bytes FROM files) SELECT bytes, bytes + 33554432 AS iso, bytes + 65536 AS grf, bytes * 2 + 16777216 AS archive, bytes * 2 + 67108864 AS generic FROM a")
def layout_sizes(spark, sf):
    return analyze.layout_sizes(V.document_entries(spark, sf).agg(F.sum("size").alias("bytes")))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT count(*) AS blocks, greatest(count(*) // 4, count(*) * 4096 // 16384) AS inodes FROM files")
def inode_density(spark, sf):
    return analyze.inode_density(V.document_entries(spark, sf).agg(F.count("*").alias("blocks"), F.expr("count(*) div 4").alias("inodes")), 4096)


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT source, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END) AS DOUBLE) / sum(n_chars) AS share FROM documents GROUP BY source")
def progress_fraction(spark, sf):
    e = V.document_entries(spark, sf).groupBy("source").agg(F.sum(F.when(F.col("seq") % 2 == 0, F.col("size")).otherwise(0)).alias("d"), F.sum("size").alias("t"))
    return e.select("source", analyze.progress(F.col("d"), F.col("t"), F.lit(0), F.lit(0)).alias("share"))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT CAST(sum((size + 4095) // 4096 * 4096 - size) AS BIGINT) AS wasted FROM files")
def wasted_space(spark, sf):
    return analyze.wasted(V.document_entries(spark, sf), 4096)


@query("SELECT count(DISTINCT p_brand) AS types, count(*) AS resources, CAST(sum(p_size) AS BIGINT) AS bytes FROM part")
def resource_counts(spark, sf):
    return analyze.resource_counts(V.table(spark, sf, "part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size")))


@query("WITH " + V.DOCUMENT_ENTRIES + ", a AS (SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY source) SELECT source, '{\"files\":' || files || ',\"bytes\":' || bytes || '}' AS report FROM a")
def report_json(spark, sf):
    a = V.document_entries(spark, sf).groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return a.select("source", F.to_json(F.struct("files", "bytes")).alias("report"))


# ---- listing

@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT DISTINCT source AS name FROM files")
def ls_root(spark, sf):
    return analyze.top_level(V.document_entries(spark, sf))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, kind, size FROM files WHERE starts_with(path, '/src1/en/')")
def ls_directory(spark, sf):
    return listing.children(V.document_entries(spark, sf), "/src1/en").select("path", "name", "kind", "size")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT path, '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] AS header, string_split(path, '/')[4] AS name, size FROM files WHERE starts_with(path, '/src2/')")
def ls_recursive(spark, sf):
    return listing.recursive(V.document_entries(spark, sf), "/src2").select("path", "header", "name", "size")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT path, row_number() OVER (ORDER BY string_split(ltrim(path, '/'), '/')) AS place FROM files")
def path_order(spark, sf):
    rows = listing.recursive(V.document_entries(spark, sf), "/")
    return ordering.numbered(rows.select("path", F.col("place").alias("segs")), F.col("segs")).select("path", "place")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT path, kind, mode, uid, gid, size, mtime, nlink, CAST(0 AS BIGINT) AS dev_major, (size + 511) // 512 AS blocks FROM files WHERE path = (SELECT min(path) FROM files)")
def stat_path(spark, sf):
    e = V.document_entries(spark, sf)
    first = e.agg(F.min("path")).first()[0]
    return listing.stat(e, first).select("path", "kind", "mode", "uid", "gid", "size", "mtime", "nlink", "dev_major", "blocks")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT count_if(path = '/src1/en' OR starts_with(path, '/src1/en/')) > 0 AS found FROM files")
def exists_prefix(spark, sf):
    return listing.exists(V.document_entries(spark, sf), "/src1/en")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT '/' || source || '//./' || lang || '/' || doc_id || '.txt' AS asked, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size FROM documents")
def point_lookup(spark, sf):
    e = V.document_entries(spark, sf)
    wanted = V.table(spark, sf, "documents").select(F.concat(F.lit("/"), "source", F.lit("//./"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return listing.lookup(e.select("path", "size"), wanted).select("asked", "path", "size")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS kept FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def skip_reserved(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.concat(F.lit("/a/"), F.when(F.col("event_id") % 5 == 0, "lost+found").otherwise("d"), F.lit("/"), F.col("event_id").cast("string")).alias("path"))
    return listing.without_reserved(e).groupBy("user_id").agg(F.count("*").alias("kept"))


@query(f"WITH {V.LAYER_EVENTS} SELECT kind, count(*) AS n FROM log WHERE kind IN ('Dir', 'Symlink') GROUP BY kind")
def kind_filter(spark, sf):
    return V.layer_events(spark, sf).where("kind in ('Dir', 'Symlink')").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'opaque' WHEN 1 THEN 'delete' END AS action, CASE event_id % 3 WHEN 1 THEN 'f' || event_id END AS target FROM events")
def whiteout_kinds(spark, sf):
    i = F.col("event_id")
    name = F.when(i % 3 == 0, ".wh..wh..opq").when(i % 3 == 1, F.concat(F.lit(".wh.f"), i.cast("string"))).otherwise(F.concat(F.lit("f"), i.cast("string")))
    w = listing.whiteout(name)
    return V.table(spark, sf, "events").select("event_id", w["action"].alias("action"), w["target"].alias("target"))


@query("WITH " + V.PAGE_PATHS + " SELECT page_id, path FROM pp WHERE path = '/' || (SELECT min(string_split(path, '/')[2]) FROM pp) OR starts_with(path, '/' || (SELECT min(string_split(path, '/')[2]) FROM pp) || '/')")
def subtree_pages(spark, sf):
    p = V.page_paths(spark, sf)
    host = p.agg(F.min(F.element_at(F.split("path", "/"), 2))).first()[0]
    return listing.subtree(p, f"/{host}").select("page_id", "path")


@query("SELECT event_id, kind, CASE kind WHEN 'ext' THEN 'Mutable' WHEN 'xfs' THEN 'Mutable' WHEN 'tar' THEN 'Streaming' ELSE 'Immutable' END AS capability, kind IN ('ext', 'xfs') AS add_remove, kind = 'xfs' AS shares_extents, false AS supports_range FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ext' WHEN 1 THEN 'tar' WHEN 2 THEN 'squashfs' WHEN 3 THEN 'xfs' ELSE 'none' END AS kind FROM events)")
def mutability(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("ext", "tar", "squashfs", "xfs", "none")])
    e = V.table(spark, sf, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"))
    return listing.mutability(e).select("event_id", "kind", "capability", "add_remove", "shares_extents", "supports_range")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT count(*) AS entries, 3 AS deepest, true AS safe FROM files")
def walk_limits(spark, sf):
    return listing.checked(V.document_entries(spark, sf))


@query("WITH " + V.PAGE_PATHS + " SELECT page_id, CASE WHEN length(path) <= 16 THEN path ELSE '…' || right(path, 15) END AS shown FROM pp")
def truncate_left(spark, sf):
    return V.page_paths(spark, sf).select("page_id", paths.truncate_left(F.col("path"), 16).alias("shown"))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT CAST(inode AS VARCHAR) || chr(9) || kind || chr(9) || regexp_extract(path, '([^/]*)$', 1) AS line FROM files")
def listing_lines(spark, sf):
    return V.document_entries(spark, sf).select(display.listing_line(F.col("inode"), F.col("kind"), paths.basename(F.col("path"))).alias("line"))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT count(*) AS n, count(*) FILTER (parent_kind IS NULL) AS orphans FROM (SELECT f.path, p.kind AS parent_kind FROM files f LEFT JOIN files p ON p.path = regexp_extract(f.path, '^(.*)/[^/]*$', 1))")
def parent_lookup(spark, sf):
    return listing.parent_of(V.document_entries(spark, sf)).agg(F.count("*").alias("n"), F.count_if(F.col("parent_kind").isNull()).alias("orphans"))


# ---- links and lookups

@query(f"WITH {V.LINK_ENTRIES}, f AS (SELECT inode, min(path) AS p FROM names WHERE nlink > 1 AND size > 0 AND inode <> 0 GROUP BY inode) SELECT path, inode, nlink, CASE WHEN nlink > 1 AND size > 0 AND path <> p THEN p END AS link_to FROM names LEFT JOIN f USING (inode)")
def hardlink_groups(spark, sf):
    return links.link_groups(V.link_entries(spark, sf)).select("path", "inode", "nlink", "link_to")


def _hardlinks(spark, sf):
    """Chains of up to eleven links: event n links to n - 1 unless n % 12 = 0."""
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("i"))
    name = lambda c: F.concat(F.lit("/h/"), c.cast("string"))
    return e.select(name(F.col("i")).alias("path"), F.when(F.col("i") % 12 == 0, "Regular").otherwise("HardLink").alias("kind"), F.when(F.col("i") % 12 != 0, name(F.col("i") - 1)).alias("link_target"), F.col("i").alias("size"), F.col("i").alias("seq"))


@query("WITH e AS (SELECT event_id AS i FROM events) SELECT '/h/' || i AS path, '/h/' || (i - 1) AS target, CASE WHEN (i - 1) % 12 = 0 AND x THEN i - 1 END AS target_size, CASE WHEN (i - 1) % 12 <> 0 OR NOT x THEN 'missing' END AS problem FROM (SELECT i, (i - 1) IN (SELECT i FROM e) AS x FROM e WHERE i % 12 <> 0)")
def hardlink_target(spark, sf):
    return links.link_targets(_hardlinks(spark, sf)).select("path", "target", "target_size", "problem")


@query("WITH e AS (SELECT event_id AS i FROM events) SELECT '/h/' || i AS path, CASE WHEN i % 12 <= 8 AND (i - i % 12) IN (SELECT i FROM e) THEN '/h/' || (i - i % 12) END AS resolved, CASE WHEN i % 12 <= 8 AND (i - i % 12) IN (SELECT i FROM e) THEN CAST(i % 12 AS INTEGER) END AS hops FROM e WHERE i % 12 <> 0")
def hardlink_chain(spark, sf):
    return links.resolve_links(_hardlinks(spark, sf))


@query(f"WITH {V.LAYER_EVENTS} SELECT layer, path, arg_max(kind, t) AS kind, arg_max(size, t) AS size, min(seq) AS slot FROM logt WHERE event = 'I' GROUP BY layer, path")
def last_write_wins(spark, sf):
    return links.last_writes(V.layer_events(spark, sf).where("event = 'I'").drop("event"), by=("layer", "path")).select("layer", "path", "kind", "size", "slot")


@query(f"WITH {V.LAYER_EVENTS}, m AS (SELECT path, arg_max(layer, t) AS layer, arg_max(seq, t) AS seq FROM logt WHERE event = 'I' GROUP BY path) SELECT l.path, l.layer, l.seq, l.kind FROM log l SEMI JOIN m ON l.path = m.path AND l.layer = m.layer AND l.seq = m.seq")
def winner_semi(spark, sf):
    e = V.layer_events(spark, sf).where("event = 'I'")
    top = e.groupBy("path").agg(F.max(F.struct("layer", "seq")).alias("t")).select("path", "t.*")
    return links.winners(e, top).select("path", "layer", "seq", "kind")


@query(f"WITH {V.LAYER_EVENTS} SELECT path, seq FROM logt a WHERE event = 'I' AND NOT EXISTS (SELECT 1 FROM logt b WHERE b.event = 'X' AND b.path = a.path AND b.t > a.t)")
def tombstone_anti(spark, sf):
    e = V.layer_events(spark, sf)
    return links.tombstones_applied(e.where("event = 'I'"), e.where("event = 'X'")).select("path", "seq")


@query("WITH o AS (SELECT DISTINCT user_id AS oid FROM events), p AS (SELECT oid, unnest([100, 2500, 9000]) AS a FROM o) SELECT oid, CAST(a AS BIGINT) AS \"at\", max(event_id) AS xid, arg_max(value, event_id) AS val FROM p LEFT JOIN events ON user_id = oid AND event_id <= a GROUP BY oid, a")
def asof_lookup(spark, sf):
    return links.as_of(*V.versions(spark, sf))


@query("WITH " + V.DOCUMENT_ENTRIES + ", v AS (SELECT uid AS value, seq, 0 AS k FROM files UNION ALL SELECT gid, seq, 1 FROM files), f AS (SELECT value, min([seq, k]) AS first FROM v GROUP BY value) SELECT value, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS id FROM f")
def id_table(spark, sf):
    return links.number_values(V.document_entries(spark, sf))


@query("WITH v AS (SELECT user_id % 6 AS g, event_id AS seq FROM events), f AS (SELECT g, min(seq) AS first FROM v WHERE g > 0 GROUP BY g) SELECT 'user.k' || g AS names, row_number() OVER (ORDER BY first) - 1 AS id FROM f UNION ALL SELECT '' AS names, 4294967295 AS id")
def xattr_sets(spark, sf):
    g = F.col("user_id") % 6
    one = F.array(F.struct(F.concat(F.lit("user.k"), g.cast("string")).alias("name"), F.lit(b"v").alias("value")))
    rows = V.table(spark, sf, "events").select(F.when(g > 0, one).otherwise(F.expr("cast(array() as array<struct<name:string,value:binary>>)")).alias("xattrs"), F.col("event_id").alias("seq"))
    return links.number_attribute_sets(rows).select(F.array_join(mutate.attribute_names(F.col("xattrs")), ",").alias("names"), F.col("id").cast("long").alias("id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'turbo' ELSE '' END AS unknown FROM orders")
def option_keys(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("turbo"), F.lit("1"), F.lit("label"), F.lit("x"))).otherwise(F.create_map(F.lit("label"), F.lit("x"))).alias("options"))
    return lookups.unknown_options(o, ("label", "block_size")).select("o_orderkey", F.array_join("unknown", ",").alias("unknown"))


@query("SELECT (min(o_orderkey)) * 2048 * 512 AS offset, (arg_min(o_custkey, o_orderkey) * 4 + 1) * 512 AS length FROM orders")
def partition_index(spark, sf):
    p = V.order_partitions(spark, sf)
    first = p.agg(F.min("number")).first()[0]
    return layout.slice_of(p, first + 1)


@query("SELECT n_name AS name, upper(n_name) AS asked FROM nation")
def name_collation(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return lookups.folded_lookup(n, n.select(F.upper("name").alias("name")))


# ---- merge

_KILLS = """k0 AS (SELECT path, t, event = 'X' AS self FROM logt WHERE event <> 'I'),
ch AS (SELECT path AS q, t0, t AS t1 FROM (SELECT path, kind, t, lag(kind) OVER w AS was, lag(t) OVER w AS t0 FROM logt WHERE event = 'I' WINDOW w AS (PARTITION BY path ORDER BY t)) WHERE was = 'Dir' AND kind <> 'Dir'),
k AS (SELECT * FROM k0 UNION ALL SELECT q, t1, false FROM ch WHERE NOT EXISTS (SELECT 1 FROM k0 WHERE k0.path = ch.q AND k0.self AND k0.t > t0 AND k0.t < t1)),
li AS (SELECT path, max(t) AS t, arg_max(kind, t) AS kind, arg_max(size, t) AS size FROM logt WHERE event = 'I' GROUP BY path),
live AS (SELECT path, kind, size FROM li WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t > li.t AND ((k.path = li.path AND k.self) OR starts_with(li.path, k.path || '/'))))"""


@query(f"WITH {V.LAYER_EVENTS}, {_KILLS} SELECT * FROM live")
def merge_layers(spark, sf):
    return merge.merge(V.layer_events(spark, sf)).select("path", "kind", "size")


@query(f"WITH {V.LAYER_EVENTS}, {_KILLS} SELECT path, kind FROM live UNION ALL SELECT DISTINCT regexp_extract(path, '^(/[^/]*)/.*$', 1) AS path, 'Dir' AS kind FROM live WHERE path LIKE '/%/%' AND regexp_extract(path, '^(/[^/]*)/.*$', 1) NOT IN (SELECT path FROM live)")
def merge_with_parents(spark, sf):
    return merge.with_parents(merge.merge(V.layer_events(spark, sf)).select("path", "kind", "size")).select("path", "kind")


def _literal(spark, rows):
    return spark.createDataFrame([(0, t, *r) for t, r in enumerate(rows)], "layer int, seq long, event string, path string, kind string")


@query("SELECT * FROM (VALUES ('/etc', 'Dir'), ('/etc/conf', 'Regular')) t(path, kind)")
def merge_whiteout(spark, sf):
    return merge.merge(_literal(spark, [("I", "/etc", "Dir"), ("I", "/etc/conf", "Regular"), ("I", "/etc/keep", "Regular"), ("X", "/etc/keep", None)])).select("path", "kind")


@query("SELECT * FROM (VALUES ('/etc', 'Dir'), ('/etc/c', 'Regular')) t(path, kind)")
def merge_opaque(spark, sf):
    return merge.merge(_literal(spark, [("I", "/etc", "Dir"), ("I", "/etc/a", "Regular"), ("O", "/etc", None), ("I", "/etc/c", "Regular")])).select("path", "kind")


@query("SELECT * FROM (VALUES ('/a', 'Regular', 3), ('/a/b', 'Regular', 2)) t(path, kind, seq)")
def merge_kind_change(spark, sf):
    return merge.merge(_literal(spark, [("I", "/a", "Dir"), ("X", "/a", None), ("I", "/a/b", "Regular"), ("I", "/a", "Regular")])).select("path", "kind", F.col("seq").cast("int").alias("seq"))


@query(f"WITH {V.LAYER_EVENTS}, {_KILLS} SELECT path, row_number() OVER (ORDER BY CASE kind WHEN 'Dir' THEN 0 WHEN 'Regular' THEN 1 ELSE 3 END, string_split(ltrim(path, '/'), '/')) AS place FROM live")
def emission_order(spark, sf):
    e = merge.merge(V.layer_events(spark, sf)).withColumn("link_target", F.lit(None).cast("string"))
    return ordering.numbered(merge.emission(e).select("path", "rank", F.col("place").alias("segs")), F.col("rank"), F.col("segs")).select("path", "place")


@query("WITH " + V.DOCUMENT_ENTRIES + ", p AS (SELECT DISTINCT '/' || source AS path FROM documents UNION SELECT DISTINCT '/' || source || '/' || lang FROM documents) SELECT path FROM p")
def synth_parents(spark, sf):
    return merge.missing_parents(V.document_entries(spark, sf))


@query("WITH " + V.PAGE_PATHS + ", s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM pp) SELECT page_id, unnest(range(1, len(s))) AS depth, '/' || array_to_string(s[1:unnest(range(1, len(s)))], '/') AS ancestor FROM s")
def ancestors(spark, sf):
    p = V.page_paths(spark, sf)
    return p.select("page_id", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "ancestor")).select("page_id", (F.col("depth") + 1).cast("long").alias("depth"), "ancestor")


# ---- order-dependent placement

@query(f"WITH {V.BLOCK_MAP}, r AS (SELECT *, logical - row_number() OVER (PARTITION BY file, physical - logical ORDER BY logical) AS g FROM bl WHERE physical <> 0) SELECT file, min(logical) AS logical, min(physical) AS physical, count(*) AS length FROM r GROUP BY file, physical - logical, g")
def extent_coalesce(spark, sf):
    return layout.extents(V.block_map(spark, sf))


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT path, CAST(coalesce(sum(512 + (size + 511) // 512 * 512) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS header_offset FROM files")
def tar_offsets(spark, sf):
    return layout.member_offsets(V.document_entries(spark, sf)).select("path", "header_offset")


@query("WITH p AS (SELECT o_custkey % 5 AS disk, o_orderkey * 2048 AS s, o_custkey * 4 + 1 AS n FROM orders), l AS (SELECT *, lead(s) OVER (PARTITION BY disk ORDER BY s) AS nx FROM p) SELECT disk, s AS start_lba, s + n - 1 AS end_lba, nx AS next_start FROM l WHERE nx <= s + n - 1")
def partition_overlap(spark, sf):
    return layout.overlaps(V.order_partitions(spark, sf), by=("disk",)).select("disk", "start_lba", "end_lba", "next_start")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS number, CAST(trunc(o_totalprice) AS BIGINT) * 1000 AS b FROM orders),
p AS (SELECT id, number, 2048::BIGINT AS s, (b + 511) // 512 AS n FROM o WHERE number = 0 UNION ALL SELECT o.id, o.number, (p.s + p.n + 2047) // 2048 * 2048, (o.b + 511) // 512 FROM p JOIN o ON o.id = p.id AND o.number = p.number + 1)
SELECT id, CAST(number AS INTEGER) AS number, s AS start_lba, n AS size_lba, s + n - 1 <= 100000000 - 34 AND n > 0 AS fits FROM p""")
def partition_layout(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderkey").alias("k"), F.lit("p").alias("name"), F.lit("LinuxFilesystem").alias("kind"), (F.col("o_totalprice").cast("long") * 1000).alias("bytes")).alias("p"))
    disks = o.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("parts")).withColumn("total_lba", F.lit(100000000).cast("long"))
    return layout.place_partitions(disks).select("id", "number", "start_lba", "size_lba", "fits")


@query("SELECT * FROM (VALUES ('ESP', 'EfiSystem'), ('swap', 'LinuxSwap'), ('0x83', 'LinuxFilesystem'), ('0x1c', 'Mbr:28'), ('basic-data', 'MicrosoftBasicData'), ('what', NULL)) t(spelled, kind)")
def partition_kinds(spark, sf):
    return spark.createDataFrame([(x,) for x in ("ESP", "swap", "0x83", "0x1c", "basic-data", "what")], "spelled string").select("spelled", layout.partition_kind(F.col("spelled")).alias("kind"))


@query("SELECT event_id AS chunk FROM events WHERE event_id % 4 <> 0")
def chunk_sparse(spark, sf):
    i = F.col("event_id")
    c = V.table(spark, sf, "events").select(i.alias("chunk"), F.when(i % 4 == 0, F.unhex(F.repeat(F.lit("00"), 64))).otherwise(F.unhex(F.concat(F.repeat(F.lit("00"), 63), F.lit("0a")))).alias("data"))
    return layout.stored_chunks(c).select("chunk")


@query("""WITH r AS (SELECT user_id AS file, event_id AS seq, 1 + event_id % 9 AS length, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 11 + 1 END AS delta FROM events)
SELECT file, seq, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, CAST(CASE WHEN delta IS NOT NULL THEN sum(coalesce(delta, 0)) OVER (PARTITION BY file ORDER BY seq) END AS BIGINT) AS start, length FROM r""")
def runlist_decode(spark, sf):
    i = F.col("event_id")
    r = V.table(spark, sf, "events").select(F.col("user_id").alias("file"), i.alias("seq"), (i % 9 + 1).alias("length"), F.when(i % 7 != 0, i % 11 + 1).alias("delta"))
    return layout.runs_of_deltas(r).select("file", "seq", "first", "start", "length")


# ---- lookups in a format's own tables

@query("""WITH RECURSIVE l AS (SELECT event_id AS c, CASE WHEN event_id % 50 <> 49 AND event_id + 1 IN (SELECT event_id FROM events) THEN event_id + 1 END AS n FROM events),
w AS (SELECT c AS head, 0::BIGINT AS place, c FROM l WHERE c % 50 = 0 UNION ALL SELECT w.head, w.place + 1, l.n FROM w JOIN l ON w.c = l.c WHERE l.n IS NOT NULL) SELECT head, place, c AS cluster FROM w""")
def chain_walk(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("cluster"))
    nxt = e.select((F.col("cluster") - 1).alias("cluster"), F.col("cluster").alias("_n"))
    rows = e.join(nxt, "cluster", "left").select("cluster", F.when(F.col("cluster") % 50 != 49, F.col("_n")).alias("next"))
    return lookups.chains(rows, rows.where("cluster % 50 = 0").select("cluster"))


@query("""WITH r AS (SELECT DISTINCT event_id % 4000 AS page FROM events) SELECT page, CASE WHEN (page // 64) % 5 <> 0 AND (page % 64) % 3 <> 0 THEN page * 65536 END AS host FROM r""")
def page_map(spark, sf):
    r = V.table(spark, sf, "events").select((F.col("event_id") % 4000).alias("page")).distinct()
    one = spark.range(63).select(F.col("id").alias("index"), F.when(F.col("id") % 5 != 0, F.col("id") + 1).otherwise(0).alias("value"))
    two = spark.range(63 * 64).select((F.expr("id div 64") + 1).alias("table"), (F.col("id") % 64).alias("index"), F.when(F.col("id") % 64 % 3 != 0, F.col("id") * 65536).otherwise(0).alias("value"))
    return lookups.page_map(r, one, two, 64)


@query("SELECT o_orderkey AS node, CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey % 20) * 7 ELSE o_custkey END AS address, o_orderkey % 20 = 0 AS invalid FROM orders")
def nat_overlay(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("address"))
    return lookups.overlaid(o, o.where("node % 10 = 0").select("node", (F.col("node") % 20 * 7).alias("address")))


@query("SELECT l_linenumber AS start_block, l_partkey AS block FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber >= 2")
def extent_range(spark, sf):
    x = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit("data").alias("fork"), F.col("l_linenumber").alias("start_block"), F.col("l_partkey").alias("block"))
    return lookups.extents_from(x, x.agg(F.min("file")).first()[0], "data", 2).select("start_block", "block")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def snapshot_records(spark, sf):
    return lookups.records_of_kind(V.table(spark, sf, "events").withColumn("kind", F.col("event_type")), "view").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def security_lookup(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("security_id"))
    return lookups.with_descriptors(o, V.table(spark, sf, "customer").select(F.col("c_custkey").alias("security_id"), "c_nationkey")).select("o_orderkey", "c_nationkey")


@query("SELECT s_suppkey AS record, s_name AS attribute FROM supplier UNION ALL SELECT c_custkey % 100 AS record, c_name AS attribute FROM customer")
def spilled_attributes(spark, sf):
    return lookups.with_spilled(V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("record"), F.col("s_name").alias("attribute")), V.table(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("base"), F.col("c_name").alias("attribute")))


@query("SELECT DISTINCT event_id % 9 AS n, CASE event_id % 9 WHEN 1 THEN 'user.' WHEN 2 THEN 'system.posix_acl_access' WHEN 3 THEN 'system.posix_acl_default' WHEN 4 THEN 'trusted.' WHEN 6 THEN 'security.' WHEN 7 THEN 'system.' END AS prefix FROM events")
def xattr_namespaces(spark, sf):
    return V.table(spark, sf, "events").select((F.col("event_id") % 9).alias("n")).distinct().select("n", lookups.namespace(F.col("n")).alias("prefix"))


@query("WITH c AS (SELECT o_orderkey * 64 AS start, 1 + o_custkey % 64 AS length, o_custkey AS chunk FROM orders), r AS (SELECT event_id * 37 AS sector FROM events) SELECT sector, chunk FROM r LEFT JOIN c ON sector >= start AND sector < start + length")
def chunk_lookup(spark, sf):
    c = V.table(spark, sf, "orders").select((F.col("o_orderkey") * 64).alias("start"), (F.col("o_custkey") % 64 + 1).alias("length"), F.col("o_custkey").alias("chunk"))
    return lookups.chunk_at(V.table(spark, sf, "events").select((F.col("event_id") * 37).alias("sector")), c).select("sector", "chunk")


# ---- changes

@query("SELECT name, kind, major, minor, mode FROM (SELECT 'tty' || i AS name, 'Char' AS kind, 4 AS major, i AS minor, 400 AS mode FROM generate_series(0, 15) t(i) UNION ALL SELECT 'ttyS' || i, 'Char', 4, 64 + i, 432 FROM generate_series(0, 3) t(i) UNION ALL SELECT d || CASE WHEN p > 0 THEN CAST(p AS VARCHAR) ELSE '' END, 'Block', m, f + p, 432 FROM (VALUES ('hda', 3, 0), ('hdb', 3, 64), ('hdc', 22, 0), ('hdd', 22, 64), ('sda', 8, 0), ('sdb', 8, 16), ('sdc', 8, 32), ('sdd', 8, 48)) t(d, m, f), generate_series(0, 4) g(p) UNION ALL SELECT * FROM (VALUES ('console', 'Char', 5, 1, 384), ('null', 'Char', 1, 3, 438), ('zero', 'Char', 1, 5, 438), ('ptmx', 'Char', 5, 2, 438), ('tty', 'Char', 5, 0, 438), ('fuse', 'Char', 10, 229, 438), ('random', 'Char', 1, 8, 438), ('urandom', 'Char', 1, 9, 438), ('kmsg', 'Char', 1, 11, 420), ('mem', 'Char', 1, 1, 416), ('port', 'Char', 1, 4, 416)))")
def rootdevs(spark, sf):
    return mutate.devices(spark).select("name", "kind", F.col("major").cast("int").alias("major"), F.col("minor").cast("long").alias("minor"), "mode")


@query("SELECT CASE WHEN source = 'src1' THEN '/moved' ELSE '/' || source END || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size FROM documents")
def rename_tree(spark, sf):
    return mutate.rename(V.document_entries(spark, sf), "/src1", "/moved").select("path", "size")


@query("SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size FROM documents WHERE source <> 'src1'")
def remove_tree(spark, sf):
    return mutate.remove_tree(V.document_entries(spark, sf), "/src1").select("path", "size")


@query("SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 3 = 0 THEN 384 ELSE 420 END AS mode, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id % 7 END AS uid FROM documents")
def set_attributes(spark, sf):
    e, d = V.document_entries(spark, sf), F.col("seq")
    patch = e.select("path", F.when(d % 3 == 0, 384).alias("mode"), F.when(d % 2 == 0, d).alias("uid"))
    return mutate.set_attributes(e, patch).select("path", "mode", "uid")


@query("WITH m AS (SELECT min('/' || source || '/' || lang || '/' || doc_id || '.txt') AS p FROM documents) SELECT path, nlink FROM (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN '/' || source || '/' || lang || '/' || doc_id || '.txt' = p THEN 2 ELSE 1 END::BIGINT AS nlink FROM documents, m UNION ALL SELECT '/second' AS path, 2::BIGINT AS nlink)")
def add_hard_link(spark, sf):
    e = V.document_entries(spark, sf)
    return mutate.hard_link(e, e.agg(F.min("path")).first()[0], "/second").select("path", "nlink")


@query("WITH " + V.DOCUMENT_ENTRIES + " SELECT 4096 AS block_size, CAST(1000000000 AS BIGINT) AS blocks, CAST(1000000000 - sum((size + 4095) // 4096) AS BIGINT) AS blocks_free, count(*) AS files FROM files")
def volume_stats(spark, sf):
    return mutate.volume(V.document_entries(spark, sf), 4096, 1000000000)


# ---- detection, journals

@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'gzip' WHEN 1 THEN 'xz' WHEN 2 THEN 'lzma' WHEN 3 THEN 'lz4' WHEN 4 THEN 'zstd' WHEN 5 THEN 'lzo' WHEN 6 THEN 'gzip' END AS by_name, CASE event_id % 8 WHEN 6 THEN 'gzip' WHEN 0 THEN 'gzip' END AS archive FROM events")
def codec_detect(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".tar.gz", ".xz", ".lzma", ".lz4", ".zst", ".lzo", ".TGZ", ".tar")]), (F.col("event_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), suffix)
    return V.table(spark, sf, "events").select("event_id", detect.codec_of_name(name).alias("by_name"), detect.archive_codec(name).alias("archive"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'zip' WHEN 1 THEN 'ar' WHEN 2 THEN '7z' WHEN 3 THEN 'squashfs' WHEN 4 THEN 'tar' WHEN 5 THEN 'arc' END AS format, CASE event_id % 7 WHEN 6 THEN 'gzip' END AS codec FROM events")
def magic_detect(spark, sf):
    heads = ("504B0304", "213C617263683E0A", "377ABCAF271C", "68737173", "00" * 257 + "7573746172", "1A08", "1F8B")
    head = F.unhex(F.element_at(F.array(*[F.lit(x) for x in heads]), (F.col("event_id") % 7 + 1).cast("int")))
    return V.table(spark, sf, "events").select("event_id", detect.file_format(head).alias("format"), detect.codec_of_bytes(head).alias("codec"))


@query("SELECT * FROM (VALUES ('disk.img:2', 'disk.img', 1, 'image'), ('disk.img', 'disk.img', NULL, 'image'), ('a:b', 'a:b', NULL, 'image'), ('a.tar+b.tar', 'a.tar+b.tar', NULL, 'layered'), ('x.tgz', 'x.tgz', NULL, 'compressed tar'), ('x.TAR', 'x.TAR', NULL, 'tar')) t(spec, path, part, kind)")
def target_parse(spark, sf):
    t = spark.createDataFrame([(x,) for x in ("disk.img:2", "disk.img", "a:b", "a.tar+b.tar", "x.tgz", "x.TAR")], "spec string")
    return t.withColumn("t", detect.target(F.col("spec"))).select("spec", "t.path", F.col("t.partition").cast("int").alias("part"), detect.source_kind(F.col("spec")).alias("kind"))


@query("""WITH j AS (SELECT event_id // 10 AS tid, event_id % 10 AS seq, user_id AS block, value AS payload, event_id % 10 = 9 AND (event_id // 10) % 700 <> 699 AS ok FROM events),
d AS (SELECT tid, row_number() OVER (ORDER BY tid) AS n FROM j WHERE ok AND tid >= 1 GROUP BY tid), r AS (SELECT tid FROM d WHERE tid = n)
SELECT block, arg_max(payload, tid * 10 + seq) AS payload FROM j WHERE NOT ok AND tid IN (SELECT tid FROM r) GROUP BY block""")
def journal_replay(spark, sf):
    i = F.col("event_id")
    tid = F.call_function("div", i, F.lit(10))
    j = V.table(spark, sf, "events").select(tid.alias("tid"), (i % 10).alias("seq"), F.col("user_id").alias("block"), F.col("value").alias("payload"), ((i % 10 == 9) & (tid % 700 != 699)).alias("commit"))
    return layers.replay(j, 1)


@query("WITH a AS (SELECT o_orderkey AS k, 'label' || (o_orderkey % 3) AS x, 'block' || (o_orderkey % 5) AS y FROM orders) SELECT k, y || ',' || x AS keys FROM a")
def sorted_options(spark, sf):
    k = F.col("o_orderkey")
    m = F.create_map(F.concat(F.lit("label"), (k % 3).cast("string")), F.lit(1), F.concat(F.lit("block"), (k % 5).cast("string")), F.lit(2))
    return V.table(spark, sf, "orders").select(k.alias("k"), F.array_join(F.map_keys(lookups.sorted_options(m)), ",").alias("keys"))


# Each page's path, and that path behind folders of 60 and of 200 bytes, so that names fit whole, parted, or not at all.
@query("WITH " + V.PAGE_PATHS + """, n AS (SELECT page_id, k, CASE k WHEN 0 THEN '' ELSE repeat('d', k) || '/' END || ltrim(path, '/') AS name FROM pp, (VALUES (0), (60), (200)) f(k))
SELECT page_id, k, name, strlen(name) <= 100 OR len(list_filter(range(2, length(name)), lambda i: substr(name, i, 1) = '/' AND strlen(substr(name, 1, i - 1)) <= 155 AND strlen(substr(name, i + 1)) <= 100)) > 0 AS fits FROM n""")
def member_names(spark, sf):
    p = V.page_paths(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(60), F.lit(200))))
    name = paths.member_name(F.concat(F.when(F.col("k") > 0, F.concat(F.lit("/"), F.expr("repeat('d', k)"))).otherwise(""), F.col("path")))
    return p.select("page_id", "k", name.alias("name"), paths.fits_header(name).alias("fits"))


# ---- archives written from the documents and read back

_ARCHIVED = "SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, 'Regular' AS kind, CAST(strlen(text) AS BIGINT) AS size, doc_id AS mtime, md5(text) AS md5 FROM documents"


def _archive(spark, sf, kind, path=None):
    """The documents as archives, one for each partition of them, in the session's shared folder: the folder."""
    d = V.table(spark, sf, "documents")
    if path is None:
        path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    e = d.select(path.alias("path"), F.lit("Regular").alias("kind"), F.lit(0o644).alias("mode"), F.lit(7).cast("long").alias("uid"), F.col("doc_id").alias("mtime"), F.col("text").cast("binary").alias("data"))
    folder = ordering.new_folder(spark)
    sinks.write(e, folder, kind)
    return folder


def _scanned(spark, sf, kind, path=None):
    folder = _archive(spark, sf, kind, path)
    rows = archives.bodies(spark, archives.scan(spark, folder, kind), folder)
    return rows.select("path", "kind", "size", "mtime", F.md5("data").alias("md5"))


@query(_ARCHIVED)
def scan_tar(spark, sf):
    return _scanned(spark, sf, "tar")


@query(_ARCHIVED)
def scan_cpio(spark, sf):
    return _scanned(spark, sf, "cpio")


@query(_ARCHIVED.replace("doc_id AS mtime", "315532800 AS mtime"))
def scan_zip(spark, sf):
    """Stamps before 1980 are its first second, as zip knows none."""
    return _scanned(spark, sf, "zip").withColumn("mtime", F.col("mtime").cast("int"))


@query(_ARCHIVED.replace("'/' || source || '/' || lang || '/' || doc_id || '.txt'", "'/' || source || '-' || doc_id || ' of the documents.txt'"))
def scan_ar(spark, sf):
    return _scanned(spark, sf, "ar", F.concat(F.lit("/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(" of the documents.txt")))


@query("""WITH d AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id, text FROM documents)
SELECT path, 'Regular' AS kind, md5(CASE WHEN doc_id % 3 = 1 THEN 'new ' || text ELSE text END) AS md5 FROM d WHERE doc_id % 3 <> 2
UNION ALL SELECT DISTINCT '/' || source, 'Dir', NULL FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT DISTINCT '/' || source || '/' || lang, 'Dir', NULL FROM documents WHERE doc_id % 3 <> 2""")
def repack_round_trip(spark, sf):
    """All documents as a layer; a layer on it that replaces a third and takes a third away; both merged, written and read back."""
    d = V.table(spark, sf, "documents")
    folder, i = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/")), F.col("doc_id")
    below = d.select(F.concat(folder, i.cast("string"), F.lit(".txt")).alias("path"), F.lit("Regular").alias("kind"), F.col("text").cast("binary").alias("data"))
    mark = F.when(i % 3 == 2, F.lit(".wh.")).otherwise("")
    above = d.where("doc_id % 3 > 0").select(F.concat(folder, mark, i.cast("string"), F.lit(".txt")).alias("path"), F.lit("Regular").alias("kind"), F.when(i % 3 == 1, F.concat(F.lit("new "), "text")).otherwise("").cast("binary").alias("data"))
    layers, out = [ordering.new_folder(spark) for _ in range(2)], ordering.new_folder(spark)
    for rows, at in zip((below, above), layers, strict=True):
        sinks.write(rows, at, "tar")
    api.repack(spark, layers, out, shards=4)
    found = archives.scan(spark, out)
    files = archives.bodies(spark, found, out).select("path", "kind", F.md5("data").alias("md5"))
    return files.unionByName(found.where("kind = 'Dir'").select("path", "kind", F.lit(None).cast("string").alias("md5")))


@query("""WITH d AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, source, lang, text FROM documents)
SELECT path, 'Regular' AS kind, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM d
UNION ALL SELECT DISTINCT '/' || source, 'Dir', 0, NULL FROM d UNION ALL SELECT DISTINCT '/' || source || '/' || lang, 'Dir', 0, NULL FROM d""")
def scan_folder(spark, sf):
    """All documents as files of a folder, walked level by level and read."""
    d, folder = V.table(spark, sf, "documents"), ordering.new_folder(spark)
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    sinks.spread(d.select(path.alias("path"), F.lit("Regular").alias("kind"), F.col("text").cast("binary").alias("data")), folder)
    found = files.tree(spark, folder)
    read = files.bodies(found).select("path", "kind", "size", F.md5("data").alias("md5"))
    return read.unionByName(found.where("kind = 'Dir'").select("path", "kind", "size", F.lit(None).cast("string").alias("md5")))


# ---- scalar functions

@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN '-' ELSE 'l' END || CASE WHEN m & 256 <> 0 THEN 'r' ELSE '-' END || CASE WHEN m & 128 <> 0 THEN 'w' ELSE '-' END || CASE WHEN m & 2048 <> 0 THEN CASE WHEN m & 64 <> 0 THEN 's' ELSE 'S' END WHEN m & 64 <> 0 THEN 'x' ELSE '-' END || CASE WHEN m & 32 <> 0 THEN 'r' ELSE '-' END || CASE WHEN m & 16 <> 0 THEN 'w' ELSE '-' END || CASE WHEN m & 1024 <> 0 THEN CASE WHEN m & 8 <> 0 THEN 's' ELSE 'S' END WHEN m & 8 <> 0 THEN 'x' ELSE '-' END || CASE WHEN m & 4 <> 0 THEN 'r' ELSE '-' END || CASE WHEN m & 2 <> 0 THEN 'w' ELSE '-' END || CASE WHEN m & 512 <> 0 THEN CASE WHEN m & 1 <> 0 THEN 't' ELSE 'T' END WHEN m & 1 <> 0 THEN 'x' ELSE '-' END AS shown FROM (SELECT event_id, (event_id * 37) % 4096 AS m FROM events)")
def mode_string(spark, sf):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "Dir").when(i % 3 == 1, "Regular").otherwise("Symlink")
    return V.table(spark, sf, "events").select("event_id", display.mode_string(kind, i * 37 % 4096).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS n FROM orders)")
def human_size(spark, sf):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 977
    return V.table(spark, sf, "orders").select("o_orderkey", display.human_size(n).alias("shown"))


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey * 1024 WHEN 2 THEN o_orderkey * 1000000 WHEN 3 THEN o_orderkey * 1024 WHEN 4 THEN o_orderkey * 1099511627776 WHEN 6 THEN o_orderkey * 1073741824 END AS bytes FROM orders")
def parse_size(spark, sf):
    """Every order's number under each unit, one that is none, and one that makes it too large."""
    units = F.array(*[F.lit(u) for u in ("", " KiB", "MB", "k", "TiB", "x", " gib ", "0000000000000GiB")])
    text = F.concat(F.col("o_orderkey").cast("string"), F.element_at(units, (F.col("o_orderkey") % 8 + 1).cast("int")))
    return V.table(spark, sf, "orders").select("o_orderkey", display.parse_size(text).alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS n FROM orders")
def parse_integer(spark, sf):
    """Every order's number as decimal, hexadecimal and binary text, and as none."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("0x"), F.hex(k))).when(k % 4 == 2, F.concat(F.lit("0b"), F.bin(k))).otherwise(F.concat(F.lit("z"), k.cast("string")))
    return V.table(spark, sf, "orders").select("o_orderkey", display.parse_integer(text).alias("n"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 86399 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def unix_iso(spark, sf):
    return V.table(spark, sf, "events").select("event_id", display.unix_iso(F.col("event_id") * 86399).alias("iso"))


@query("SELECT event_id, a AS major, b AS minor, (b & 255) | ((a & 4095) << 8) | ((b & 1048320) << 12) AS device, a AS back_major, b AS back_minor FROM (SELECT event_id, event_id % 4096 AS a, (event_id * 61) % 1048576 AS b FROM events)")
def rdev_codec(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", (F.col("event_id") % 4096).alias("major"), (F.col("event_id") * 61 % 1048576).alias("minor"))
    e = e.withColumn("device", bits.encode_device(F.col("major"), F.col("minor")))
    return e.withColumns({"back_major": bits.device_major(F.col("device")), "back_minor": bits.device_minor(F.col("device"))})


@query("SELECT event_id, CAST(((year(t) - 1980) << 9) | (month(t) << 5) | day(t) AS INTEGER) AS date, CAST((hour(t) << 11) | (minute(t) << 5) | (second(t) // 2) AS INTEGER) AS time, CAST(epoch(t) AS BIGINT) // 2 * 2 AS back FROM (SELECT event_id, make_timestamp((315532800 + event_id * 54321) * 1000000) AS t FROM events)")
def dos_time(spark, sf):
    d = bits.dos_time(F.lit(315532800) + F.col("event_id") * 54321)
    e = V.table(spark, sf, "events").select("event_id", d.alias("d")).select("event_id", "d.*")
    return e.withColumn("back", bits.from_dos_time(F.col("date"), F.col("time")))


@query("SELECT event_id, (event_id + 7) // 8 * 8 AS c8, (event_id + 511) // 512 * 512 AS c512 FROM events")
def ceil_multiples(spark, sf):
    return V.table(spark, sf, "events").select("event_id", bits.ceil_to(F.col("event_id"), 8).alias("c8"), bits.ceil_to(F.col("event_id"), 512).alias("c512"))


@query("SELECT event_id, event_id AS back FROM events")
def octal_fields(spark, sf):
    return V.table(spark, sf, "events").select("event_id", bits.parse_octal(F.concat(F.lpad(F.conv(F.col("event_id").cast("string"), 10, 8), 11, "0"), F.lit(" "))).alias("back"))


@query("SELECT event_id, CASE WHEN event_id % 40 + 2 < 31 THEN CAST(1 AS BIGINT) << (event_id % 40 + 2) ELSE 1073741824 END AS buckets FROM events")
def bucket_arithmetic(spark, sf):
    return V.table(spark, sf, "events").select("event_id", bits.hash_buckets(F.col("event_id") % 40, F.lit(2)).cast("long").alias("buckets"))


@query("SELECT * FROM (VALUES ('../../etc/passwd', '/etc/passwd', '/etc/passwd', '/../../etc/passwd'), ('a/../b', '/b', '/a/b', '/a/../b'), ('./a/./b/', '/a/b', '/a/b', '/a/b'), ('/a/b/../../..', '/', '/a/b', '/a/b/../../..'), ('///', '/', '/', '/')) t(path, popping, dropping, keeping)")
def path_normalise(spark, sf):
    p = spark.createDataFrame([(x,) for x in ("../../etc/passwd", "a/../b", "./a/./b/", "/a/b/../../..", "///")], "path string")
    return p.select("path", paths.normalise_popping(F.col("path")).alias("popping"), paths.normalise_dropping(F.col("path")).alias("dropping"), paths.normalise_keeping(F.col("path")).alias("keeping"))


@query("WITH " + V.PAGE_PATHS + " SELECT page_id, CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM pp")
def path_parts(spark, sf):
    p = F.col("path")
    return V.page_paths(spark, sf).select("page_id", paths.parent(p).alias("parent"), paths.basename(p).alias("name"), paths.depth(p).alias("depth"))


@query("SELECT * FROM (VALUES ('hfs', ':Apps:A/ROSE Includes', '/Apps/A:ROSE Includes', ':Apps:A/ROSE Includes'), ('ntfs', '\\Users\\x', '/Users/x', '\\Users\\x'), ('ext', '/a/b', '/a/b', '/a/b')) t(kind, native, canonical, shown)")
def path_styles(spark, sf):
    p = spark.createDataFrame([("hfs", ":Apps:A/ROSE Includes"), ("ntfs", "\\Users\\x"), ("ext", "/a/b")], "kind string, native string")
    return p.withColumn("canonical", paths.to_canonical(F.col("native"), F.col("kind"))).withColumn("shown", paths.display_path(F.col("canonical"), F.col("kind")))


@query("SELECT doc_id, '\"' || source || '\"' AS plain, '<2 bytes> 00 ff' AS raw FROM documents")
def attribute_values(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", display.attribute_value(F.concat("source", F.lit("\n")).cast("binary")).alias("plain"), display.attribute_value(F.unhex(F.lit("00ff"))).alias("raw"))


@query("SELECT p_partkey, rpad(upper(p_brand), 11, ' ') AS label, rpad(left(p_type, 4), 4, ' ') AS type, CAST(p_partkey % 100 AS SMALLINT) AS id FROM part")
def labels_and_selectors(spark, sf):
    s = display.resource_selector(F.concat(F.left("p_type", F.lit(4)), F.lit(":"), (F.col("p_partkey") % 100).cast("string")))
    return V.table(spark, sf, "part").select("p_partkey", display.volume_label(F.col("p_brand")).alias("label"), s["type"].alias("type"), s["id"].alias("id"))


@query("SELECT event_id, printf('%08X', event_id) AS raw, event_id AS little, event_id AS big FROM events")
def byte_order(spark, sf):
    h = F.lpad(F.hex("event_id"), 8, "0")
    swapped = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return V.table(spark, sf, "events").select("event_id", h.alias("raw"), encodings.little(F.unhex(swapped), 0, 4).alias("little"), encodings.big(F.unhex(h), 0, 4).alias("big"))


@query("SELECT 'C12A7328-F81F-11D2-BA4B-00A0C93EC93B' AS id")
def mixed_uuid(spark, sf):
    return spark.range(1).select(encodings.mixed_uuid(F.unhex(F.lit("28732AC11FF8D211BA4B00A0C93EC93B"))).alias("id"))


@query()
def checksums(spark, sf):
    """The folds and checksums over names and texts; SQL has none of them."""
    i = F.col("doc_id").cast("string")
    d = V.table(spark, sf, "documents").select("doc_id", F.concat(i, F.lit(".txt")).cast("binary").alias("name"), F.concat(F.rpad(i, 8, " "), F.lit("TXT")).cast("binary").alias("short"), F.col("text").cast("binary").alias("b"))
    b, name = F.col("b"), F.col("name")
    return d.select(
        "doc_id", hashes.crc32(b).alias("crc32"), hashes.short_name_checksum(F.col("short")).alias("short_name"), hashes.directory_name_hash(name).alias("directory"), hashes.attribute_name_hash(name).alias("attribute"),
        hashes.rotate_add16(b).alias("rotate16"), hashes.rotate_add32(b).alias("rotate32"), hashes.descriptor_hash(b).alias("descriptor"),
    )


@query()
def name_hashes(spark, sf):
    """Hashes that need tables or unsigned products, in vectorised Python."""
    p = V.page_paths(spark, sf).select("page_id", paths.basename(F.col("path")).alias("name"))
    return p.select("page_id", hashes.tea_hash("name").alias("tea"), hashes.half_md4_hash("name").alias("half_md4"), hashes.drec_hash("name").alias("drec"), hashes.crc32c(F.col("name").cast("binary")).alias("crc32c"))
