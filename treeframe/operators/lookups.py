"""Lookups that formats make in their own tables, as joins over those tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import kept

PACKED = 1 << 62  # of a page's entry: its bytes are compressed
# Attribute name spaces by number.
NAMESPACES = {1: "user.", 2: "system.posix_acl_access", 3: "system.posix_acl_default", 4: "trusted.", 6: "security.", 7: "system."}


def chains(links: DataFrame, heads: DataFrame, rounds: int = 40) -> DataFrame:
    """(head, place, cluster) of chains through links (cluster, next); next null ends one.

    Pointers are doubled: after k rounds each cluster knows the one 2**k steps on, so a chain of
    n clusters takes log2(n) joins, not n. A link to a cluster that is not there is an error, and
    so is a chain that goes on for more steps than there are clusters, which is a cycle.
    """
    most = links.count()
    known = links.select("cluster", F.col("next").alias("to"))
    reached = heads.select(F.col("cluster").alias("head"), F.lit(0).cast("long").alias("place"), "cluster")
    step = 1
    for _ in range(rounds):
        more = kept(reached.join(known, "cluster").where("to is not null").select("head", (F.col("place") + step).alias("place"), F.col("to").alias("cluster")))
        if more.isEmpty():
            bad = reached.join(links.select("cluster"), "cluster", "left_anti")
            return reached if bad.isEmpty() else reached.withColumn("cluster", F.raise_error(F.lit("a chain leaves the table")).cast("long"))
        if step > most:
            break
        reached = reached.unionByName(more)
        twice = known.select("cluster", F.col("to").alias("_mid")).join(known.select(F.col("cluster").alias("_mid"), F.col("to").alias("_far")), "_mid", "left")
        known, step = kept(twice.select("cluster", F.col("_far").alias("to"))), step * 2
    raise ValueError("a chain is longer than its table; it has a cycle")


def page_map(requests: DataFrame, first: DataFrame, second: DataFrame, per_page: int) -> DataFrame:
    """Host offset of each requested guest page by a two-level table; 0 or nothing at either level is unallocated (null).

    A page whose entry has the bit of compressed ones is an error.
    """
    r = requests.withColumns({"l1": F.call_function("div", F.col("page"), F.lit(per_page)), "l2": F.col("page") % per_page})
    one = first.where("value <> 0").select(F.col("index").alias("l1"), F.col("value").alias("_table"))
    two = second.where("value <> 0").select(F.col("table").alias("_table"), F.col("index").alias("l2"), F.col("value").alias("host"))
    packed = F.raise_error(F.concat(F.lit("a compressed page: "), F.col("page").cast("string"))).cast("long")
    host = F.when(F.col("host").bitwiseAND(F.lit(PACKED)) != 0, packed).otherwise(F.col("host"))
    return r.join(one, "l1", "left").join(two, ["_table", "l2"], "left").select("page", host.alias("host"))


def page_bytes(pages: DataFrame, store: DataFrame, size: int) -> DataFrame:
    """Pages of page_map with ``data``: the store's (offset, data) bytes, zeros for what is unallocated."""
    held = store.select(F.col("offset").alias("host"), F.col("data").alias("_data"))
    lost = F.raise_error(F.concat(F.lit("no bytes at "), F.col("host").cast("string"))).cast("binary")
    data = F.when(F.col("host").isNull(), F.lit(bytes(size))).when(F.col("_data").isNull(), lost).otherwise(F.col("_data"))
    # Unallocated pages take no part in the join, so that they are not one key.
    there = pages.where("host is not null").join(held, "host", "left")
    return there.unionByName(pages.where("host is null").withColumn("_data", F.lit(None).cast("binary"))).select("page", "host", data.alias("data"))


def overlaid(base: DataFrame, journal: DataFrame) -> DataFrame:
    """Addresses with a journal's first: a node there is taken from it even if 0, which is an error."""
    j = journal.select("node", F.col("address").alias("_j"), F.lit(True).alias("_in"))
    both = base.select("node", F.col("address").alias("_b")).join(j, "node", "full")
    return both.select("node", F.when(F.col("_in"), F.col("_j")).otherwise(F.col("_b")).alias("address"), (F.coalesce("_in", F.lit(False)) & (F.col("_j") == 0)).alias("invalid"))


def extents_from(extents: DataFrame, file: int, fork: str, block: int) -> DataFrame:
    """A file's extents from a block on, in order."""
    return extents.where((F.col("file") == file) & (F.col("fork") == fork) & (F.col("start_block") >= block)).orderBy("start_block")


def records_of_kind(catalogue: DataFrame, kind: str) -> DataFrame:
    return catalogue.where(F.col("kind") == kind)


def with_descriptors(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with the place of their security descriptor."""
    return files.join(index, "security_id", "left")


def with_spilled(base: DataFrame, extension: DataFrame) -> DataFrame:
    """A record's attributes, its own and those in the records it points to."""
    return base.select("record", "attribute").unionByName(extension.select(F.col("base").alias("record"), "attribute"))


def folded_lookup(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names that equal a wanted one in upper case."""
    return names.withColumn("_f", F.upper("name")).join(wanted.select(F.upper("name").alias("_f"), F.col("name").alias("asked")), "_f").drop("_f")


def namespace(number):
    out = F.lit(None).cast("string")
    for k, v in NAMESPACES.items():
        out = F.when(number == k, v).otherwise(out)
    return out


def namespace_number(name):
    out = F.lit(0)
    for k, v in sorted(NAMESPACES.items(), key=lambda kv: len(kv[1])):
        out = F.when(F.startswith(name, F.lit(v)) if v.endswith(".") else name == v, k).otherwise(out)
    return out


def unknown_options(options: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Keys of each row's ``options`` map that nothing takes."""
    return options.withColumn("unknown", F.array_sort(F.array_except(F.map_keys("options"), F.array(*[F.lit(k) for k in known]))))


def sorted_options(options):
    """An options map with its entries in the order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(options)))


def chunk_at(requests: DataFrame, chunks: DataFrame, bucket: int = 1024) -> DataFrame:
    """Each requested sector with the chunk (start, length, ...) that holds it; null if none does.

    A range join made equal: a chunk is listed under every bucket of sectors that it touches, and
    a sector looks in its own.
    """
    b = F.lit(bucket)
    listed = chunks.withColumn("_b", F.explode(F.sequence(F.call_function("div", F.col("start"), b), F.call_function("div", F.col("start") + F.col("length") - 1, b))))
    asked = requests.withColumn("_b", F.call_function("div", F.col("sector"), b))
    hit = (asked["_b"] == listed["_b"]) & (F.col("sector") >= F.col("start")) & (F.col("sector") < F.col("start") + F.col("length"))
    return asked.join(listed, hit, "left").drop("_b")


def _pascal(data, at):
    """(text, place after it) of the Pascal string at a place (from 0); null if it runs past the end."""
    from ..functions.encodings import mac_roman

    size = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
    whole = (at < F.octet_length(data)) & (at + 1 + size <= F.octet_length(data))
    text = F.regexp_replace(mac_roman(F.substring(data, at + 2, size)), "[\\x00-\\x1f]", " ")
    return F.when(whole, text), F.when(whole, at + 1 + size)


def resource_summary(kind, data):
    """A line about a resource by its type; null for a type that is not told apart, or data too short for its type."""
    from ..functions.encodings import mac_roman

    def quoted(text):
        return F.concat(F.lit('"'), text, F.lit('"'))

    count = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    short, after = _pascal(data, F.lit(6))
    long = _pascal(data, after)[0]
    version = F.when(short.isNotNull(), quoted(F.when(F.coalesce(long, F.lit("")) == "", short).otherwise(long)))
    shown, at = [], F.lit(2)
    for k in range(4):
        text, at = _pascal(data, at)
        shown.append(F.when(count > k, quoted(text)))
    more = F.when(count > F.size(F.array_compact(F.array(*shown))), ", …").otherwise("")
    strings = F.when(F.octet_length(data) >= 2, F.concat(count.cast("string"), F.lit(" strings: "), F.concat_ws(", ", *shown), more))
    head = F.regexp_replace(mac_roman(F.substring(data, 1, 48)), "[\\x00-\\x1f]", " ")
    text = F.concat(F.lit('"'), head, F.when(F.octet_length(data) > 48, "…").otherwise(""), F.lit('" ('), F.octet_length(data).cast("string"), F.lit(" bytes)"))
    # The count is one less than the items, and 65535 stands for none.
    items = F.when(F.octet_length(data) >= 2, F.concat((F.when(count > 32767, count - 65536).otherwise(count) + 1).cast("string"), F.lit(" items")))
    known = {"vers": version, "STR ": quoted(_pascal(data, F.lit(0))[0]), "STR#": strings, "TEXT": text, "ICN#": F.lit("32×32 1-bit icon (+ mask)"), "ICON": F.lit("32×32 1-bit icon"), "DITL": items}
    out = F.lit(None).cast("string")
    for name, line in known.items():
        out = F.when(kind == name, line).otherwise(out)
    return out
