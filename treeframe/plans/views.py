"""The given tables as entry relations, layers, links, blocks and versions, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: /source/lang/id.txt."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "source", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("Regular").alias("kind"), F.col("n_chars").alias("size"), F.lit(420).alias("mode"),
        (F.col("doc_id") % 7).alias("uid"), (F.col("doc_id") % 3).alias("gid"), F.col("doc_id").alias("mtime"), F.col("doc_id").alias("seq"), (F.col("doc_id") + 1).alias("inode"), F.lit(1).cast("long").alias("nlink"),
    )


DOCUMENT_ENTRIES = """files AS (SELECT source, '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, 'Regular' AS kind, n_chars AS size, 420 AS mode,
  doc_id % 7 AS uid, doc_id % 3 AS gid, doc_id AS mtime, doc_id AS seq, doc_id + 1 AS inode, CAST(1 AS BIGINT) AS nlink FROM documents)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and path of each page: the host and what follows it."""
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.rtrim(url, F.lit("/"))).alias("path"), F.octet_length("html").cast("long").alias("size"))


PAGE_PATHS = """pp AS (SELECT page_id, '/' || rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path, CAST(strlen(html) AS BIGINT) AS size FROM pages)"""


def layer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of a log of inserts and removals, from events."""
    e = table(spark, sf_dir, "events")
    d = F.concat(F.lit("/u"), (F.col("user_id") % 20).cast("string"))
    p = F.concat(d, F.lit("/f"), (F.col("event_id") % 50).cast("string"))
    t = F.col("event_type")
    on_dir = (t == "signup") | ((t == "click") & (F.col("event_id") % 97 == 0)) | ((t == "error") & (F.col("event_id") % 11 == 0))
    kind = F.when(t == "signup", "Dir").when((t == "click") & (F.col("event_id") % 97 == 0), "Symlink").when(t != "error", "Regular")
    event = F.when((t == "error") & (F.col("event_id") % 11 == 0), "O").when(t == "error", "X").otherwise("I")
    return e.select((F.col("user_id") % 3).cast("int").alias("layer"), F.col("event_id").alias("seq"), event.alias("event"), F.when(on_dir, d).otherwise(p).alias("path"), kind.alias("kind"), F.abs("value").cast("long").alias("size"))


LAYER_EVENTS = """log AS (SELECT CAST(user_id % 3 AS INTEGER) AS layer, event_id AS seq,
  CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'O' WHEN event_type = 'error' THEN 'X' ELSE 'I' END AS event,
  CASE WHEN event_type = 'signup' OR (event_type = 'click' AND event_id % 97 = 0) OR (event_type = 'error' AND event_id % 11 = 0) THEN '/u' || CAST(user_id % 20 AS VARCHAR)
    ELSE '/u' || CAST(user_id % 20 AS VARCHAR) || '/f' || CAST(event_id % 50 AS VARCHAR) END AS path,
  CASE WHEN event_type = 'signup' THEN 'Dir' WHEN event_type = 'click' AND event_id % 97 = 0 THEN 'Symlink' WHEN event_type <> 'error' THEN 'Regular' END AS kind,
  CAST(trunc(abs(value)) AS BIGINT) AS size FROM events),
logt AS (SELECT *, layer * 1000000000000 + seq AS t FROM log)"""


def link_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each event; those of a user share an inode."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("path"), F.col("user_id").alias("inode"), F.col("event_id").alias("seq"), F.abs("value").cast("long").alias("size"))
    n = e.groupBy("inode").agg(F.count("*").alias("nlink"))
    return e.join(n, "inode").withColumn("kind", F.lit("Regular"))


LINK_ENTRIES = """names AS (SELECT '/e/' || CAST(event_id AS VARCHAR) AS path, user_id AS inode, event_id AS seq, CAST(trunc(abs(value)) AS BIGINT) AS size, count(*) OVER (PARTITION BY user_id) AS nlink FROM events)"""


def block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a file for each user: logical numbers in order, physical ones with holes and jumps."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql.window import Window

    logical = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    b = e.select(F.col("user_id").alias("file"), logical.alias("logical"))
    return b.withColumn("physical", F.when(F.col("logical") % 7 == 6, 0).otherwise(F.col("file") * 100000 + 1 + F.col("logical") + F.expr("(logical div 25) * 1000")))


BLOCK_MAP = """bl0 AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS logical FROM events),
bl AS (SELECT file, logical, CASE WHEN logical % 7 = 6 THEN 0 ELSE file * 100000 + 1 + logical + (logical // 25) * 1000 END AS physical FROM bl0)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(versions of objects, probes of every object at three times)."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("oid"), F.col("event_id").alias("xid"), F.col("value").alias("val"))
    probes = v.select("oid").distinct().withColumn("at", F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 2500, 9000)])))
    return v, probes


def order_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2048).alias("start_lba"), (F.col("o_custkey") * 4 + 1).alias("size_lba"), (F.col("o_custkey") % 5).alias("disk"), F.lit("LinuxFilesystem").alias("kind"), F.col("o_orderkey").alias("number"))
