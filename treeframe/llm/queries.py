"""One query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, near_join, norm_topk, packing, pii, quality, suffix_dedup, tokens, toxicity
from .common import documents_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(documents_of(spark, sf_dir))


def op2_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return licenses.scan(docs, licenses.train(docs))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.classes(documents_of(spark, sf_dir)).drop("text_key")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents_of(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents_of(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), usable=lambda i: _fold(i) != 2)
    return toxicity.score(docs, model, 0.3).select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents_of(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good; kept from grade 1 up."""
    docs = documents_of(spark, sf_dir)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), grade, keep_from=1)
    return quality.score(docs, model)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents_of(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
k AS (SELECT doc_id, s, md5(array_to_string(s, '|')) AS k FROM s),
r AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, any_value(s) AS s FROM k WHERE len(s) > 0 GROUP BY k),
g AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE c * 5 >= 4 * (n + m - c)),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a),
links AS (SELECT l.a AS rep, sum(r.copies) AS n FROM l JOIN r ON l.b = r.rep GROUP BY 1)
SELECT k.doc_id, coalesce(root.root, k.doc_id) AS class_id, CAST(CASE WHEN r.rep IS NULL THEN 0 ELSE coalesce(links.n, 0) + r.copies - 1 END AS BIGINT) AS n_links
FROM k LEFT JOIN r ON k.k = r.k AND len(k.s) > 0 LEFT JOIN root ON r.rep = root.rep LEFT JOIN links ON r.rep = links.rep
"""

# Texts in hexadecimal, cut into slices that overlap by a window, so that no offset is far into a string.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, len(h) // 2, 250)) AS base FROM d),
q AS (SELECT doc_id, base, substr(h, 2 * base + 1, 698) AS part FROM c),
p AS (SELECT doc_id, base, part, unnest(range(0, least(len(part) // 2, 250))) AS j FROM q),
b AS (SELECT doc_id, base + j AS i, substr(part, 2 * j + 1, 2) AS b, CASE WHEN 2 * j + 200 <= len(part) THEN md5(substr(part, 2 * j + 1, 200)) END AS w FROM p),
f AS (SELECT w, min([doc_id, i]) AS first FROM b WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
s AS (SELECT b.doc_id, b.i, b.b, f.first < [b.doc_id, b.i] AS later FROM b LEFT JOIN f USING (w)),
m AS (SELECT doc_id, i, b, coalesce(max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 100, false) AS gone FROM s),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, grams.n AS n, item FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_token_output, op2_norm_topk, op3_license_scan, op4_ngram_jaccard_join, op5_packing, op6_suffix_dedup, op7_toxicity, op8_pii, op9_quality, op10_decontamination)}
ORACLE_SQL = {"op2_norm_topk": OP2_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op10_decontamination": OP10_SQL}
