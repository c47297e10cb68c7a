"""Packing: optimal length buckets and token-budget batches.

Every whole text is tokenised and its length, with an end id, rounded up to a multiple of
``multiple``. A dynamic programme over the histogram of all lengths picks at most ``buckets``
boundaries with the least padding in total. Lengths over FINE multiples share a histogram entry
with those of the same 64th of a power of two, so that it has a bounded number of entries for
any data; an entry stands for its longest, so the padding is over the optimum by less than a
64th of the tokens in such documents, and not at all for shorter ones. Each bucket is cut into batches
of budget // boundary documents (one, if a document alone is over the budget), in the order of
doc_id. Documents are numbered within a bucket by counts of sorted partitions, so no bucket has
to fit a task.

Defined results: a null or empty text has length 1; null ids come first; repeated rows are
packed each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shuffle_partitions, stash
from .tokens import default_tokenizer, encoded, encoder_of

FINE = 4096


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens, the ids of the whole text and an end id."""
    tokenizer = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encoder = encoder_of(tokenizer)
        for batch in batches:
            sizes = [np.diff(bounds) + 1 for _, _, _, bounds in encoded(batch.column(1), encoder)]
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the lengths, the largest among them, with the least sum of boundary times count."""
    order = np.argsort(lengths)
    b, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(b)
    if n <= buckets:
        return b.tolist()
    total = np.concatenate([[0], np.cumsum(c)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(buckets):
        new, choice = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] - b[j - 1] * total[:j]
            i = int(np.argmin(cost))
            value = cost[i] + b[j - 1] * total[j]
            if value < new[j] or best[j] > np.iinfo(np.int64).max // 8:
                new[j], choice[j] = value, i
        best = new
        back.append(choice)
    cuts, j = [], n
    for choice in reversed(back):
        if choice[j] >= 0:
            cuts.append(int(b[j - 1]))
            j = int(choice[j])
        if j == 0:
            break
    return sorted(cuts)


def _entry(size, multiple: int):
    grain = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 6).cast("long")
    return F.when(size <= FINE * multiple, size).otherwise(F.call_function("ceil", size / grain).cast("long") * grain).cast("long")


def pack(docs: DataFrame, buckets: int = 16, budget: int = 1 << 16, multiple: int = 8, tokenizer: str | None = None) -> DataFrame:
    """Each row of docs as (doc_id, n_tokens, bucket, padded_tokens, batch, slot)."""
    size = F.expr(f"((n_tokens + {multiple - 1}) div {multiple}) * {multiple}")
    lengths = stash(token_lengths(docs, tokenizer).withColumn("_size", size), "lengths")
    histogram = lengths.groupBy(_entry(F.col("_size"), multiple).alias("_entry")).agg(F.max("_size").alias("_size"), F.count("*").alias("n")).collect()  # a bounded number of entries
    cuts = boundaries([r["_size"] for r in histogram], [r["n"] for r in histogram], buckets) if histogram else [multiple]
    bucket = F.lit(len(cuts) - 1)
    for k in range(len(cuts) - 2, -1, -1):
        bucket = F.when(F.col("_size") <= cuts[k], k).otherwise(bucket)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    rows = lengths.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"))
    order = [F.col("bucket"), F.asc_nulls_first("doc_id"), F.col("n_tokens")]
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = stash(rows.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part", "bucket").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_at") - F.col("_first")
    padded = F.get(edges, F.col("bucket"))
    per_batch = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div _padded"))
    out = rows.join(parts, ["_part", "bucket"]).withColumn("_padded", padded).withColumn("_number", number).withColumn("_per", per_batch)
    return out.select("doc_id", "n_tokens", "bucket", F.col("_padded").alias("padded_tokens"), F.expr("_number div _per").alias("batch"), F.expr("cast(_number % _per as int)").alias("slot"))
