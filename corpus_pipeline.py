"""A corpus from raw documents to packed batches, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes
each result as Parquet in the shared folder and reads it again. All stages but the last return
the columns of documents, with n_chars set anew where the text changed.

Documents that the toxicity stage rejects go; of near duplicates (five-word shingles, Jaccard
similarity of 0.8 or more, taken transitively) the one with the least doc_id stays; benchmark
passages are cut from the text, and a document of which nothing but white space is left then
goes; personal data becomes [KIND]; the packing stage assigns length buckets and batches.

Defined results: a null text is kept as it is and packed as an empty one; rows without an id are
never copies of others and stay, unless toxic; rows with one id and equal texts are copies, of
which all stay if their class has no lesser id; an empty text stays; texts of any length are used
whole; empty documents, labels or benchmark give stages that drop nothing; further columns of
documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm import decontam, near_join, packing, pii, toxicity
from treeframe.llm.common import documents_of, stash

TOXIC_FROM = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on labels that meet a document here; rows scored TOXIC_FROM or more go, and none if there is nothing to learn from."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights.any():
        return docs
    return toxicity.below(docs, model, TOXIC_FROM)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = max(docs.columns, key=len) + "_cut"  # a name that no column has
    cleaned = decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mark=mark)
    return _measured(cleaned.where(~F.col(mark) | F.col("text").rlike("\\S")).drop(mark))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_lengths),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
