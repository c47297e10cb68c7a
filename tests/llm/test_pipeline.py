"""The pipeline's stages on the smallest table, and its planted cases."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in P.STAGES:
        before, docs = docs, P.stash(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == names
        sizes.append(docs.count())
        if name in ("pii", "packing"):
            assert sizes[-1] == sizes[-2]
        if name == "pii":
            assert docs.where("length(text) <> n_chars").count() == 0
            assert P.pii.find(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
        if name == "benchmark_decontamination":
            assert P.decontam.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name == "ngram_jaccard_join":
            assert P.near_join.classes(docs).where("n_links > 0").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]


def test_odd_documents(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, "mail x@y.org", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in P.run(spark, f"file://{tmp_path}").collect()) == ["1", "3", "4", "None"]


def test_empty_long_and_clashing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _cut boolean, _drop_id long, rep string, bucket int"
    passage = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i % 5000}x{i % 77}" for i in range(200_000))
    rows = [(1, f"{long} {passage} {long}", "en", "s", 5, None, 1, "r", 9), (1, f"{long} {passage} {long}", "en", "s", 5, True, 1, "r", 9), (2, passage, "en", "s", 0, False, 2, "r", 8)]
    for name, docs in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in P.STAGES[:-1]:
            now = P.stash(f(spark, now, at), stage)
            assert now.columns == [c.split()[0] for c in schema.split(", ")]
        left = now.collect()
        assert [(r.doc_id, r.text.split() == (long + " " + long).split(), r.n_chars, r._cut) for r in sorted(left, key=lambda r: r._cut is True)] == ([(1, True, 2 * len(long) + 1, None), (1, True, 2 * len(long) + 1, True)] if docs else [])
        assert P.run(spark, at).count() == len(left)
