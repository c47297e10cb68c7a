"""Bodies of archives: read where they stand, without an archive in a row, and cut out of rows where only Spark reads."""

import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from treeframe import api
from treeframe.sinks import archives as sinks
from treeframe.sources import archives


@pytest.fixture
def no_large_rows(spark):
    """A file of over 1,000 bytes as one row is an error."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def texts(spark, n=3000):
    return spark.range(n).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit("Regular").alias("kind"), F.repeat(F.col("id").cast("string"), (F.col("id") % 50).cast("int")).cast("binary").alias("data"))


def tar_of(path, members):
    with tarfile.open(path, "w") as t:
        for name, body in members:
            m = tarfile.TarInfo(name)
            m.size = len(body)
            t.addfile(m, io.BytesIO(body))


def pairs(df):
    return sorted((r.path, bytes(r.data)) for r in df.select("path", "data").collect())


def test_repack_without_archives_in_rows(spark, tmp_path, no_large_rows):
    tar_of(tmp_path / "a.tar", [(f"d/{i}", b"%d" % i * 99) for i in range(40)])
    tar_of(tmp_path / "b.tar", [("d/.wh.0", b""), ("d/1", b"new" * 99)])
    api.repack(spark, [f"{tmp_path}/a.tar", f"{tmp_path}/b.tar"], f"{tmp_path}/out", shards=2)
    found = archives.scan(spark, f"{tmp_path}/out")
    want = [("/d/1", b"new" * 99)] + [(f"/d/{i}", b"%d" % i * 99) for i in range(2, 40)]
    assert pairs(archives.bodies(spark, found, f"{tmp_path}/out")) == sorted(want)
    assert [r.path for r in found.where("kind = 'Dir'").collect()] == ["/d"]


def test_layers_of_the_round_trip_are_many_archives(spark, tmp_path, monkeypatch):
    """No task holds a whole layer."""
    from treeframe.plans import catalog

    d = spark.range(90).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("text"))
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    seen, repack = [], api.repack
    monkeypatch.setattr(catalog.api, "repack", lambda s, layers, *a, **k: (seen.extend(archives.scan(s, at).select("source").distinct().count() for at in layers), repack(s, layers, *a, **k)))
    assert catalog.QUERIES["repack_round_trip"](spark, str(tmp_path)).count() == 62
    assert min(seen) > 1


def test_bodies_in_other_stores(spark, tmp_path):
    """Paths that only Spark opens; compressed ones at hand and there; one body under two names."""
    import gzip

    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.bodies.link./in", f"file://{tmp_path}")
    (tmp_path / "t").mkdir()
    (tmp_path / "z").mkdir()
    members = [(f"m{i}", b"%d" % i * (i % 7)) for i in range(50)]
    tar_of(tmp_path / "t/a.tar", members)
    (tmp_path / "z/a.tar.gz").write_bytes(gzip.compress((tmp_path / "t/a.tar").read_bytes()))
    want = sorted(("/" + k, v) for k, v in members)
    for at in (f"file://{tmp_path}", "viewfs://bodies/in"):
        for folder, codec in (("t", None), ("z", "gzip")):
            e = archives.scan(spark, f"{at}/{folder}", codec=codec)
            assert pairs(archives.bodies(spark, e, f"{at}/{folder}", codec)) == want
            twice = e.unionByName(e.withColumn("path", F.concat("path", F.lit("x"))))
            assert archives.bodies(spark, twice, f"{at}/{folder}", codec).count() == 100
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/a.tar").write_bytes(b"")
    assert archives.scan(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("at", ["file://", "viewfs://cut/in"])
def test_a_body_cut_short_is_an_error(spark, tmp_path, at):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cut.link./in", f"file://{tmp_path}")
    tar_of(tmp_path / "a.tar", [("a", b"x" * 5000)])
    (tmp_path / "a.tar").write_bytes((tmp_path / "a.tar").read_bytes()[:2000])
    path = f"{at}{tmp_path}/a.tar" if at == "file://" else f"{at}/a.tar"
    with pytest.raises(Exception, match="beyond the archive's end"):
        archives.bodies(spark, archives.scan(spark, path), path).collect()


@pytest.mark.parametrize("kind", ["ar", "cpio", "tar", "zip"])
def test_scan_without_archives_in_rows(spark, tmp_path, no_large_rows, kind):
    sinks.write(texts(spark), f"{tmp_path}/out", kind, 2)
    found = archives.scan(spark, f"{tmp_path}/out", kind)
    assert pairs(archives.bodies(spark, found, f"{tmp_path}/out")) == pairs(texts(spark))


@pytest.mark.parametrize("kind", ["ar", "cpio", "tar", "zip"])
def test_archives_follow_the_documents(spark, tmp_path, monkeypatch, kind):
    """An archive for each partition of the documents: no body is dealt out, and no task's share grows with the table."""
    from treeframe.plans import catalog

    d = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    d.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog.ordering, "new_folder", lambda _: f"file://{tmp_path}/out")
    spark.conf.set("spark.sql.files.minPartitionNum", "12")
    try:
        found = catalog.QUERIES[f"scan_{kind}"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.md5 for r in found) == sorted(hashlib.md5(b"text %d" % i).hexdigest() for i in range(120))
    assert len({r.path for r in found}) == 120
    assert len(list((tmp_path / "out").glob("shard-*"))) == 12
