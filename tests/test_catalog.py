"""Every query of the catalogue against DuckDB on the smallest tables, and the entry module without its optional parts."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from treeframe.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_without_optional_parts(tmp_path):
    """The library alone still imports and has its queries."""
    import shutil

    shutil.copytree(f"{ROOT}/treeframe", tmp_path / "treeframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'analyze_documents' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_checksums_of_whole_texts(spark, tmp_path):
    import zlib

    from treeframe.plans import catalog

    texts = {1: "", 2: "abc", 3: "x" * 40 + "é tail", 12345678: "line\n" * 5000, 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def fold(data, step):
        s = 0
        for b in data:
            s = step(s, b)
        return s

    right = lambda bits: lambda s, b: (s // 2 + s % 2 * 2 ** (bits - 1) + b) % 2**bits
    left = lambda k: lambda s, b: (s * 2**k % 2**32 + s // 2 ** (32 - k)) ^ b
    rows = {r.doc_id: r for r in catalog.QUERIES["checksums"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        raw, name, r = (t or "").encode(), f"{i}.txt".encode(), rows[i]
        words = [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw) // 4 * 4, 4)]
        assert r.crc32 == (None if t is None else zlib.crc32(raw))
        assert (r.rotate16, r.rotate32) == (fold(raw, right(16)), fold(raw, right(32)))
        assert r.descriptor == fold(words, lambda s, w: (s * 8 % 2**32 + s // 2**29 + w) % 2**32)
        assert r.short_name == fold(f"{i:<8}TXT".encode(), right(8))
        assert (r.directory, r.attribute) == (fold(name, left(7)), fold(name, left(5)))


def test_name_hashes_like_plain_ones(spark):
    from test_library import M32, plain_crc32c, plain_half_md4, plain_tea

    from treeframe.plans import views

    names = {r.page_id: r.path.rsplit("/", 1)[1] for r in views.page_paths(spark, SF).collect()}
    for r in catalog.QUERIES["name_hashes"](spark, SF).collect():
        raw = names[r.page_id].encode()
        assert raw.isascii() and (r.tea, r.half_md4, r.crc32c) == (plain_tea(raw), plain_half_md4(raw), plain_crc32c(raw))
        assert r.drec == (plain_crc32c(raw.decode().lower().encode("utf-32-le")) ^ M32) & 0x3FFFFF
