"""Values as text, where Java's formatter and C's differ, against DuckDB and Python."""

import duckdb
from pyspark.sql import functions as F

from treeframe.functions import display
from treeframe.plans import catalog


def test_human_size_ties_go_to_the_even_digit(spark):
    ns = [k * 2**b // 8 + d for b in (10, 20, 30, 40, 52, 57) for k in range(8, 32) for d in (-1, 0, 1)]
    ns += [(2 * j + 1) * 2**27 // 25 + d for j in (10**6, 10**9, 3 * 10**11) for d in range(-200, 200, 7)] + [0, 1, 1023, 2**53 + 1, 2**63 - 1, 2**63 - 513]
    got = {r.n: r.shown for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", display.human_size(F.col("n")).alias("shown")).collect()}
    for n, shown in got.items():
        unit = next((u for u in (("GiB", 2**30), ("MiB", 2**20), ("KiB", 2**10)) if n >= u[1]), None)
        assert shown == (f"{float(n) / unit[1]:.2f} {unit[0]}" if unit else f"{n} B")


def like_duckdb(spark, tmp_path, name, table, df):
    df.write.parquet(f"{tmp_path}/{table}.parquet")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(c.sql(catalog.ORACLE_SQL[name]).fetchall())


def test_human_size_of_large_keys(spark, tmp_path):
    """With two keys whose 17 digits Java rounds up."""
    keys = spark.range(5000).unionByName(spark.createDataFrame([(6735306,), (8868887,), (8999999,)], "id long"))
    like_duckdb(spark, tmp_path, "human_size", "orders", keys.withColumnRenamed("id", "o_orderkey"))


def test_unix_iso_of_far_years(spark, tmp_path):
    """Up to 60 times the events, and the edges of years of four digits."""
    ids = spark.range(0, 6_000_000, 1999).unionByName(spark.createDataFrame([(i,) for i in (-800000, -719600, -719200, -700000, -355000, 2932931, 2932932, 2932933, 2932930)], "id long"))
    like_duckdb(spark, tmp_path, "unix_iso", "events", ids.withColumnRenamed("id", "event_id"))
    at = [-62135596801, -62167219201, 253402300799, 253402300800]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(at)], "i int, s long").orderBy("i").select(display.unix_iso(F.col("s"))).collect()]
    assert got == ["0000-12-31T23:59:59Z", "-1-12-31T23:59:59Z", "9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z"]
