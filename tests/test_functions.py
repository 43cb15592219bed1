"""Scalar functions, and queries on them, at sizes beyond the small tables."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumendex.functions import scalar as fn


def test_filesize_has_one_decimal_at_every_size(spark):
    sizes = [-1, 0, 1, 1023, 1024, 1280, 10239, 10240, 20000, 1048576, 10 * 1048576, 5 << 30, 3 << 40, 2000 << 40]
    x = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r.s for r in x.select(fn.filesize(F.col("n")).alias("s")).collect()] == ["", "0 bytes", "1 byte", "1023 bytes", "1.0K", "1.3K", "10.0K", "10.0K", "19.5K", "1.0M", "10.0M", "5.0G", "3.0T", "2000.0T"]


def test_functions_number_equals_its_sql_on_large_keys(spark, tmp_path):
    part = spark.createDataFrame([(k, "blue green", "Brand#1", "SMALL BRASS", k % 50 + 1, 1.0) for k in (0, 1, 1023, 1100, 10240, 19999, 1048575, 1048576, 1199999)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = duck.execute(entry.oracle_sql()["functions_number"]).fetchall()
    assert sorted(tuple(r) for r in entry.queries()["functions_number"](spark, str(tmp_path)).collect()) == sorted(want)
