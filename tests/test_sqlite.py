"""The SQLite source: round trips, pushed filters, ranges, foreign files, commits and aborts."""

import datetime as dt
import math
import os
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella.sources import sqlite

UTC = dt.timezone.utc
SCHEMA = 'id long, name string, `Sum "x"` double, day date, at timestamp, price decimal(12,2), ok boolean, raw binary'
ROWS = [
    (1, "a", 1.5, dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 6, UTC), Decimal("1.20"), True, b"\x00\x01"),
    (2, None, math.nan, dt.date(1999, 12, 31), None, Decimal("-0.01"), False, b""),
    (3, "é 'quoted'", math.inf, None, dt.datetime(1969, 12, 31, tzinfo=UTC), None, None, None),
    (4, "", -0.5, dt.date(2020, 1, 3), None, Decimal("9999999999.99"), True, b"x"),
    (None, "a", None, None, None, None, None, None),
]


def same(a, b):
    key = lambda df: sorted(map(repr, df.select([F.col(f"`{c}`") for c in df.columns]).collect()))
    return key(a) == key(b)


def test_round_trip_append_and_overwrite(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA).withColumn("unzoned", F.col("at").cast("timestamp_ntz")), f"{tmp_path}/t"
    sqlite.write(df.repartition(3), path, index=["id"])
    assert sqlite.read(spark, path).schema.simpleString() == df.schema.simpleString()
    assert same(sqlite.read(spark, path), df)
    sqlite.write(df, f"file:{path}")
    assert same(sqlite.read(spark, path, rows="2"), df.union(df))
    sqlite.write(df.limit(1), path, "overwrite")
    assert sqlite.read(spark, path).count() == 1
    assert sum(n.endswith(".sqlite") for n in os.listdir(path)) == 1
    with pytest.raises(Exception, match="another schema"):
        sqlite.write(df.select("id"), path)
    assert sqlite.read(spark, path).count() == 1
    assert not [n for n in os.listdir(path) if n.startswith("_")]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    sqlite.write(df, f"{tmp_path}/t")
    assert sqlite.read(spark, f"{tmp_path}/t").collect() == []


@pytest.mark.parametrize(
    "test",
    ["id > 1", "id <= 2", "id <=> 3", "id <=> null", "id in (1, 4)", "not id = 1", "name = 'a'", "name > ''", "name = \"é 'quoted'\"", "name is null", "name is not null", '`Sum "x"` > 1', '`Sum "x"` = double("NaN")', '`Sum "x"` < 2', "day >= date'2020-01-01'",
     "at > timestamp'1970-01-01'", "price < 1", "ok", "not ok", "name like 'a%'", "id > 1 or name = 'a'", "name not in ('a', '')", "id between 2 and 3 and ok is null"],
)
def test_filters_give_sparks_rows(spark, tmp_path, test):
    df = spark.createDataFrame(ROWS, SCHEMA)
    sqlite.write(df.coalesce(1), f"{tmp_path}/t")
    assert same(sqlite.read(spark, f"{tmp_path}/t").where(test), df.where(test))


def test_filters_reach_the_source(spark, tmp_path):
    sqlite.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"{tmp_path}/t")
    plan = sqlite.read(spark, f"{tmp_path}/t").where("id > 1 and day = date'2020-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert "Filter " in sqlite.read(spark, f"{tmp_path}/t").where("price < 1")._jdf.queryExecution().executedPlan().toString()


def test_foreign_file(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "f.db")
    con.execute("CREATE TABLE verse (oid INTEGER, rowid VARCHAR(9), weight FLOAT, z BLOB)")
    con.executemany("INSERT INTO verse VALUES (?, ?, ?, ?)", [(i, f"r{i}", i / 2, b"z") for i in range(25)] + [("many", None, None, None)])
    con.execute("CREATE TABLE pairs (a INT PRIMARY KEY, b TEXT) WITHOUT ROWID")
    con.execute("INSERT INTO pairs VALUES (1, 'x')")
    con.commit()
    con.close()
    path = str(tmp_path / "f.db")
    assert [tuple(r) for r in sqlite.read(spark, path, "pairs").collect()] == [(1, "x")]
    verse = sqlite.read(spark, path, "verse", rows="10", bad="null")
    assert verse.schema.simpleString() == "struct<oid:bigint,rowid:string,weight:double,z:binary>"
    assert verse.rdd.getNumPartitions() == 3
    assert verse.where("oid is null").count() == 1
    assert verse.where("oid >= 20").count() == 5
    with pytest.raises(Exception, match="many"):
        sqlite.read(spark, path, "verse").collect()
    with pytest.raises(Exception, match="no table"):
        sqlite.read(spark, path, "other").collect()


def test_failing_task_leaves_no_trace(spark, tmp_path):
    path = f"{tmp_path}/t"
    sqlite.write(spark.range(100).repartition(4), path)
    before = sorted(os.listdir(path))
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error("broken")).otherwise(F.col("id")).cast("long").alias("id"))
    for mode in ("append", "overwrite") * 3:
        with pytest.raises(Exception, match="broken"):
            sqlite.write(bad, path, mode)
        assert sorted(os.listdir(path)) == before
        assert sqlite.read(spark, path).count() == 100


def test_commits_of_two_writers_are_both_kept(tmp_path, spark):
    schema = spark.range(1).schema
    one, two = (sqlite.SqliteWriter(f"{tmp_path}/t", schema, False) for _ in range(2))
    for w in (one, two):
        with sqlite3.connect(f"{w.staging}/p{w.job}") as con:
            con.execute("CREATE TABLE data (id INTEGER)")
            con.execute("INSERT INTO data VALUES (5)")
    for w in (two, one):
        w.commit([sqlite.Written(f"p{w.job}", 1), None])
    assert sqlite.last_manifest(f"{tmp_path}/t")[0] == 2
    assert [r.id for r in sqlite.read(spark, f"{tmp_path}/t").collect()] == [5, 5]
