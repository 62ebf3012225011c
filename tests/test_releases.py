"""Releases and micro-batches: what failed leaves no trace, what ran twice is there once."""

import collections
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators.tables import shared_folder
from tessella.sources import releases
from tessella.streaming import batches


def corpus(spark):
    return spark.range(2500).select("id", F.when(F.col("id") % 3 > 0, "big").alias("book"), F.concat(F.lit("Word w"), F.col("id") % 50, F.lit(" word")).alias("text"))


def test_release_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "site")
    assert releases.current(spark, path) is None
    with pytest.raises(ValueError):
        releases.read(spark, path, "rows")
    one = spark.createDataFrame([(1, "a", None)], "id int, g string, x string")
    assert releases.publish(path, {"rows": (one, ["g"]), "none": (one.where("false"), [])}) == 1
    bad = one.withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        releases.publish(path, {"rows": (one.withColumn("id", F.lit(7)), ["g"]), "none": (bad, [])})
    assert releases.read(spark, path, "rows").collect() == one.collect()
    assert releases.read(spark, path, "none").count() == 0
    assert releases.publish(path, {"rows": (one.withColumn("id", F.lit(8)), [])}) == 2
    assert [r.id for r in releases.read(spark, path, "rows").collect()] == [8]
    assert [r.id for r in releases.read(spark, path, "rows", 1).collect()] == [1]
    with pytest.raises(ValueError):
        releases.read(spark, path, "none")


def test_collection_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(releases, "CHUNK", 100)
    path, df = str(tmp_path / "site"), corpus(spark)
    releases.publish(path, releases.collection(df, "book", "id", F.split(F.lower("text"), " ")))
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[r.book].append(r.id)
    chunk = {i: k // 100 for ids in groups.values() for k, i in enumerate(sorted(ids))}
    assert {r.id: r.chunk for r in releases.read(spark, path, "rows").collect()} == chunk
    index = {(r.book, r.chunk): (r.rows, r["first"], r["last"]) for r in releases.read(spark, path, "index").collect()}
    assert index == {(b, c): (len(p), p[0], p[-1]) for b, ids in groups.items() for c in range(-(-len(ids) // 100)) for p in [sorted(ids)[c * 100 : c * 100 + 100]]}
    words = releases.read(spark, path, "words").collect()
    assert sorted(i for r in words if r.word == "word" for i in r.places) == list(range(2500))
    assert max(len(r.places) for r in words) == 100 and {r.letter for r in words} == {"w"}
    assert [r.word for r in releases.read(spark, path, "words").where("word = 'w7' AND chunk = 0 AND book IS NULL").collect()] == ["w7"]


def test_numbers_over_many_stretches(spark):
    """Far more rows than a stretch holds, with gaps: places are those of the order."""
    df = spark.range(120000).select((F.col("id") * 7 - 1000).alias("id"), F.lit("all").alias("g"))
    got = releases._numbered(df, "g", "id").select("id", "_n").orderBy("id").collect()
    assert [r._n for r in got] == list(range(1, 120001))
    assert releases._numbered(df.where("false"), "g", "id").count() == 0


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Neither stored nor shuffled to be numbered; rows of equal orders and without one are there once."""
    monkeypatch.setattr(releases, "CHUNK", 100)
    odd = spark.createDataFrame([(99, None), (99, None), (99, "big"), (None, None), (None, "big"), (None, "big"), (2**40, "big")], "id long, book string").withColumn("text", F.lit("odd"))
    df = corpus(spark).withColumn("text", F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f"/{i}")), 512) for i in range(20)])).unionByName(odd)
    files = lambda: {p: p.stat().st_size for p in Path(shared_folder(spark)).rglob("*.parquet")}
    had = files()
    rows, index = (releases.collection(df, "book", "id", F.split("text", " "))[t][0] for t in ("rows", "index"))
    assert sum(size for p, size in files().items() if p not in had) < 100_000 < 2500 * 20 * 128 // 10
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.book or "", -1 if r.id is None else r.id, r.text)
    assert sorted(map(key, rows.collect())) == sorted(map(key, df.collect()))
    held = collections.Counter((r.book, r.chunk) for r in rows.collect())
    assert held == {(r.book, r.chunk): r.rows for r in index.collect()} and max(held.values()) <= 103
    equal = rows.where("id = 99 AND book IS NULL").select("chunk").distinct()
    assert equal.count() == 1


def test_restart_writes_nothing_twice(spark, tmp_path):
    rows = spark.range(40).withColumn("v", F.col("id") * 2)
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    out, check, reports = str(tmp_path / "out"), str(tmp_path / "cp"), []
    put = batches.folder_writer(out)

    def failing(df, number):
        put(df, number)
        if number == 1:
            raise RuntimeError("lost")

    stream = lambda: batches.files(spark, str(tmp_path / "in"), rows.schema, 2)
    with pytest.raises(Exception, match="lost"):
        batches.run(stream(), failing, check)
    done = batches.run(stream(), put, check, {"sum": F.sum("v")}, reports.append)
    assert done == reports and [d["batch"] for d in done] == [1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))
    assert done[-1]["total_rows"] == sum(d["rows"] for d in done) == spark.read.parquet(out).where("batch > 0").count()
    assert sum(d["sum"] for d in done) == spark.read.parquet(out).where("batch > 0").agg(F.sum("v")).first()[0]
    assert batches.run(stream(), put, check) == []
