"""Mappings between numbering systems: lookup, round trips, conflicts, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Maps have the columns (from_sys, to_sys, src, dst ARRAY<STRING>, kind, confidence).


def resolve(refs: DataFrame, maps: DataFrame) -> DataFrame:
    """``refs`` (ref, from_sys, to_sys) with targets, rule and confidence.

    In this order: the exact entry, the reverse of a one-to-one entry of the other
    direction, the chapter's entry (verse 0), the reference itself.
    """
    pick = lambda df, name: df.groupBy("from_sys", "to_sys", "src").agg(F.max_by(F.struct("dst", "confidence"), F.struct("confidence", "dst")).alias(name))
    exact = pick(maps.where("NOT src LIKE '%.0'"), "exact")
    back = maps.where("size(dst) = 1").select(F.col("to_sys").alias("from_sys"), F.col("from_sys").alias("to_sys"), F.col("dst")[0].alias("src"), F.array("src").alias("dst"), "confidence")
    reverse = pick(back, "reverse")
    chapter = pick(maps.where("src LIKE '%.0'"), "chapter").withColumnRenamed("src", "chapter_src")
    keyed = refs.withColumn("src", F.col("ref")).withColumn("chapter_src", F.regexp_replace("ref", r"\.\d+[a-z]?$", ".0"))
    out = keyed.join(exact, ["from_sys", "to_sys", "src"], "left").join(reverse, ["from_sys", "to_sys", "src"], "left").join(chapter, ["from_sys", "to_sys", "chapter_src"], "left")
    verse = F.regexp_extract("ref", r"(\.\d+[a-z]?)$", 1)
    moved = F.transform("chapter.dst", lambda d: F.concat(F.regexp_replace(d, r"\.0$", ""), verse))
    targets = F.coalesce("exact.dst", "reverse.dst", moved, F.array("ref"))
    rule = F.when(F.col("exact").isNotNull(), "exact").when(F.col("reverse").isNotNull(), "reverse").when(F.col("chapter").isNotNull(), "chapter").otherwise("same")
    return out.select("ref", "from_sys", "to_sys", targets.alias("targets"), rule.alias("rule"), F.coalesce("exact.confidence", "reverse.confidence", "chapter.confidence", F.lit(1.0)).alias("confidence"))


def round_trips(maps: DataFrame) -> DataFrame:
    """One-to-one entries with an entry back from their target, and whether it returns to the source."""
    one = maps.where("size(dst) = 1")
    there = one.select("from_sys", "to_sys", "src", F.col("dst")[0].alias("mid"))
    back = one.select(F.col("to_sys").alias("from_sys"), F.col("from_sys").alias("to_sys"), F.col("src").alias("mid"), F.col("dst")[0].alias("home"))
    return there.join(back, ["from_sys", "to_sys", "mid"]).select("from_sys", "to_sys", "src", "mid", "home", (F.col("home") == F.col("src")).alias("holds"))


def conflicts(maps: DataFrame) -> DataFrame:
    """Sources that a pair of systems maps in several ways, and targets that several sources share."""
    many = maps.groupBy("from_sys", "to_sys", F.col("src").alias("ref")).agg(F.count_distinct(F.concat_ws(",", "dst")).alias("n")).where("n > 1").withColumn("problem", F.lit("several_targets"))
    shared = maps.select("from_sys", "to_sys", "src", F.explode("dst").alias("ref")).groupBy("from_sys", "to_sys", "ref").agg(F.count_distinct("src").alias("n")).where("n > 1").withColumn("problem", F.lit("several_sources"))
    return many.unionByName(shared)


def statistics(maps: DataFrame) -> DataFrame:
    """By pair of systems: entries by size of their target, and the mean confidence."""
    return maps.groupBy("from_sys", "to_sys").agg(F.count("*").alias("entries"), F.count_if(F.size("dst") == 1).alias("exact"), F.count_if(F.size("dst") == 0).alias("missing"), F.count_if(F.size("dst") > 1).alias("complex"), F.avg("confidence").alias("confidence"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book, chapter, in_a, in_b) where two schemes (book, chapter, verses) have other verse counts."""
    x, y = a.select("book", "chapter", F.col("verses").alias("in_a")), b.select("book", "chapter", F.col("verses").alias("in_b"))
    return x.join(y, ["book", "chapter"], "full").where(~F.col("in_a").eqNullSafe(F.col("in_b")))
