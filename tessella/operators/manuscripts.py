"""Variant units: nested readings and witnesses, scored in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a witness by kind, and of the parts of a witness's and a reading's score.
KIND_WEIGHT = {"papyrus": 1.0, "uncial": 0.9, "version": 0.7, "minuscule": 0.6, "father": 0.6, "lectionary": 0.5}
WITNESS_PARTS = {"age": 0.3, "kind": 0.25, "accuracy": 0.2, "completeness": 0.15, "family": 0.1}
READING_PARTS = {"external": 0.5, "internal": 0.3, "spread": 0.2}


def age_score(year: Column) -> Column:
    return F.when(year <= 200, 1.0).when(year <= 300, 0.9).when(year <= 400, 0.8).when(year <= 500, 0.7).when(year <= 800, 0.5).when(year <= 1000, 0.3).otherwise(0.2)


def witness_score(kind: Column, year: Column, accuracy: Column, completeness: Column, family: Column) -> Column:
    p = WITNESS_PARTS
    k = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i in KIND_WEIGHT.items() for x in i]), kind), F.lit(0.5))
    return p["age"] * age_score(year) + p["kind"] * k + p["accuracy"] * F.coalesce(accuracy, F.lit(0.5)) + p["completeness"] * F.coalesce(completeness, F.lit(0.5)) + p["family"] * F.when(family == "alexandrian", 1.0).otherwise(0.6)


def reading_scores(units: DataFrame) -> DataFrame:
    """(unit_id, idx, text, score, share): one row for each reading of units with
    readings array<struct<text, witnesses array<struct<siglum, kind, family, year, accuracy, completeness>>>>."""
    r = units.select("unit_id", F.posexplode("readings").alias("idx", "r")).select("unit_id", "idx", "r.text", F.col("r.witnesses").alias("w"))
    values = F.transform("w", lambda x: witness_score(x["kind"], x["year"], x["accuracy"], x["completeness"], x["family"]))
    n = F.size("w")
    external = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    families = F.size(F.array_distinct(F.transform("w", lambda x: x["family"])))
    internal = F.when(F.length("text") == F.min(F.length("text")).over(Window.partitionBy("unit_id")), 0.6).otherwise(0.4)
    p = READING_PARTS
    late = F.when((n > 0) & (F.array_min(F.transform("w", lambda x: x["year"])) > 1000), 0.7).otherwise(1.0)
    score = (p["external"] * external + p["internal"] * internal + p["spread"] * F.least(families / 4, F.lit(1.0)) + F.least(F.log(n + 1) / 10, F.lit(0.3))) * late
    out = r.withColumn("score", score)
    return out.select("unit_id", "idx", "text", "score", (F.col("score") / F.sum("score").over(Window.partitionBy("unit_id"))).alias("share"))


def preferred(units: DataFrame) -> DataFrame:
    """The best reading of each unit; the first of equals."""
    return reading_scores(units).groupBy("unit_id").agg(F.max_by(F.struct("idx", "text", "score", "share"), F.struct("score", -F.col("idx"))).alias("b")).select("unit_id", "b.*")


def reading_pairs(units: DataFrame) -> DataFrame:
    """(unit_id, i, j, shared, words_apart) for pairs of a unit's readings."""
    r = units.select("unit_id", F.posexplode("readings").alias("i", "r"))
    a = r.select("unit_id", "i", F.split("r.text", " ").alias("a"))
    b = r.select("unit_id", F.col("i").alias("j"), F.split("r.text", " ").alias("b"))
    return a.join(b, "unit_id").where("i < j").select("unit_id", "i", "j", F.size(F.array_intersect("a", "b")).alias("shared"), (F.size(F.array_union("a", "b")) - F.size(F.array_intersect("a", "b"))).alias("words_apart"))


def weak_family(units: DataFrame, least: float = 0.7) -> DataFrame:
    """Witnesses whose readings agree with no family's commonest reading in at least ``least`` of the units."""
    w = units.select("unit_id", F.posexplode("readings").alias("idx", "r")).select("unit_id", "idx", F.explode("r.witnesses").alias("w")).select("unit_id", "idx", "w.siglum", "w.family")
    votes = w.where("family IS NOT NULL").groupBy("unit_id", "family", "idx").agg(F.count("*").alias("n"))
    lead = votes.groupBy("unit_id", "family").agg(F.max_by("idx", F.struct("n", -F.col("idx"))).alias("lead"))
    agree = w.select("unit_id", "idx", "siglum").join(lead, "unit_id").groupBy("siglum", "family").agg(F.avg((F.col("idx") == F.col("lead")).cast("int")).alias("share"))
    return agree.groupBy("siglum").agg(F.max("share").alias("best")).where(F.col("best") < least)
