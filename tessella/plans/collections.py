"""Queries over collections: set comparison, division, search and pivots of catalogues, number mappings, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, sets
from .base import query, table

#: Nations as collections of the part brands that their suppliers sell.
MEMBERS = "m AS (SELECT DISTINCT s_nationkey AS g, p_brand AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49)"


def _members(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_suppkey", "l_partkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("b"))
    return sold.join(s, sold["l_suppkey"] == s["s_suppkey"]).join(p, sold["l_partkey"] == p["p_partkey"]).select("g", "b").distinct()


@query(f"WITH {MEMBERS} SELECT b FROM m GROUP BY b HAVING count(*) = (SELECT count(DISTINCT g) FROM m)")
def common_members(spark, sf_dir):
    return sets.common(_members(spark, sf_dir), "g", "b")


@query(f"WITH {MEMBERS} SELECT g, b FROM m WHERE b IN (SELECT b FROM m GROUP BY b HAVING count(*) <= 1)")
def unique_members(spark, sf_dir):
    return sets.only_in(_members(spark, sf_dir), "g", "b")


@query(f"WITH {MEMBERS} SELECT g FROM m WHERE b IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY g HAVING count(*) = 3")
def relational_division(spark, sf_dir):
    wanted = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "b string")
    return sets.covering(_members(spark, sf_dir), "g", "b", wanted)


@query(f"""WITH {MEMBERS}, a AS (SELECT b FROM m WHERE g = 1), c AS (SELECT b FROM m WHERE g = 2)
  SELECT coalesce(a.b, c.b) AS b, CASE WHEN a.b IS NULL THEN 'only_b' WHEN c.b IS NULL THEN 'only_a' ELSE 'common' END AS side FROM a FULL JOIN c ON a.b = c.b""")
def collection_compare(spark, sf_dir):
    return sets.compare(_members(spark, sf_dir), 1, 2, "g", "b")


ORDERED = """o AS (SELECT g, b, row_number() OVER (PARTITION BY g ORDER BY b) AS ord, CASE WHEN b < 'Brand#2' THEN 'x' ELSE 'y' END AS sec, count(*) OVER (PARTITION BY g) AS n FROM m)"""


@query(f"""WITH {MEMBERS}, {ORDERED} SELECT x.g AS a, y.g AS b, count(*) AS common,
  round(0.5 * count(*) / (any_value(x.n) + any_value(y.n) - count(*)) + 0.25 * (1 - count_if(abs(x.ord / x.n - y.ord / y.n) > 0.05) / count(*)) + 0.25 * (1 - count_if(x.sec <> y.sec) / count(*)), 6) AS score
  FROM o x JOIN o y ON x.b = y.b AND x.g < y.g GROUP BY x.g, y.g""")
def similarity_matrix(spark, sf_dir):
    from pyspark.sql import Window

    m = _members(spark, sf_dir)
    o = m.withColumn("ord", F.row_number().over(Window.partitionBy("g").orderBy("b"))).withColumn("sec", F.when(F.col("b") < "Brand#2", "x").otherwise("y"))
    return sets.similarity_matrix(o.withColumnRenamed("b", "member"), "g", "member", "ord", "sec").withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' AND p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#4')")
def catalogue_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_type = 'SMALL' AND p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#4')").select("p_partkey", "p_name")


@query("SELECT p_type, CAST(count_if(p_size <= 15) AS BIGINT) AS small, CAST(count_if(p_size BETWEEN 16 AND 30) AS BIGINT) AS middle, CAST(count_if(p_size > 30) AS BIGINT) AS large FROM part GROUP BY p_type")
def classification_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type", F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 30, "middle").otherwise("large").alias("c"))
    return p.groupBy("p_type").pivot("c", ["small", "middle", "large"]).count().na.fill(0)


@query("SELECT w AS word, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size FROM part) GROUP BY w")
def families_by_word(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_size").groupBy("word").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT p_brand, p_type, grouping_id(p_brand, p_type) AS g, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_rollup(spark, sf_dir):
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.grouping_id("p_brand", "p_type").alias("g"), F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tessella_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM tessella_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")


@query("SELECT s_suppkey, coalesce(a.n_name, b.r_name, 'none') AS target, CASE WHEN a.n_name IS NOT NULL THEN 1 WHEN b.r_name IS NOT NULL THEN 2 ELSE 0 END AS rule FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) a ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 15) b ON s_nationkey - 10 = r_regionkey")
def mapping_fallback(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name")
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 10).alias("k"), "r_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return joins.first_mapping(s, "s_nationkey", [(n, "n_nationkey", "n_name"), (r, "k", "r_name")], F.lit("none")).select("s_suppkey", "target", "rule")


@query("WITH a AS (SELECT s_suppkey AS k, 1 AS i, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS k, 2 AS i, 0.0 AS v FROM supplier) SELECT k, arg_min(v, i) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k")
def collection_merge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return sets.merge(s.where("k % 2 = 0"), s.withColumn("v", F.lit(0.0)), key=["k"])
