"""Queries over graphs: regions, nations, suppliers, parts; conversations as chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, sets
from .base import query, table

TREE = """v AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"""


def _tree(spark, sf_dir):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(k("c", "c_custkey").alias("id"), k("n", "c_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(k("n", "n_nationkey").alias("id"), k("r", "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(k("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    return c.unionByName(n).unionByName(r)


@query(f"WITH RECURSIVE {TREE}, t AS (SELECT id AS root, id, 0 AS depth FROM v WHERE id LIKE 'r%' UNION ALL SELECT t.root, v.id, t.depth + 1 FROM t JOIN v ON v.parent = t.id) SELECT root, depth, count(*) AS n FROM t GROUP BY root, depth")
def tree_descendants(spark, sf_dir):
    _tree(spark, sf_dir).createOrReplaceTempView("tessella_tree")
    t = graph.descendants(spark, "tessella_tree", "id", "parent", "root LIKE 'r%'")
    return t.groupBy("root", "depth").agg(F.count("*").alias("n"))


EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'before' ELSE 'related_to' END AS kind, l_discount * 10 AS conf FROM lineitem)"


def _edges(spark, sf_dir):
    """Suppliers and parts of all line items, by their own ids."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "causes").when(F.col("l_linenumber") % 3 == 1, "before").otherwise("related_to")
    return li.select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"), kind.alias("kind"), (F.col("l_discount") * 10).alias("conf")).distinct()


@query(f"""WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT src, dst FROM e), t AS (SELECT [src, dst] AS path, dst AS pos FROM d WHERE src < 10 AND src <> dst UNION ALL SELECT list_append(path, dst), dst FROM t JOIN d ON src = pos WHERE NOT list_contains(path, dst) AND len(path) <= 3)
  SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM t""")
def recursive_paths(spark, sf_dir):
    starts = spark.range(10).select("id")
    p = graph.simple_paths(_edges(spark, sf_dir), starts, 3)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.col("length").cast("long").alias("length"))


@query(f"""WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT src, dst FROM e), t AS (SELECT 1 AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM t JOIN d ON src = id WHERE distance < 4) SELECT CAST(id AS BIGINT) AS id, CAST(min(distance) AS BIGINT) AS distance FROM t GROUP BY id""")
def bfs_reach(spark, sf_dir):
    b = graph.bfs(_edges(spark, sf_dir), spark.range(1, 2), 4)
    return b.select("id", F.col("distance").cast("long").alias("distance"))


WEIGHTED = f"{EDGES}, w AS (SELECT src, dst, min((1 - conf) * CASE kind WHEN 'causes' THEN 0.8 WHEN 'before' THEN 1.0 ELSE 1.5 END) AS weight FROM e GROUP BY src, dst)"


@query(f"""WITH RECURSIVE {WEIGHTED}, most AS (SELECT count(DISTINCT src) AS most FROM w), t AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS cost, 0 AS n UNION ALL SELECT id, min(cost), n FROM (SELECT dst AS id, cost + weight AS cost, n + 1 AS n FROM t JOIN w ON src = id, most WHERE n < most) GROUP BY id, n)
  SELECT id, round(min(cost), 6) AS cost FROM t GROUP BY id""")
def shortest_paths(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("weight", graph.edge_weight(F.col("kind"), F.col("conf")))
    return graph.shortest(e, 1).select("id", F.round("cost", 6).alias("cost"))


def _ranks(rounds: int) -> str:
    parts = [f"WITH {EDGES}, w AS (SELECT src, dst, count(*) AS weight FROM e GROUP BY src, dst), o AS (SELECT src, sum(weight) AS total FROM w GROUP BY src), i AS (SELECT src AS id FROM w UNION SELECT dst FROM w), n AS (SELECT count(*) AS n FROM i), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM i, n)"]
    for k in range(rounds):
        parts.append(f"""g{k} AS (SELECT w.dst AS id, sum(r * weight / total) AS got FROM r{k} JOIN w ON w.src = id JOIN o ON o.src = id GROUP BY w.dst), l{k} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM o)),
  r{k + 1} AS (SELECT i.id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS r FROM i LEFT JOIN g{k} USING (id), l{k}, n)""")
    return ",\n".join(parts) + f" SELECT id, round(r, 8) AS rank FROM r{rounds}"


@query(_ranks(5))
def pagerank(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return graph.pagerank(e, 5, tolerance=0.0).select("id", F.round("rank", 8).alias("rank"))


@query(f"WITH {EDGES} SELECT src, dst, kind FROM e UNION SELECT dst, src, CASE kind WHEN 'before' THEN 'after' ELSE kind END FROM e")
def bidirectional_edges(spark, sf_dir):
    return sets.in_both_directions(_edges(spark, sf_dir).select("src", "dst", "kind"), {"before": "after", "after": "before"})


@query(f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.kind = 'causes' AND y.kind = 'before' GROUP BY ALL")
def event_pattern(spark, sf_dir):
    return graph.two_step_pattern(_edges(spark, sf_dir), F.col("kind") == "causes", F.col("kind") == "before")


@query(f"WITH {EDGES} SELECT dst AS id, src AS cause, round(max(conf), 6) AS confidence FROM e WHERE kind = 'causes' GROUP BY ALL")
def direct_causes(spark, sf_dir):
    return graph.causes_of(_edges(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("SELECT 'BELONGS_TO' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'PART_OF', count(*) FROM nation UNION ALL SELECT 'PLACED', count(*) FROM orders")
def graph_projection_counts(spark, sf_dir):
    k = lambda t, s, d, n: table(spark, sf_dir, t).select(F.col(s).cast("long").alias("src"), F.col(d).cast("long").alias("dst"), F.lit(n).alias("kind"))
    e = k("customer", "c_custkey", "c_nationkey", "BELONGS_TO").union(k("nation", "n_nationkey", "n_regionkey", "PART_OF")).union(k("orders", "o_custkey", "o_orderkey", "PLACED"))
    return e.groupBy("kind").agg(F.count("*").alias("n"))
