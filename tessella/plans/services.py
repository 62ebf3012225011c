"""Queries over references, dates, event filters, collections and event graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, refs, text
from ..operators import filters, graph, quality, references, sets
from .base import query, table
from .networks import EDGES, _edges


@query("WITH b AS (SELECT * FROM (VALUES ('GEN', 1, 50), ('JUD', 65, 1), ('REV', 66, 22)) AS v(book, ord, most)), p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Genesis' WHEN 1 THEN 'jude' ELSE 'REV' END AS name, p_size AS chapter, CAST(p_partkey % 40 AS INT) AS verse, CASE p_size % 3 WHEN 0 THEN 'GEN' WHEN 1 THEN 'JUD' ELSE 'REV' END AS book FROM part) SELECT p_partkey, CASE WHEN chapter BETWEEN 1 AND most AND verse >= 1 THEN p.book || '.' || chapter || '.' || verse END AS ref, CASE WHEN NOT (chapter BETWEEN 1 AND most AND verse >= 1) THEN NULL WHEN ord > 1 THEN 1 WHEN chapter > 7 OR (chapter = 7 AND verse > 3) THEN 1 WHEN chapter = 7 AND verse = 3 THEN 0 ELSE -1 END AS side FROM p JOIN b USING (book)")
def reference_validation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 3 == 0, "Genesis").when(F.col("p_size") % 3 == 1, "jude").otherwise("REV")
    p = p.select("p_partkey", refs.create_verse_id(name, F.col("p_size"), F.col("p_partkey") % 40, F.lit(None).cast("string")).alias("r"))
    fixed = refs.parse_verse_id(F.lit("GEN.7.3"))
    return p.select("p_partkey", refs.canonical(F.col("r")).alias("ref"), refs.compare(F.col("r"), fixed).alias("side"))


MODERN = r"regexp_replace(text, '\b\d+:\d+\b', '', 'g')"
for old, new in text.MODERN_SPELLINGS:
    MODERN = rf"regexp_replace({MODERN}, '(?i)\b{old}\b', '{new}', 'g')"


@query(f"SELECT doc_id, trim({MODERN}) AS t FROM documents")
def modern_spellings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.modern_spelling(F.col("text")).alias("t"))


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 10 AND user_id % 7 <> 3 AND contains(lower(props), '1')")
def event_filters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("confidence", F.col("value")).withColumn("groups", F.array((F.col("user_id") % 7).cast("string")))
    test = filters.event_filter(without={"groups": ["3"]}, one_of={"event_type": ["purchase", "signup"]}, least_confidence=10, not_empty=("groups",), contains={"props": "1"})
    return e.where(test).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05 ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber LIMIT 25")
def confident_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return filters.confident_first(li, "l_discount", 0.05, 25, "tie").select("l_orderkey", "l_linenumber", "l_discount")


@query(f"WITH {EDGES} SELECT src AS source, dst AS target, kind FROM e WHERE (src < 20 OR dst < 20) AND kind IN ('causes', 'before')")
def references_touching(spark, sf_dir):
    r = _edges(spark, sf_dir).withColumnRenamed("src", "source").withColumnRenamed("dst", "target")
    return references.touching(r, spark.range(20).toDF("verse"), kinds=["causes", "before"]).select("source", "target", "kind")


@query("WITH c AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem) SELECT g, count(*) AS members FROM c GROUP BY g ORDER BY members DESC, g LIMIT 1")
def most_inclusive_group(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("m"))
    return sets.most_inclusive(c, "g", "m", "g")


@query("WITH c AS (SELECT DISTINCT l_returnflag || l_linenumber AS g, l_partkey % 5 AS m FROM lineitem) SELECT min(g) AS g FROM (SELECT g FROM c WHERE m IN (0, 3) GROUP BY g HAVING count(*) = 2)")
def first_group_covering(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("g"), (F.col("l_partkey") % 5).alias("m"))
    return sets.first_covering(c, "g", "m", spark.createDataFrame([(0,), (3,)], "m long"), "g")


@query("WITH c AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem WHERE l_suppkey IN (1, 2)), b AS (SELECT m FROM c GROUP BY m HAVING count(*) = 2) SELECT p_partkey, m AS mapped FROM part LEFT JOIN b ON m = p_partkey")
def members_across_groups(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("m"))
    return sets.mapped_across(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", c, "g", "m", 1, 2).select("p_partkey", "mapped")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)")
def rows_of_group(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("m"))
    return sets.in_group(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", c, "g", "m", 3)


@query("WITH c AS (SELECT n_regionkey AS g, n_name AS m, n_nationkey AS ord, left(n_name, 1) AS sec FROM nation) SELECT x.m, y.g, c.ord IS NOT NULL AS in_group, c.ord AS place, c.sec AS section FROM (SELECT DISTINCT m FROM c) x CROSS JOIN (SELECT DISTINCT g FROM c) y LEFT JOIN c ON c.m = x.m AND c.g = y.g")
def member_journeys(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("m"), F.col("n_nationkey").alias("ord"), F.substring("n_name", 1, 1).alias("sec"))
    return sets.journey(n, "g", "m", "ord", "sec")


@query("""WITH g AS (SELECT l_orderkey AS o, list(l_discount * 10) AS s, avg(l_discount * 10) AS c, count(*) AS n FROM lineitem GROUP BY l_orderkey)
  SELECT o, round((1 - c) * 10 * n, 6) AS impact FROM g WHERE c < 0.6 OR (n > 1 AND list_var_pop(s) > 0.15) ORDER BY round((1 - c) * 10 * n, 9) DESC, o LIMIT 100""")
def uncertain_groups(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list(F.col("l_discount") * 10).alias("s"), F.round(F.avg(F.col("l_discount") * 10), 12).alias("c"), F.count("*").alias("n"))
    g = g.withColumn("factors", F.array().cast("array<string>"))
    return quality.uncertain_first(g, "c", "s", "factors", "n", "o").select("o", F.round("impact", 6).alias("impact"))


FULFILS = "f AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_discount * 10 AS conf FROM lineitem WHERE l_returnflag = 'A')"


@query(f"WITH {FULFILS} SELECT src, dst, round(conf, 6) AS conf, row_number() OVER (PARTITION BY src ORDER BY conf DESC, dst) AS rank FROM f WHERE src BETWEEN 1 AND 5")
def fulfilments(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("fulfills").alias("kind"), (F.col("l_discount") * 10).alias("conf")).distinct()
    return graph.fulfilments(f, spark.range(1, 6)).select("src", "dst", F.round("conf", 6).alias("conf"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT src, dst FROM e), t AS (SELECT [src, dst] AS path, dst AS pos FROM d WHERE src < 10 AND src <> dst UNION ALL SELECT list_append(path, dst), dst FROM t JOIN d ON src = pos WHERE NOT list_contains(path, dst) AND len(path) <= 2) SELECT array_to_string(path, '>') AS path FROM t WHERE list_contains(path, 4) AND pos BETWEEN 20 AND 39")
def paths_with_required(spark, sf_dir):
    p = graph.paths_through(_edges(spark, sf_dir), spark.range(10), spark.range(20, 40), [4], 2)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src, dst, CAST(abs(src * 37 % 101 - dst * 37 % 101) AS DOUBLE) AS weight FROM e), most AS (SELECT count(DISTINCT src) AS most FROM w), t AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS cost, 0 AS n UNION ALL SELECT id, min(cost), n FROM (SELECT dst AS id, cost + weight AS cost, n + 1 AS n FROM t JOIN w ON src = id, most WHERE n < most) GROUP BY id, n) SELECT id, min(cost) AS cost FROM t GROUP BY id")
def temporal_paths(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.temporal_shortest(e, ids.withColumn("year", F.col("id") * 37 % 101), 1)


@query("""WITH t AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 4 THEN n_regionkey END AS parent, [(n_nationkey + 1) % 30, (n_nationkey + 2) % 30] AS rel FROM nation),
  x AS (SELECT id, parent AS related, 'parent' AS relation FROM t WHERE parent IS NOT NULL UNION SELECT parent, id, 'child' FROM t WHERE parent IS NOT NULL UNION SELECT id, unnest(rel), 'related' FROM t)
  SELECT * FROM x WHERE related IN (SELECT id FROM t) AND id IN (SELECT id FROM t)""")
def related_topics(spark, sf_dir):
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k > 4, F.col("n_regionkey")).alias("parent"), F.array((k + 1) % 30, (k + 2) % 30).alias("related_ids"))
    return graph.related_topics(t)


@query("WITH w AS (SELECT a.item_id, regexp_extract_all(lower(a.text), '[a-z]+') AS x, list_reverse(regexp_extract_all(lower(a.text), '[a-z]+')) AS y FROM benchmark a) SELECT item_id, CAST(len(list_filter(x, lambda v, i : abs(i - list_position(y, v)) > 1)) AS BIGINT) AS changes FROM w")
def word_order_changes(spark, sf_dir):
    w = text.latin_words(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.order_changes(w, F.reverse(w)).cast("long").alias("changes"))
