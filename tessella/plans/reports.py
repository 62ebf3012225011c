"""Report queries: enrichment joins, statistics, agreement, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import align, lexicon, quality, references
from .base import query, table


@query("""SELECT o_orderkey, c_name, n_name, r_name, coalesce(l.items, 0) AS items, round(coalesce(l.price, 0), 2) AS price, l.flags FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS items, sum(l_extendedprice) AS price, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey WHERE o_totalprice > 300000""")
def enrich_rows(spark, sf_dir):
    """Facts with their dimensions and their collected details: the details are one row each before they are joined."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum("l_extendedprice").alias("price"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), "").alias("flags"))
    out = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").join(d, o["o_orderkey"] == d["l_orderkey"], "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("items", F.lit(0)).alias("items"), F.round(F.coalesce("price", F.lit(0.0)), 2).alias("price"), "flags")


@query("SELECT count(*) AS n, round(avg(l_discount * 10), 6) AS mean, round(median(l_discount * 10), 6) AS median, round(stddev_pop(l_discount * 10), 6) AS std, CAST(count_if(l_discount * 10 >= 0.7) AS BIGINT) AS high, CAST(count_if(l_discount * 10 >= 0.4 AND l_discount * 10 < 0.7) AS BIGINT) AS medium, CAST(count_if(l_discount * 10 < 0.4) AS BIGINT) AS low FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1")
def confidence_bands_median(spark, sf_dir):
    s = quality.score_summary(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("s")), "s")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "high", "medium", "low")


TOPICS = "a AS (SELECT l_orderkey AS u, 'm' || (l_linenumber % 2) AS m, l_suppkey % 4 AS t, l_discount * 10 AS s FROM lineitem)"


def _topics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("m"), (F.col("l_suppkey") % 4).alias("t"), (F.col("l_discount") * 10).alias("s"))


@query(f"WITH {TOPICS}, g AS (SELECT u, m, list(DISTINCT t) AS t FROM a GROUP BY u, m) SELECT x.u, x.m AS a, y.m AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(x.t || y.t)), 6) AS jaccard FROM g x JOIN g y ON x.u = y.u AND x.m < y.m")
def method_agreement_jaccard(spark, sf_dir):
    return quality.method_agreement(_topics(spark, sf_dir), "u", "m", "t").withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {TOPICS} SELECT u, NULL AS topic, 'many_topics' AS finding FROM a GROUP BY u HAVING count(DISTINCT t) > 3 UNION ALL SELECT u, CAST(t AS VARCHAR), 'scores_differ' FROM a GROUP BY u, t HAVING max(s) - min(s) > 0.3")
def overlap_check(spark, sf_dir):
    return quality.overlaps(_topics(spark, sf_dir), "u", "t", "s")


@query("SELECT o_orderkey, greatest(0, least(100, round(100 - 20 * (o_orderkey % 3) - 5 * (o_orderkey % 5) - o_orderkey % 7 + (o_totalprice / 500000 - 0.5) * 20 + (o_orderkey % 2) * 10, 6))) AS score FROM orders")
def quality_score(spark, sf_dir):
    k = F.col("o_orderkey")
    s = quality.quality_score(k % 3, k % 5, k % 7, F.col("o_totalprice") / 500000, k % 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(s, 6).alias("score"))


@query("SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS chars, count(DISTINCT source) AS sources FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def annotation_stats(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"), F.count_distinct("source").alias("sources"))


@query("SELECT CASE WHEN l_discount * 10 > 0.8 THEN 'high' WHEN l_discount * 10 >= 0.5 THEN 'medium' ELSE 'low' END AS band, l_returnflag AS method, count(*) AS n FROM lineitem GROUP BY ALL")
def alignment_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(align.as_bands(F.col("l_discount") * 10, 0.8, 0.5).alias("band"), F.col("l_returnflag").alias("method")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmatched_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '2001-09-02'")
    price = F.col("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT n_name, book, tokens, aligned, round(aligned / tokens, 6) AS coverage FROM (SELECT n_name, p_type AS book, count(*) AS tokens, CAST(count_if(l_discount > 0.04) AS BIGINT) AS aligned FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)")
def book_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("book"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    g = j.groupBy("n_name", "book").agg(F.count("*").alias("tokens"), F.count_if(F.col("l_discount") > 0.04).alias("aligned"))
    return g.withColumn("coverage", F.round(F.col("aligned") / F.col("tokens"), 6))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY p_partkey")
def lexicon_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("strong_number"), F.col("p_name").alias("word"), F.col("p_type").alias("transliteration"), F.col("p_brand").alias("gloss"))
    return lexicon.search(p, "Ring").select(F.col("strong_number").alias("p_partkey"), F.col("word").alias("p_name"))


@query("""WITH n AS (SELECT p_brand AS s, string_split(p_name, ' ')[1] AS w, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY s) AS share, row_number() OVER (PARTITION BY s ORDER BY n DESC, w) AS rank FROM n)
  SELECT s, w, n, round(share, 6) AS share FROM r WHERE rank <= 3""")
def translation_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("s"), F.split("p_name", " ")[0].alias("w"))
    return lexicon.translation_candidates(lexicon.usage(p, "s", "w"), "s", "w", 3).select("s", "w", "n", F.round("share", 6).alias("share"))


@query("""SELECT l_returnflag AS kind, count(*) AS n, count(DISTINCT l_suppkey) AS sources, count(DISTINCT l_partkey) AS targets, round(avg(l_discount * 10), 6) AS mean,
  CAST(count_if(l_discount * 10 > 0.8) AS BIGINT) AS high, CAST(count_if(l_discount * 10 BETWEEN 0.5 AND 0.8) AS BIGINT) AS medium, CAST(count_if(l_discount * 10 < 0.5) AS BIGINT) AS low FROM lineitem GROUP BY l_returnflag""")
def reference_statistics(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), (F.col("l_discount") * 10).alias("confidence"))
    return references.statistics(r).withColumn("mean", F.round("mean", 6))


@query("SELECT period, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first_key FROM orders JOIN (VALUES ('early', 1995, 1997), ('middle', 1997, 1999), ('late', 2000, 2004)) AS p(period, lo, hi) ON year(o_orderdate) BETWEEN lo AND hi GROUP BY period")
def events_by_period(spark, sf_dir):
    """Orders in overlapping periods: a table of periods is a closed list."""
    p = spark.createDataFrame([("early", 1995, 1997), ("middle", 1997, 1999), ("late", 2000, 2004)], "period string, lo int, hi int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return o.join(F.broadcast(p), F.col("y").between(F.col("lo"), F.col("hi"))).groupBy("period").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 6) AS themes FROM
  (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark) a JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark) b ON b.item_id = a.item_id + 1""")
def neighbour_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.latin_words(F.col("text"))).alias("t"))
    pairs = b.select(F.col("item_id").alias("a"), F.col("t").alias("ta"), (F.col("item_id") + 1).alias("b")).join(b.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), "b")
    return pairs.select("a", "b", F.round(similarity.jaccard(F.col("ta"), F.col("tb")), 6).alias("themes"))
