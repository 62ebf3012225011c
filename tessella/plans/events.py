"""Queries over events and orders: rules, facets, intervals, bands, uncertain dates, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, probability
from ..operators import filters, joins, quality
from ..operators.filters import FilterGroup, FilterRule, Preferences
from ..streaming.windows import sessions, window_counts
from .base import query, table

RULES = [
    ("equals", FilterRule("o_orderstatus", "equals", "F"), "o_orderstatus = 'F'"),
    ("not_equals", FilterRule("o_orderstatus", "not_equals", "F"), "o_orderstatus <> 'F'"),
    ("contains", FilterRule("o_orderpriority", "contains", "HIGH"), "contains(o_orderpriority, 'HIGH')"),
    ("not_contains", FilterRule("o_orderpriority", "not_contains", "HIGH"), "NOT contains(o_orderpriority, 'HIGH')"),
    ("in", FilterRule("o_orderpriority", "in", ("1-URGENT", "5-LOW")), "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("not_in", FilterRule("o_orderpriority", "not_in", ("1-URGENT", "5-LOW")), "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    ("greater_than", FilterRule("o_totalprice", "greater_than", 250000), "o_totalprice > 250000"),
    ("less_than", FilterRule("o_totalprice", "less_than", 250000), "o_totalprice < 250000"),
    ("between", FilterRule("o_totalprice", "between", (100000, 200000)), "o_totalprice BETWEEN 100000 AND 200000"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS op, count(*) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS keys FROM orders WHERE {s}" for n, _, s in RULES))
def filter_rules_all_ops(spark, sf_dir):
    """All nine operators in one pass over the table."""
    o = table(spark, sf_dir, "orders")
    sums = [c for n, r, _ in RULES for c in (F.count_if(r.column()).alias(f"n_{n}"), F.coalesce(F.sum(F.when(r.column(), F.col("o_orderkey"))), F.lit(0)).alias(f"k_{n}"))]
    return o.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(n).alias("op"), F.col(f"n_{n}").alias("n"), F.col(f"k_{n}").alias("keys")) for n, _, _ in RULES])).alias("x")).select("x.*")


@query("""WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
  SELECT o_orderkey FROM o WHERE (s IS NULL OR s <> 'F') AND p IS NOT NULL AND p > 300000""")
def filter_null_semantics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"))
    return o.where(FilterGroup([FilterRule("s", "not_equals", "F"), FilterRule("p", "greater_than", 300000)]).column()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 450000")
def filter_group_or(spark, sf_dir):
    g = FilterGroup([FilterRule("o_orderstatus", "equals", "P"), FilterRule("o_totalprice", "greater_than", 450000), FilterRule("o_orderkey", "equals", 1, enabled=False)], "OR")
    return table(spark, sf_dir, "orders").where(g.column()).select("o_orderkey")


def _tagged(spark, sf_dir):
    """Events with list columns: tags from type and the number in props."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.withColumn("tags", F.array(F.col("event_type"), F.concat(F.lit("t"), (F.col("k") % 5).cast("string")))).withColumn("evidence", F.when(F.col("k") % 3 == 0, F.array(F.lit("site"))).otherwise(F.array().cast("array<string>"))).withColumn("confidence", F.col("k") / 100)


TAGGED = "e AS (SELECT event_id, event_type, user_id, ts, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query(f"WITH {TAGGED} SELECT event_id FROM e WHERE event_type <> 'error' AND (event_type = 'click' OR k % 5 = 1) AND k / 100.0 >= 0.5 AND k % 3 = 0")
def preference_filter(spark, sf_dir):
    p = Preferences(excluded={"tags": ["error"]}, preferred={"tags": ["click", "t1"]}, least_confidence=0.5, not_empty=["evidence"])
    return _tagged(spark, sf_dir).where(p.column()).select("event_id")


@query("SELECT event_id FROM events WHERE NOT contains(lower(event_type), 'ch')")
def quick_filter_negated(spark, sf_dir):
    return _tagged(spark, sf_dir).where(filters.quick("not event_type:CH", ("tags",), ("event_type",))).select("event_id")


@query(f"WITH {TAGGED} SELECT event_id FROM e WHERE contains(event_type, 'up') OR contains('t' || CAST(k % 5 AS VARCHAR), 'up')")
def quick_filter_search(spark, sf_dir):
    return _tagged(spark, sf_dir).where(filters.quick("UP", ("tags",), ("event_type",))).select("event_id")


@query(f"WITH {TAGGED} SELECT DISTINCT 'event_type' AS facet, event_type AS value FROM e UNION SELECT 'tags', event_type FROM e UNION SELECT 'tags', 't' || CAST(k % 5 AS VARCHAR) FROM e")
def facet_values(spark, sf_dir):
    return filters.facet_values(_tagged(spark, sf_dir), ["event_type"], ["tags"])


@query("SELECT doc_id FROM labels WHERE CASE WHEN quality = 1 THEN 3 ELSE 1 END >= 2 AND toxic = 0")
def certainty_minimum(spark, sf_dir):
    level = F.when(F.col("quality") == 1, "certain").otherwise("possible")
    return table(spark, sf_dir, "labels").withColumn("level", level).where(filters.certainty_at_least("level", "probable") & (F.col("toxic") == 0)).select("doc_id")


SPANS = "s AS (SELECT event_id, event_type, user_id, epoch(ts) AS a, epoch(ts) + 60 * (1 + CAST(json_extract_string(props, '$.k') AS INT) % 30) AS b FROM events)"


def _spans(spark, sf_dir, kind, p):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias(p), at.alias(f"{p}0"), (at + 60 * (1 + k % 30)).alias(f"{p}1"))


@query(f"WITH {SPANS} SELECT x.event_id AS x, y.event_id AS y FROM s x JOIN s y ON x.a <= y.b AND x.b >= y.a WHERE x.event_type = 'error' AND y.event_type = 'signup'")
def event_overlap(spark, sf_dir):
    return joins.interval_overlap(_spans(spark, sf_dir, "error", "x"), _spans(spark, sf_dir, "signup", "y"), ("x0", "x1"), ("y0", "y1"), 1800.0).select("x", "y")


@query(f"WITH {SPANS} SELECT x.event_id AS x, y.event_id AS y, round(1 - abs(x.a - y.a) / 120, 4) AS score FROM s x JOIN s y ON abs(x.a - y.a) <= 120 WHERE x.event_type = 'error' AND y.event_type = 'signup'")
def band_join_contemporary(spark, sf_dir):
    x, y = _spans(spark, sf_dir, "error", "x").select("x", "x0"), _spans(spark, sf_dir, "signup", "y").select("y", "y0")
    return joins.band(x, y, "x0", "y0", 120.0).select("x", "y", F.round(1 - F.abs(F.col("x0") - F.col("y0")) / 120, 4).alias("score"))


@query(f"WITH {SPANS}, u AS (SELECT min(a) + 86400 AS lo, min(a) + 2 * 86400 AS hi FROM s) SELECT event_id FROM s, u WHERE a <= hi AND b >= lo")
def events_in_range(spark, sf_dir):
    """Events that overlap the second day: the day's limits are one row."""
    e = table(spark, sf_dir, "events").withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("b", F.col("a") + 60 * (1 + F.get_json_object("props", "$.k").cast("int") % 30))
    day = e.agg((F.min("a") + 86400).alias("lo"), (F.min("a") + 2 * 86400).alias("hi"))
    return e.crossJoin(F.broadcast(day)).where(dates.intervals_overlap(F.col("a"), F.col("b"), F.col("lo"), F.col("hi"))).select("event_id")


@query("""SELECT year, place, o_orderkey FROM (SELECT o_orderkey, CAST(floor(year(o_orderdate) / 2) * 2 AS INT) AS year, row_number() OVER (PARTITION BY floor(year(o_orderdate) / 2) ORDER BY o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 25""")
def year_bucket_stack(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", dates.bucket(F.year("o_orderdate"), 2).alias("year"))
    return o.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy("o_orderdate", "o_orderkey"))).where("place <= 25").select("year", "place", "o_orderkey")


@query("""WITH c AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders)
  SELECT v AS value, round((SELECT avg(o_totalprice) FROM orders), 4) AS mean, n FROM c WHERE r = floor(n * 0.95) + 1""")
def p95_nearest_rank(spark, sf_dir):
    return quality.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", 0.95).select("value", F.round("mean", 4).alias("mean"), "n")


DIST = """d AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN (o_totalprice + o_totalprice + 1000) / 2 WHEN 1 THEN o_totalprice ELSE (o_totalprice + o_totalprice + 900 + o_totalprice + 300) / 3 END AS m,
  CASE o_orderkey % 3 WHEN 0 THEN 1000 / sqrt(12.0) WHEN 1 THEN 200.0 ELSE sqrt((300.0 * 300 + 900.0 * 900 - 300.0 * 900) / 18) END AS s FROM orders)"""


def _distributions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "uniform").when(F.col("o_orderkey") % 3 == 1, "normal").otherwise("triangular")
    b = F.when(kind == "uniform", p + 1000).when(kind == "normal", F.lit(200.0)).otherwise(p + 900)
    args = (kind, p, b, p + 300, F.lit(1.0))
    return o.select("o_orderkey", "o_custkey", kind.alias("kind"), p.alias("a"), b.alias("b"), (p + 300).alias("c"), probability.mean(*args).alias("m"), probability.std(*args).alias("s"))


@query(f"WITH {DIST} SELECT o_orderkey, round(m, 2) AS m, round(s, 2) AS s FROM d")
def distribution_moments(spark, sf_dir):
    return _distributions(spark, sf_dir).select("o_orderkey", F.round("m", 2).alias("m"), F.round("s", 2).alias("s"))


@query(f"""WITH {DIST}, c AS (SELECT o_custkey, avg(m) AS m, avg(s * s + m * m) AS q FROM d GROUP BY o_custkey) SELECT o_custkey, round(m, 6) AS m, round(sqrt(greatest(q - m * m, 0)), 3) AS s FROM c""")
def distribution_combine(spark, sf_dir):
    d = _distributions(spark, sf_dir).withColumn("w", F.lit(1.0))
    m, s = probability.combined("m", "s", "w")
    return d.groupBy("o_custkey").agg(F.round(m, 6).alias("m"), F.round(s, 3).alias("s"))


@query("""WITH p AS (SELECT user_id, list(0.5 + (event_id % 50) / 100.0 ORDER BY event_id) AS c FROM events WHERE event_type = 'signup' GROUP BY user_id)
  SELECT user_id, round(list_product(c) * pow(0.9, len(c) - 1), 9) AS confidence, round(0.7 * list_avg(c) + 0.3 * list_min(c), 9) AS overall FROM p""")
def path_decay(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    p = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (0.5 + F.col("event_id") % 50 / 100).alias("c")))).alias("l")).select("user_id", F.transform("l", lambda x: x["c"]).alias("c"))
    return p.select("user_id", F.round(probability.path_confidence(F.col("c")), 9).alias("confidence"), F.round(probability.aggregate_confidence(F.col("c")), 9).alias("overall"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts_by_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return window_counts(e, "ts", "event_type").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "ts", "user_id").select("user_id", "start", "n")


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'P' THEN 30.0 ELSE (1 - (o_orderkey % 100) / 100.0) * 50 END + 20.0 * CAST(o_orderstatus <> 'F' AS INT) + 15.0 * CAST(o_totalprice > 400000 AS INT) + 10, 6) AS priority FROM orders ORDER BY priority DESC, o_orderkey LIMIT 100")
def review_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 100 / 100)
    p = quality.review_priority(score, F.col("o_orderstatus") == "F", F.lit(False), F.col("o_totalprice") > 400000)
    return o.select("o_orderkey", F.round(p, 6).alias("priority")).orderBy(F.desc("priority"), "o_orderkey").limit(100)


@query(f"WITH {TAGGED}, v AS (SELECT event_id, 'range' AS rule, 'error' AS severity FROM e WHERE k > 95 UNION ALL SELECT event_id, 'value', 'warning' FROM e WHERE value < 1 UNION ALL SELECT event_id, 'kind', 'info' FROM e WHERE event_type = 'error') SELECT rule, severity, count(*) AS n FROM v GROUP BY ALL")
def rule_violations(spark, sf_dir):
    rules = {"range": ("error", F.col("k") > 95), "value": ("warning", F.col("value") < 1), "kind": ("info", F.col("event_type") == "error")}
    return quality.violations(_tagged(spark, sf_dir), "event_id", rules).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
