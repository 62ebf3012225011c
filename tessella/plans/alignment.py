"""Queries over parallel texts: a user turn and the assistant's next turn stand opposite each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import cosine
from ..operators import align, quality, search, topics
from .base import query, table
from .text import TOKENS

TURNS = f"""p AS (SELECT u.conv_id AS c, u.turn AS t, {TOKENS.replace('text', 'u.text')} AS a, {TOKENS.replace('text', 's.text')} AS b
  FROM conversations u JOIN conversations s ON u.conv_id = s.conv_id AND s.turn = u.turn + 1 WHERE u.role = 'user' AND s.role = 'assistant')"""


def turns(spark, sf_dir):
    """(c, t, a, b): all words of both turns, as one sentence pair."""
    c = table(spark, sf_dir, "conversations")
    w = text.latin_words(F.col("text"))
    u = c.where("role = 'user'").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), w.alias("a"))
    s = c.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), w.alias("b"))
    return u.join(s, ["c", "t"])


@query(f"""WITH {TURNS}, n AS (SELECT count(*) AS n FROM p WHERE len(a) > 0 AND len(b) > 0),
  x AS (SELECT DISTINCT c, t, unnest(a) AS s FROM p WHERE len(b) > 0), y AS (SELECT DISTINCT c, t, unnest(b) AS w FROM p WHERE len(a) > 0),
  xy AS (SELECT s, w, count(*) AS k FROM x JOIN y USING (c, t) GROUP BY s, w), sx AS (SELECT s, count(*) AS ks FROM x GROUP BY s), sy AS (SELECT w, count(*) AS kw FROM y GROUP BY w)
  SELECT s, w AS t, k AS pairs, round(ln(k * n / (ks * kw)), 6) AS pmi, round(1 / (1 + exp(-ln(k * n / (ks * kw)))), 6) AS score FROM xy JOIN sx USING (s) JOIN sy USING (w), n WHERE k >= 3""")
def pmi_cooccurrence(spark, sf_dir):
    m = align.pmi(align.cooccurrence(turns(spark, sf_dir), "a", "b", 3))
    return m.select("s", "t", "pairs", F.round("pmi", 6).alias("pmi"), F.round("score", 6).alias("score"))


def _em(rounds: int) -> str:
    """IBM model 1 unrolled for a fixed number of rounds."""
    parts = [
        f"""WITH {TURNS}, q AS (SELECT row_number() OVER (ORDER BY c, t) AS id, ['NULL'] || a AS a, b FROM p WHERE len(b) > 0),
  x AS (SELECT id, s, count(*) AS ns FROM (SELECT id, unnest(a) AS s FROM q) GROUP BY id, s), y AS (SELECT id, t, count(*) AS nt FROM (SELECT id, unnest(b) AS t FROM q) GROUP BY id, t),
  e AS (SELECT id, s, t, ns, nt FROM x JOIN y USING (id)), t0 AS (SELECT DISTINCT s, t, 1.0::DOUBLE / (SELECT count(DISTINCT t) FROM e) AS prob FROM e)"""
    ]
    for i in range(rounds):
        parts.append(
            f"""c{i} AS (SELECT s, t, sum(nt * prob * ns / z) AS c FROM (SELECT e.*, prob, sum(prob * ns) OVER (PARTITION BY id, t) AS z FROM e JOIN t{i} USING (s, t)) GROUP BY s, t),
  t{i + 1} AS (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS prob FROM c{i})"""
        )
    return ",\n".join(parts)


@query(_em(3) + " SELECT s, t, round(prob, 6) AS prob FROM t3 WHERE prob >= 0.01")
def ibm1_em(spark, sf_dir):
    m = align.ibm1(turns(spark, sf_dir), "a", "b", rounds=3, tolerance=0.0)
    return m.where("prob >= 0.01").select("s", "t", F.round("prob", 6).alias("prob"))


@query()
def ibm1_decode(spark, sf_dir):
    """Best source of each target word by the trained table: tested on a small parallel text."""
    p = turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "c", "t"))
    return align.decode(p, "key", "a", "b", align.ibm1(p, "a", "b", rounds=2, tolerance=0.0)).withColumn("prob", F.round("prob", 6))


@query(f"""WITH {TURNS}, x AS (SELECT c, t, len(a) AS n, unnest(generate_series(0, len(a) - 1)) AS i FROM p), y AS (SELECT c, t, len(b) AS m, unnest(generate_series(0, len(b) - 1)) AS j FROM p)
  SELECT c, t, i AS s_idx, j AS t_idx, round(least(0.5, (1 - abs(i / greatest(n - 1, 1) - j / greatest(m - 1, 1))) * 0.5 * CASE WHEN (i = 0 AND j = 0) OR (i = n - 1 AND j = m - 1) THEN 1.2 ELSE 1 END), 6) AS score FROM x JOIN y USING (c, t)""")
def position_scores(spark, sf_dir):
    p = turns(spark, sf_dir).withColumn("key", F.struct("c", "t"))
    return align.position_scores(p, "key", "a", "b").select("key.c", "key.t", F.col("s_idx").cast("long").alias("s_idx"), F.col("t_idx").cast("long").alias("t_idx"), F.round("score", 6).alias("score"))


@query()
def greedy_assignment(spark, sf_dir):
    """One-to-one pairs by score: each choice depends on earlier ones; tested against brute force."""
    p = turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "c", "t"))
    return align.greedy(align.position_scores(p, "key", "a", "b"), "key")


METHODS = "CASE l_linenumber % 3 WHEN 0 THEN 'statistical' WHEN 1 THEN 'position' ELSE 'lexicon' END"
WEIGHT = "CASE m WHEN 'statistical' THEN 0.3 WHEN 'position' THEN 0.1 ELSE 0.15 END"
SCORES = f"v AS (SELECT l_orderkey AS o, l_returnflag AS f, {METHODS} AS m, l_discount * 10 AS s FROM lineitem)"


def _scores(spark, sf_dir):
    m = F.when(F.col("l_linenumber") % 3 == 0, "statistical").when(F.col("l_linenumber") % 3 == 1, "position").otherwise("lexicon")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("f"), m.alias("method"), (F.col("l_discount") * 10).alias("score"))


#: Line items of an order as one sentence: sources by supplier, targets by part, three methods.
VOTES = """v AS (SELECT l_orderkey AS o, CAST(l_suppkey % 3 AS BIGINT) AS i, CAST(l_partkey % 3 AS BIGINT) AS j, CASE l_linenumber % 3 WHEN 0 THEN 'statistical' WHEN 1 THEN 'morphological' ELSE 'lexicon' END AS m, l_discount * 10 AS s FROM lineitem),
  b AS (SELECT o, i, j, sum(CASE m WHEN 'statistical' THEN 0.3 WHEN 'morphological' THEN 0.2 ELSE 0.15 END * s ORDER BY m, s) AS base, count(DISTINCT m) AS n, max(s) - min(s) AS spread, bool_or(m = 'statistical') AS st, bool_or(m = 'morphological') AS mo FROM v GROUP BY o, i, j)"""


def _votes(spark, sf_dir):
    m = F.when(F.col("l_linenumber") % 3 == 0, "statistical").when(F.col("l_linenumber") % 3 == 1, "morphological").otherwise("lexicon")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 3).alias("s_idx"), (F.col("l_partkey") % 3).alias("t_idx"), m.alias("method"), (F.col("l_discount") * 10).alias("score"))


#: Each source in turn takes its best target that is left, in SQL as a recursion over the sources of an order.
IN_TURN = """c AS (SELECT o, i, list({'j': j, 'base': round(base, 12)} ORDER BY round(base, 12) DESC, j) AS cand, max(round(base, 12)) AS top FROM b GROUP BY o, i),
  r AS (SELECT o, i, cand, row_number() OVER (PARTITION BY o ORDER BY top DESC, i DESC) AS k FROM c),
  t AS (SELECT o, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT o FROM r)
    UNION ALL SELECT o, k, i, CASE WHEN p.base > 0.05 THEN p.j END, CASE WHEN p.base > 0.05 THEN list_append(used, p.j) ELSE used END
    FROM (SELECT t.o, r.k, r.i, used, list_filter(cand, lambda x : NOT list_contains(used, x.j))[1] AS p FROM t JOIN r ON r.o = t.o AND r.k = t.k + 1))"""


@query(f"""WITH RECURSIVE {VOTES}, {IN_TURN}
  SELECT o, i, j, n AS methods, floor(1000000 * least(1, base * CASE WHEN n > 1 THEN (1 + 0.15 * (n - 1) * (1 - spread)) * CASE WHEN st AND mo THEN 1.1 ELSE 1 END * CASE WHEN n >= 3 THEN 1.15 ELSE 1 END ELSE 1 END * CASE WHEN st THEN 1.05 ELSE 1 END) + 0.5) / 1000000 AS confidence
  FROM t JOIN b USING (o, i, j)""")
def ensemble_weighted_vote(spark, sf_dir):
    e = align.ensemble(_votes(spark, sf_dir), "o")
    return e.select("o", F.col("s_idx").alias("i"), F.col("t_idx").alias("j"), "methods", (F.floor(1000000 * F.col("confidence") + 0.5) / 1000000).alias("confidence"))


@query(f"WITH RECURSIVE {VOTES}, {IN_TURN} SELECT o, i, j, round(base, 6) AS score FROM t JOIN b USING (o, i, j)")
def assignment_by_source(spark, sf_dir):
    w = F.when(F.col("method") == "statistical", 0.3).when(F.col("method") == "morphological", 0.2).otherwise(0.15)
    summed = _votes(spark, sf_dir).groupBy("o", "s_idx", "t_idx").agg(F.sum(w * F.col("score")).alias("score"))
    return align.by_source(summed, "o").select("o", F.col("s_idx").alias("i"), F.col("t_idx").alias("j"), F.round("score", 6).alias("score"))


@query(f"""WITH {SCORES}, g AS (SELECT o, f, max(s) + CASE WHEN count(DISTINCT m) >= 2 THEN least(count(DISTINCT m) / 5, 0.3) ELSE 0 END + CASE WHEN bool_or(m = 'lexicon') THEN 0.3 ELSE 0 END AS raw FROM v GROUP BY o, f)
  SELECT o, f, round(least(raw, 0.98), 6) AS score FROM g WHERE raw >= 0.55""")
def calibrated_ensemble(spark, sf_dir):
    return align.calibrated(_scores(spark, sf_dir), ["o", "f"], 0.55).select("o", "f", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORES} SELECT o, round(sum({WEIGHT} * s) / sum({WEIGHT}), 6) AS score, arg_max(m, (s, m)) AS best FROM v GROUP BY o""")
def weighted_group_merge(spark, sf_dir):
    g = quality.merged(_scores(spark, sf_dir), ["o"], "method", "score", {"statistical": 0.3, "position": 0.1, "lexicon": 0.15})
    return g.select("o", F.round("score", 6).alias("score"), "best")


@query(f"""WITH {SCORES}, g AS (SELECT o, f, sum(CASE m WHEN 'statistical' THEN 0.6 WHEN 'lexicon' THEN 0.4 ELSE 0 END * s) AS s FROM v GROUP BY o, f), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY s DESC, f) AS k FROM g)
  SELECT o, round(s, 6) AS score FROM r WHERE k = 1 AND s > 0.705""")
def threshold_combine(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("f_code", F.ascii("f"))
    return align.threshold_combine(s, ["o"], "f_code", {"statistical": 0.6, "lexicon": 0.4}, 0.705).select("o", F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_discount > 0.05), g AS (SELECT l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_quantity > 25), x AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS found, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS gold, (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS hits) SELECT found, gold, hits, round(hits / found, 6) AS precision, round(hits / gold, 6) AS recall, round(2.0 * hits / (found + gold), 6) AS f1, round(1 - 2.0 * hits / (found + gold), 6) AS error_rate FROM x")
def prf_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pairs = lambda c: li.where(c).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    e = align.evaluate(pairs("l_discount > 0.05"), pairs("l_quantity > 25"), ["o", "l"])
    return e.select(*[F.col(c).cast("long").alias(c) for c in ("found", "gold", "hits")], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "error_rate")])


@query("""WITH n AS (SELECT l_orderkey AS o, l_suppkey % 10 AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), u AS (SELECT o, k, max(n) / sum(n) AS s, sum(n) AS rows FROM n GROUP BY o, k)
  SELECT k, round(avg(s), 6) AS consistency, CAST(sum(rows) AS BIGINT) AS rows FROM u GROUP BY k""")
def mode_share_consistency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 10).alias("k"), F.col("l_returnflag").alias("v"))
    return align.mode_share(li, ["o"], "k", "v").withColumn("consistency", F.round("consistency", 6))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS i FROM lineitem WHERE l_linenumber <> 4), g AS (SELECT o, i, i - row_number() OVER (PARTITION BY o ORDER BY i) AS island FROM d),
  h AS (SELECT o, i, island, floor((row_number() OVER (PARTITION BY o, island ORDER BY i) - 1) / 2) AS part FROM g) SELECT o, min(i) AS start, count(*) AS length FROM h GROUP BY o, island, part""")
def consecutive_runs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <> 4").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"))
    return align.runs(li, ["o"], "i", 2)


@query("SELECT l_suppkey, l_shipmode_ AS value, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 6) AS share FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode_, count(*) AS n FROM lineitem GROUP BY ALL)")
def share_of_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("value"))
    return align.share(li, ["l_suppkey"], "value").withColumn("share", F.round("share", 6))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
  s AS (SELECT vec_id, c.label AS topic, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) AS score FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, vec_id) AS place FROM s)
  SELECT topic, vec_id, round(score, 5) AS score FROM r WHERE place <= 5""")
def argmax_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = topics.nearest(e, topics.centres(e, "label", "embedding"), "label", "embedding", 5, "vec_id")
    return near.select("topic", "vec_id", F.round("score", 5).alias("score"))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
  s AS (SELECT vec_id, c.label AS topic, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 5) AS score FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) AS place FROM s)
  SELECT vec_id, topic, score FROM r WHERE place <= 2""")
def top2_topics(spark, sf_dir):
    """The two nearest centres of every vector; there are as many centres as labels."""
    e = table(spark, sf_dir, "embeddings")
    c = topics.centres(e, "label", "embedding").withColumnRenamed("label", "topic")
    s = e.crossJoin(c).select("vec_id", "topic", F.round(cosine(F.col("embedding"), F.col("centre")), 5).alias("score"))
    return search.top_per_group(s, ["vec_id"], [F.desc("score"), F.asc("topic")], 2).select("vec_id", "topic", "score")


@query(f"""WITH w AS (SELECT {TOKENS} AS w FROM benchmark), x AS (SELECT w[i] AS word, unnest(w[greatest(i - 2, 1) : i - 1] || w[i + 1 : i + 2]) AS context FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 1)),
  n AS (SELECT word, context, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT sum(n) AS a FROM n), b AS (SELECT word, sum(n) AS nw FROM n GROUP BY word), c AS (SELECT context, sum(n) AS nc FROM n GROUP BY context)
  SELECT word, context, n, round(greatest(ln(n * a / (nw * nc)), 0), 6) AS ppmi FROM n JOIN b USING (word) JOIN c USING (context), a WHERE n >= 2""")
def window_ppmi(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", text.latin_words(F.col("text")).alias("w"))
    return align.window_ppmi(b, "item_id", "w", 2).where("n >= 2").withColumn("ppmi", F.round("ppmi", 6))


CLUSTER = f"""n AS (SELECT lang AS c, w, count(*) AS n FROM (SELECT lang, unnest({TOKENS}) AS w FROM documents) GROUP BY ALL), s AS (SELECT c, sum(n) AS s FROM n GROUP BY c), m AS (SELECT avg(s) AS m FROM s), t AS (SELECT w, sum(n) AS tf FROM n GROUP BY w),
  x AS (SELECT c, w, n / s * ln(1 + m / tf) AS weight FROM n JOIN s USING (c) JOIN t USING (w), m), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY weight DESC, w) AS place FROM x)"""


def _tops(spark, sf_dir, k=20):
    n = table(spark, sf_dir, "documents").select(F.col("lang").alias("c"), F.explode(text.latin_words(F.col("text"))).alias("w")).groupBy("c", "w").agg(F.count("*").alias("n"))
    return topics.top_terms(topics.class_tf_idf(n, "c", "w", "n"), "c", "w", k)


@query(f"WITH {CLUSTER} SELECT c, w, place, round(weight, 8) AS weight FROM r WHERE place <= 20")
def c_tf_idf_by_language(spark, sf_dir):
    return _tops(spark, sf_dir).select("c", "w", "place", F.round("weight", 8).alias("weight"))


@query(f"""WITH {CLUSTER}, top AS (SELECT c, w FROM r WHERE place <= 5), d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) WHERE w IN (SELECT w FROM top)),
  nd AS (SELECT count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({TOKENS}) FROM documents)), u AS (SELECT w, count(*) AS k FROM d GROUP BY w), ab AS (SELECT x.w AS a, y.w AS b, count(*) AS k FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.w < y.w GROUP BY ALL)
  SELECT p.c, round(avg(ln(ab.k * nd.n / (ua.k * ub.k))), 6) AS coherence, count(*) AS pairs FROM (SELECT x.c, x.w AS a, y.w AS b FROM top x JOIN top y ON x.c = y.c AND x.w < y.w) p JOIN ab USING (a, b) JOIN u ua ON ua.w = a JOIN u ub ON ub.w = b, nd GROUP BY p.c""")
def topic_coherence(spark, sf_dir):
    presence = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.latin_words(F.col("text")))).alias("w"))
    return topics.coherence(_tops(spark, sf_dir, 5), presence, "c", "w", "doc_id").withColumn("coherence", F.round("coherence", 6))


@query(f"WITH {CLUSTER}, g AS (SELECT c, list(w) AS t FROM r WHERE place <= 20 GROUP BY c) SELECT x.c AS a, y.c AS b, round(len(list_intersect(x.t, y.t)) / (40 - len(list_intersect(x.t, y.t))), 6) AS jaccard FROM g x JOIN g y ON x.c < y.c")
def topic_merge_jaccard(spark, sf_dir):
    return topics.alike(_tops(spark, sf_dir), "c", "w", 0.0).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT item_id, topic FROM benchmark, (VALUES ('law', ['lex', 'ley']), ('time', ['THE'])) AS v(topic, synonyms) WHERE len(list_filter(synonyms, lambda s : contains(lower(text), lower(s)))) > 0")
def topics_for_text(spark, sf_dir):
    t = spark.createDataFrame([("law", ["lex", "ley"]), ("time", ["THE"])], "topic string, synonyms array<string>")
    return topics.keyword_topics(table(spark, sf_dir, "benchmark"), "text", t).select("item_id", "topic")


@query("SELECT c, t, role, next_role, n FROM (SELECT conv_id AS c, turn AS t, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE next_role IS NOT NULL")
def next_in_order(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    return c.where("next_role IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", "next_role", "n")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) + 1 AS chunk FROM conversations")
def chunk_numbering(spark, sf_dir):
    from ..sources.sinks import numbered_chunks

    return numbered_chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3)
