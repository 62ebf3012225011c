"""Queries over texts: scans, index, ranking, coverage, phrases, similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scripts, text
from ..operators import filters, joins, quality, search, sets
from ..operators.tables import written
from .base import query, table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: Tokens of a-z, as both engines see them.
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY doc_id")
def doc_scan_filter(spark, sf_dir):
    return docs(spark, sf_dir).where("lang = 'en' AND source = 'src1'").select("doc_id", "n_chars").orderBy("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE text LIKE '%stupid%'")
def doc_like_search(spark, sf_dir):
    return docs(spark, sf_dir).where("text LIKE '%stupid%'").select("doc_id", "lang")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def group_count_order(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean_chars FROM documents")
def collection_stats(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10")
def longest_per_language(spark, sf_dir):
    return search.top_per_group(docs(spark, sf_dir).select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 10).select("lang", "doc_id")


@query("""SELECT doc_id, score FROM (SELECT doc_id, CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'stupid') AS INT) + CAST(contains(t, 'token') AS INT) + CAST(contains(t, 'qui') AS INT) AS score
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)) WHERE score * 2 >= 4""")
def keyword_search_half(spark, sf_dir):
    d = docs(spark, sf_dir)
    return filters.keyword_search(d.select("doc_id", "text"), F.col("text"), "the stupid token qui", "doc_id").select("doc_id", "score")


def _postings(spark, sf_dir):
    d = docs(spark, sf_dir)
    return search.postings(d, "doc_id", text.without_stop_words(text.latin_words(F.col("text"))))


TOK = f"tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), kept AS (SELECT * FROM tok WHERE term NOT IN ({STOP}))"


@query(f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM kept GROUP BY term")
def token_df(spark, sf_dir):
    d = search.document_frequency(_postings(spark, sf_dir))
    return d.select("term", "df", F.col("cf").cast("long").alias("cf"))


@query(f"""WITH {TOK} SELECT term, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest
  FROM (SELECT DISTINCT term, doc_id FROM kept) GROUP BY term""")
def token_inverted_index(spark, sf_dir):
    i = search.inverted_index(_postings(spark, sf_dir))
    return i.select("term", F.size("docs").cast("long").alias("n"), F.md5(F.array_join(F.transform("docs", lambda x: x.cast("string")), ",")).alias("digest"))


@query(f"""WITH tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
  len AS (SELECT doc_id, len({TOKENS}) AS length FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('stupid', 'the', 'mail') GROUP BY doc_id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS n, avg(length) AS avg_length FROM len)
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
  FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_topk(spark, sf_dir):
    d = docs(spark, sf_dir)
    scored = search.bm25(d, "doc_id", text.latin_words(F.col("text")), ["stupid", "the", "mail"])
    return search.top(scored.withColumn("score", F.round("score", 6)), 50)


def _tokens(spark, sf_dir, column="word"):
    return docs(spark, sf_dir).select("doc_id", F.explode(text.latin_words(F.col("text"))).alias(column))


STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) > {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in text.STEM_SUFFIXES) + " ELSE w END"


@query(f"SELECT {STEM} AS stem, CAST(sum(n) AS BIGINT) AS n FROM (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY w) GROUP BY 1")
def simple_stem_counts(spark, sf_dir):
    counts = _tokens(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return counts.groupBy(text.simple_stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


@query("""SELECT CASE WHEN ends_with(l, 'ing') OR ends_with(l, 'ed') THEN 'verb' WHEN ends_with(l, 'ly') THEN 'adverb' WHEN ends_with(l, 'ness') OR ends_with(l, 'tion') THEN 'noun'
  WHEN left(w, 1) <> lower(left(w, 1)) AND w NOT IN ('I', 'The', 'A', 'An') THEN 'proper_noun' WHEN l IN ('the', 'a', 'an', 'this', 'that', 'these', 'those') THEN 'determiner'
  WHEN l IN ('he', 'she', 'it', 'they', 'we', 'you', 'i') THEN 'pronoun' ELSE 'other' END AS pos, count(*) AS n
  FROM (SELECT w, lower(w) AS l FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+')) AS w FROM documents)) GROUP BY 1""")
def guess_pos_counts(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.explode(text.ascii_words(F.col("text"))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).groupBy(text.guess_pos(F.col("w")).alias("pos")).agg(F.sum("n").alias("n"))


@query(f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY w)
  SELECT CASE WHEN n >= 100 THEN '100+' WHEN n >= 10 THEN '10-99' WHEN n >= 2 THEN '2-9' ELSE '1' END AS band, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY 1""")
def frequency_band_counts(spark, sf_dir):
    return quality.frequency_bands(_tokens(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")))


@query(f"""WITH c AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest({TOKENS}) AS w FROM documents) GROUP BY source, w)
  SELECT source, CAST(count_if(n = 1) AS BIGINT) AS hapax, count(*) AS kinds, round(100.0 * count_if(n = 1) / count(*), 6) AS percent FROM c GROUP BY source""")
def hapax_share(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", F.explode(text.latin_words(F.col("text"))).alias("w"))
    c = d.groupBy("source", "w").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.count_if(F.col("n") == 1).alias("hapax"), F.count("*").alias("kinds"), F.round(100.0 * F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("percent"))


@query(f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY w),
  k AS (SELECT DISTINCT unnest({TOKENS}) AS w FROM benchmark)
  SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (k.w IS NOT NULL), 0) AS BIGINT) AS known_tokens, count(*) AS kinds, count(k.w) AS known_kinds FROM c LEFT JOIN k USING (w)""")
def vocabulary_coverage(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(text.latin_words(F.col("text"))).alias("w"))
    return quality.coverage(_tokens(spark, sf_dir), "word", known, "w")


@query(f"""WITH k AS (SELECT DISTINCT unnest({TOKENS}) AS w FROM benchmark), d AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents),
  s AS (SELECT doc_id, avg(CASE WHEN k.w IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM d LEFT JOIN k USING (w) GROUP BY doc_id)
  SELECT CASE WHEN share > 0.8 THEN 'high' WHEN share >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS docs, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std FROM s GROUP BY 1""")
def document_coverage_bands(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(text.latin_words(F.col("text"))).alias("word")).distinct().withColumn("hit", F.lit(1.0))
    s = _tokens(spark, sf_dir).groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(known, "word", "left")
    s = s.groupBy("doc_id").agg((F.sum(F.col("n") * F.coalesce("hit", F.lit(0.0))) / F.sum("n")).alias("share"))
    band = F.when(F.col("share") > 0.8, "high").when(F.col("share") >= 0.5, "medium").otherwise("low")
    return s.groupBy(band.alias("band")).agg(F.count("*").alias("docs"), F.round(F.avg("share"), 6).alias("mean"), F.round(F.stddev_pop("share"), 6).alias("std"))


@query(f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) GROUP BY w), k AS (SELECT DISTINCT unnest({TOKENS}) AS w FROM benchmark)
  SELECT w AS word, n FROM c WHERE w NOT IN (SELECT w FROM k) ORDER BY n DESC, w LIMIT 50""")
def top_uncovered_words(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(text.latin_words(F.col("text"))).alias("word")).distinct()
    return _tokens(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti").orderBy(F.desc("n"), "word").limit(50)


NGRAM = f"t AS (SELECT doc_id, {TOKENS} AS w FROM documents), g AS (SELECT n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM t, (VALUES (2), (3)) AS v(n) WHERE len(w) >= n))"


@query(f"WITH {NGRAM} SELECT phrase, count(*) AS n FROM g GROUP BY phrase HAVING count(*) >= 5")
def ngram_mining(spark, sf_dir):
    return sets.pairs_and_triples(docs(spark, sf_dir).select(text.latin_words(F.col("text")).alias("w")), "w", 5)


@query(f"""WITH {NGRAM}, c AS (SELECT phrase, n AS size, count(*) AS n FROM g GROUP BY phrase, n HAVING count(*) >= 20),
  sub AS (SELECT DISTINCT array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase FROM (SELECT phrase, unnest([1, 2]) AS i FROM c WHERE size = 3))
  SELECT phrase, n FROM c WHERE phrase NOT IN (SELECT phrase FROM sub)""")
def subphrase_filter(spark, sf_dir):
    g = sets.pairs_and_triples(docs(spark, sf_dir).select(text.latin_words(F.col("text")).alias("w")), "w", 20)
    return sets.without_subphrases(written(g, "phrases"))


@query(f"""WITH t AS (SELECT item_id, {TOKENS} AS w FROM benchmark)
  SELECT item_id, i - 1 AS start, array_to_string(w[i : i + 2], ' ') AS phrase, array_to_string(w[greatest(i - 3, 1) : i - 1], ' ') AS before, array_to_string(w[i + 3 : i + 5], ' ') AS after
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)""")
def phrase_contexts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("w", text.latin_words(F.col("text"))).where(F.size("w") >= 3)
    x = b.select("item_id", F.explode(text.context_phrases(F.col("w"), 3)).alias("x"))
    return x.select("item_id", F.col("x.start").cast("long").alias("start"), "x.phrase", F.array_join("x.left", " ").alias("before"), F.array_join("x.right", " ").alias("after"))


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS w FROM documents)
  SELECT item_id, doc_id, count(*) AS shared FROM q JOIN d USING (w) GROUP BY item_id, doc_id HAVING count(*) >= 20""")
def shared_word_pairs(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", text.latin_words(F.col("text")).alias("qw"))
    d = docs(spark, sf_dir).select("doc_id", text.latin_words(F.col("text")).alias("dw"))
    return joins.shared_words(q, d, "item_id", "doc_id", "qw", "dw", 20)


@query(f"""WITH q AS (SELECT item_id, list_distinct({TOKENS}) AS a FROM benchmark), d AS (SELECT doc_id, list_distinct({TOKENS}) AS b FROM documents),
  p AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS x, len(a) AS na, len(b) AS nb FROM q, d)
  SELECT item_id, doc_id, round(x / (na + nb - x), 6) AS jaccard FROM p WHERE x >= 3 AND x / (na + nb - x) >= 0.1""")
def jaccard_pairs(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.latin_words(F.col("text"))).alias("a"))
    d = docs(spark, sf_dir).select("doc_id", F.array_distinct(text.latin_words(F.col("text"))).alias("b"))
    p = joins.shared_words(q, d, "item_id", "doc_id", "a", "b", 3).join(q.select("item_id", F.size("a").alias("na")), "item_id").join(d.select("doc_id", F.size("b").alias("nb")), "doc_id")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return p.where(j >= 0.1).select("item_id", "doc_id", F.round(j, 6).alias("jaccard"))


@query()
def citation_join(spark, sf_dir):
    """Quotation join with string ratios (Arrow kernel): tested against difflib."""
    q, d = table(spark, sf_dir, "benchmark"), docs(spark, sf_dir)
    return joins.quotations(q, d, "item_id", "doc_id", "text", "text").select("quote_id", "text_id", "shared", F.round("ratio", 6).alias("ratio"), F.round("confidence", 6).alias("confidence"), "rank")


@query("""WITH p AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n) AS d FROM p a JOIN p b ON a.n < b.n AND split_part(a.n, ' ', 2) = split_part(b.n, ' ', 2) WHERE levenshtein(a.n, b.n) <= 3""")
def levenshtein_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    k = F.element_at(F.split("p_name", " "), 2)
    a, b = p.select(F.col("p_name").alias("a"), k.alias("k")), p.select(F.col("p_name").alias("b"), k.alias("k"))
    d = F.levenshtein("a", "b", 3)
    return a.join(b, "k").where("a < b").withColumn("d", d).where("d >= 0").select("a", "b", F.col("d").cast("long").alias("d"))


@query(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(coalesce(text, ''), '[^\p{Greek}]', '', 'g')) AS greek,
  length(regexp_replace(coalesce(text, ''), '[^\p{Hebrew}]', '', 'g')) AS hebrew FROM documents""")
def script_counts(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", *[scripts.count_of(t, s).cast("long").alias(s.lower()) for s in ("Latin", "Greek", "Hebrew")])


@query("""SELECT doc_id, md5(strip_accents(lower(text))) AS digest FROM documents""")
def diacritic_strip(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(scripts.without_marks(F.lower("text"))).alias("digest"))


# RE2's word boundary knows ASCII letters only, so the SQL states the neighbours of a word.
NORMAL_FORM = "lower(text)"
for old, new in text.ARCHAIC_FOR_COMPARISON:
    NORMAL_FORM = rf"regexp_replace({NORMAL_FORM}, '(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]){old}($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])', '\1{new}\2', 'g')"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({NORMAL_FORM}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def comparison_normal_form(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.normalise_for_comparison(F.col("text"))).alias("digest"))


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1""")
def upsert_keep_last(spark, sf_dir):
    return sets.keep_last(docs(spark, sf_dir).select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.desc("doc_id")]).select("source", "doc_id", "n_chars")


@query(f"""SELECT lang, word, n FROM (SELECT lang, w AS word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r
  FROM (SELECT lang, unnest({TOKENS}) AS w FROM documents) GROUP BY lang, w) WHERE r <= 20""")
def top_words_per_language(spark, sf_dir):
    c = docs(spark, sf_dir).select("lang", F.explode(text.latin_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return search.top_per_group(c, ["lang"], [F.desc("n"), F.asc("word")], 20).select("lang", "word", "n")


@query(f"""WITH b AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT {TOKENS} AS w FROM benchmark) WHERE len(w) > 1))
  SELECT a, b, count(*) AS n FROM b GROUP BY a, b HAVING count(*) >= 3""")
def adjacent_bigrams(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(text.latin_words(F.col("text")).alias("w")).where(F.size("w") > 1)
    g = w.select(F.explode(text.ngrams(F.col("w"), 2)).alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n >= 3")
    return g.select(F.split("g", " ")[0].alias("a"), F.split("g", " ")[1].alias("b"), "n")
