"""Lexicon lookups, related words, learned translations, phrase tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import top_per_group

# What each kind of evidence adds to a pair's score.
BOOST_GLOSS, BOOST_USAGE, BOOST_FIELD = 0.4, 0.3, 0.1


def search(lexicon: DataFrame, text: str) -> DataFrame:
    """Entries whose word, transliteration or gloss contains ``text`` (any case), commonest first where counts are there."""
    low = text.lower()
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in ("word", "transliteration", "gloss")])
    return lexicon.where(hit).orderBy(F.desc("n") if "n" in lexicon.columns else F.col("strong_number"))


def look_up(tokens: DataFrame, lexicon: DataFrame, key: str = "strong") -> DataFrame:
    return tokens.join(lexicon, tokens[key] == lexicon["strong_number"], "left").drop(lexicon["strong_number"])


def related(lexicon: DataFrame) -> DataFrame:
    """(strong_number, other, relation) from lists of synonyms, antonyms and derivatives and from shared roots."""
    parts = [lexicon.select("strong_number", F.explode(c).alias("other"), F.lit(r).alias("relation")) for c, r in (("synonyms", "synonym"), ("antonyms", "antonym"), ("derivatives", "derivative"))]
    root = lexicon.where("root IS NOT NULL").select("strong_number", "root")
    same = root.join(root.withColumnRenamed("strong_number", "other"), "root").where("strong_number != other").select("strong_number", "other", F.lit("same_root").alias("relation"))
    up = root.select("strong_number", F.col("root").alias("other"), F.lit("root").alias("relation"))
    return reduce(DataFrame.unionByName, [*parts, same, up]).distinct()


def lemma_candidates(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(word, lemma, rank): exact form 1, without one or two prefix letters 2 and 3, same first three letters 4; best rank, then first lemma."""
    w = words.select("word").distinct()
    keys = F.array(F.struct(F.lit(1).alias("rank"), F.col("word").alias("k")), F.struct(F.lit(2).alias("rank"), F.expr("substring(word, 2)").alias("k")), F.struct(F.lit(3).alias("rank"), F.expr("substring(word, 3)").alias("k")))
    exact = w.select("word", F.explode(keys).alias("x")).select("word", "x.rank", "x.k").where("length(k) >= 2").join(lemmas.select(F.col("lemma").alias("k"), "lemma"), "k").select("word", "lemma", "rank")
    head = lambda c: F.substring(c, 1, 3)
    loose = w.where("length(word) >= 3").withColumn("h", head("word")).join(lemmas.select("lemma", head("lemma").alias("h")), "h").where("abs(length(word) - length(lemma)) <= 3").select("word", "lemma", F.lit(4).alias("rank"))
    best = exact.unionByName(loose).groupBy("word").agg(F.min_by("lemma", F.struct("rank", "lemma")).alias("lemma"), F.min("rank").alias("rank"))
    return best


def usage(pairs: DataFrame, strong: str, word: str) -> DataFrame:
    """(strong, word, n, share) of translations seen in aligned pairs."""
    n = pairs.groupBy(strong, word).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(strong)))


def translation_candidates(used: DataFrame, strong: str, word: str, k: int = 5) -> DataFrame:
    return top_per_group(used, [strong], [F.desc("n"), F.asc(word)], k)


def boost(base: Column, gloss_hit: Column, share: Column, field_hit: Column) -> Column:
    """A pair's score with lexicon evidence, 1 at most."""
    add = F.when(gloss_hit, BOOST_GLOSS).otherwise(0.0) + BOOST_USAGE * F.coalesce(share, F.lit(0.0)) + F.when(field_hit, BOOST_FIELD).otherwise(0.0)
    return F.least(base + add, F.lit(1.0))


def phrase_table(links: DataFrame, key: str, src: str, tgt: str, most: int = 4, least: int = 3) -> DataFrame:
    """(source, target, n, share): word runs that are linked in step, seen at least ``least`` times.

    links: (key, s_idx, t_idx) with the sentence's token lists. A run is a stretch
    in which both indices rise by one.
    """
    w = Window.partitionBy(key).orderBy("s_idx", "t_idx")
    step = (F.col("s_idx") - F.lag("s_idx").over(w) == 1) & (F.col("t_idx") - F.lag("t_idx").over(w) == 1)
    runs = links.withColumn("_new", F.when(step, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    r = runs.groupBy(key, "_run").agg(F.min("s_idx").alias("s0"), F.min("t_idx").alias("t0"), F.count("*").alias("len"), F.first(src).alias("a"), F.first(tgt).alias("b"))
    cut = r.withColumn("n_", F.least("len", F.lit(most)))
    spans = cut.select(F.array_join(F.slice("a", F.col("s0") + 1, F.col("n_")), " ").alias("source"), F.array_join(F.slice("b", F.col("t0") + 1, F.col("n_")), " ").alias("target"))
    n = spans.groupBy("source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def semantic_field(related_: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(id, distance) of words within ``depth`` relations of a start word."""
    from .graph import bfs

    edges = related_.select(F.col("strong_number").alias("src"), F.col("other").alias("dst"))
    spark = related_.sparkSession
    return bfs(edges.union(edges.select("dst", "src")), spark.createDataFrame([(start,)], "id string"), depth)
