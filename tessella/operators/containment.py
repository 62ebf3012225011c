"""Words inside other words, and the lexicon aligner built on them.

A word of three letters or more can only be inside words that hold its rarest letter triple, so
the triples of the longer words are the index, and each shorter word is looked up under one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

LEAST_CHARS = 3
# How sure each kind of match is, and how many are kept of a source word.
EXACT, INSIDE, STEM = 0.9, 0.8, 0.7
BEST = 2
STRIPPED = ".,!?;:"


def triples(word: Column) -> Column:
    """The different letter triples of a word; none below three letters."""
    n = F.length(word)
    at = F.when(n >= LEAST_CHARS, F.sequence(F.lit(1), n - (LEAST_CHARS - 1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(word, i, F.lit(LEAST_CHARS))))


def indexed(words: DataFrame, word: str) -> DataFrame:
    """``words`` once for each triple, as ``gram``."""
    return words.select("*", F.explode(triples(F.col(word))).alias("gram"))


def rarest(parts: DataFrame, word: str, wholes: DataFrame) -> DataFrame:
    """(word, gram): the triple of each different word that fewest rows of ``wholes`` (gram) have; words with a triple that no row has are left out."""
    held = wholes.groupBy("gram").agg(F.count("*").alias("held"))
    looked = indexed(parts.select(F.col(word).alias("word")).distinct(), "word").join(held, "gram", "left")
    least = looked.groupBy("word").agg(F.min(F.struct("held", "gram")).alias("m"), F.count_if(F.col("held").isNull()).alias("none"))
    return least.where("none = 0").select("word", "m.gram")


def contained(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole): the different pairs in which the first word, of three letters or more, is inside the second."""
    index = indexed(wholes.select(F.col(whole).alias("whole")).distinct(), "whole")
    keys = rarest(parts, part, index)
    return keys.join(index, "gram").where(F.contains("whole", "word")).select(F.col("word").alias(part), F.col("whole").alias(whole))


def lemma_levels(words: DataFrame, lexicon: DataFrame, clean: Column, prefixes: str = "", slack: int | None = 3, heads: bool = False) -> DataFrame:
    """(word, form, level) for every different ``word`` that the forms of ``lexicon`` (form) answer.

    Levels: 1 the cleaned word, 2 the word itself, 3 and 4 the cleaned word without one or two of
    the ``prefixes``, 5 a form inside the cleaned word or the other way round, both of three letters or
    more and at most ``slack`` letters apart; with ``heads`` also a form with the same first three
    letters. The best level counts, then the smallest form. ``clean`` is an expression over ``word``.
    """
    forms = written(lexicon.select("form").where("form IS NOT NULL").distinct(), "forms")
    asked = written(words.select("word").where("word IS NOT NULL").distinct().withColumn("clean", clean), "asked")
    cut = lambda n: F.when((F.length("clean") > n) & (F.translate(F.substring("clean", 1, n), prefixes, "") == ""), F.substr("clean", F.lit(n + 1)))
    tries = F.array(*[F.struct(F.lit(level).alias("level"), c.alias("form")) for level, c in ((1, F.col("clean")), (2, F.col("word")), *(((3, cut(1)), (4, cut(2))) if prefixes else ()))])
    direct = asked.select("word", F.explode(tries).alias("x")).select("word", "x.level", "x.form").join(forms, "form")
    direct = written(direct.groupBy("word").agg(F.min(F.struct("level", "form")).alias("m")), "direct")
    rest = asked.join(direct.select("word"), "word", "left_anti").where(F.length("clean") >= LEAST_CHARS)
    longer = forms.where(F.length("form") >= LEAST_CHARS)
    pairs = contained(rest, longer, "clean", "form").unionByName(contained(longer, rest, "form", "clean"))
    if slack is not None:
        pairs = pairs.where(F.abs(F.length("clean") - F.length("form")) <= slack)
    first = pairs.groupBy("clean").agg(F.min("form").alias("form"))
    if heads:
        head = lambda c: F.substring(c, 1, LEAST_CHARS)
        least = longer.groupBy(head("form").alias("head")).agg(F.min("form").alias("form"))
        first = first.unionByName(rest.select("clean").distinct().join(least, head("clean") == F.col("head")).select("clean", "form")).groupBy("clean").agg(F.min("form").alias("form"))
    loose = rest.join(first, "clean").select("word", "form", F.lit(5).alias("level"))
    return direct.select("word", "m.form", "m.level").unionByName(loose)


def lexicon_matches(tokens: DataFrame, targets: DataFrame, key: list[str], least: float = 0.0) -> DataFrame:
    """(key, s_idx, t_idx, confidence, gloss): the two surest targets of every source token.

    tokens: (key, s_idx, glosses array<string>, verb boolean, marker boolean); targets: (key, t_idx, word).
    A target that equals a gloss counts 0.9, one inside a gloss or the other way round (both of three
    letters or more) 0.8, and for verbs one with the same first three letters 0.7; the surest gloss
    counts, then the first. Ties go to the earlier target. A marker, which has no translation, is
    also given target -1 at 1.0.
    """
    said = F.lower(F.btrim(F.col("word"), F.lit(STRIPPED)))
    tokens = written(tokens.select(*key, "s_idx", "glosses", "verb", "marker"), "tokens")
    t = written(targets.select(*key, "t_idx", said.alias("said")).where(said.isNotNull()), "targets")
    g = tokens.select(*key, "s_idx", "verb", F.posexplode("glosses").alias("place", "text")).where("text IS NOT NULL").withColumn("gloss", F.lower("text"))
    out = [*key, "s_idx", "t_idx", "confidence", "place", "text"]
    # Only targets that some gloss may match travel. Heads and triples are short, so there are few different ones.
    kinds = written(g.select("gloss", "verb").distinct(), "kinds")
    alike = t.withColumnRenamed("said", "gloss").join(kinds, "gloss", "left_semi")
    exact = g.join(alike, [*key, "gloss"]).withColumn("confidence", F.lit(EXACT)).select(out)
    grams_t, grams_g = indexed(t, "said"), indexed(g, "gloss")
    few = written(rarest(kinds.select("gloss"), "gloss", grams_t).withColumnRenamed("word", "gloss"), "grams")
    held = grams_t.join(F.broadcast(few.select("gram").distinct()), "gram", "left_semi")
    # Equal words are matched above, and surer.
    glosses = g.join(few, "gloss").join(held, [*key, "gram"]).where(F.contains("said", "gloss") & (F.col("said") != F.col("gloss")))
    names = indexed(kinds.select("gloss").distinct(), "gloss")
    parts = rarest(t, "said", grams_g).join(names, "gram").where(F.contains("gloss", "word") & (F.col("gloss") != F.col("word")))
    parts = written(parts.select(F.col("word").alias("said"), "gram").distinct(), "parts")
    held = grams_g.join(F.broadcast(parts.select("gram").distinct()), "gram", "left_semi")
    saids = t.join(parts, "said").join(held, [*key, "gram"]).where(F.contains("gloss", "said") & (F.col("said") != F.col("gloss")))
    inside = glosses.select(*key, "s_idx", "t_idx", "place", "text").union(saids.select(*key, "s_idx", "t_idx", "place", "text")).withColumn("confidence", F.lit(INSIDE)).select(out)
    head = lambda c: F.when(F.length(c) >= LEAST_CHARS, F.substring(c, 1, LEAST_CHARS)).alias("head")
    begun = F.broadcast(kinds.where("verb").select(head("gloss")).distinct())
    stems = t.select("*", head("said")).join(begun, "head", "left_semi")
    stem = g.where("verb").select("*", head("gloss")).join(stems, [*key, "head"]).withColumn("confidence", F.lit(STEM)).select(out)
    pair = exact.unionByName(inside).unionByName(stem).groupBy(*key, "s_idx", "t_idx").agg(F.max(F.struct("confidence", (-F.col("place")).alias("early"), "text")).alias("m"))
    order = Window.partitionBy(*key, "s_idx").orderBy(F.desc("confidence"), "t_idx")
    scored = pair.select(*key, "s_idx", "t_idx", "m.confidence", F.col("m.text").alias("gloss")).where(F.col("confidence") >= least)
    best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= BEST).drop("n")
    marks = tokens.where("marker").select(*key, "s_idx", F.lit(-1).cast(targets.schema["t_idx"].dataType).alias("t_idx"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("gloss"))
    return best.unionByName(marks)
