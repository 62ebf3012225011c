"""Alignment of word spans: phrases found in both sentences, scored with single words, chosen by overlap.

Phrases are joined to the words that may begin them, so only the next words of a place are compared,
and no sentence is compared with a phrase it has no word of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

# What spans of like length and each method add, and when phrases may overlap.
BALANCE = 0.1
METHOD_BONUS = {"construct": 0.2, "participle": 0.2, "expansion": 0.2, "statistical": 0.1, "morphological": 0.05}
LONG_BONUS, LONG_METHODS = 0.15, ("construct", "expansion")
OVERLAP, SURE = 0.5, 0.8

CANDIDATE = ("s_start", "s_end", "t_start", "t_end", "confidence", "method")


def occurrences(sentences: DataFrame, key: list[str], words: str, phrases: DataFrame, phrase: str, shared: list[str] | None = None) -> DataFrame:
    """Rows of ``phrases`` with the key and the ``start`` of every place where ``words`` continue with ``phrase``.

    With ``shared`` (the key) each phrase is looked for in its own sentence only. Empty and null
    phrases are nowhere.
    """
    p = phrases.where(F.size(phrase) > 0).withColumn("_word", F.get(phrase, F.lit(0)))
    longest = p.agg(F.max(F.size(phrase))).first()[0] or 1
    places = sentences.select(*key, F.col(words).alias("_all"), F.posexplode(words).alias("start", "_word"))
    places = places.select(*key, "start", "_word", F.slice("_all", F.col("start") + 1, longest).alias("_next"))
    return places.join(p, [*(shared or []), "_word"]).where(F.slice("_next", 1, F.size(phrase)) == F.col(phrase)).drop("_word", "_next")


def in_order(words: Column, phrase: Column) -> Column:
    """struct(start, end) of the first words that hold ``phrase`` in order, others between them; null if none do."""
    n = F.size(phrase)
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("found"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(a, w):
        hit = (a["found"] < n) & (w == F.get(phrase, a["found"]))
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(hit, a["found"] + 1).otherwise(a["found"]).alias("found"),
            F.when(hit & (a["found"] == 0), a["at"]).otherwise(a["first"]).alias("first"),
            F.when(hit, a["at"]).otherwise(a["last"]).alias("last"),
        )

    loose = F.aggregate(words, nothing, step)
    return F.when(loose["found"] == n, F.struct(loose["first"].alias("start"), (loose["last"] + 1).alias("end")))


def located(sentences: DataFrame, key: list[str], words: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(key, phrase, t_start, t_end) of the phrases (key, phrase) that their sentence holds: their first place, else
    the first words that hold them in order."""
    asked = phrases.select(*key, phrase).distinct()
    first = occurrences(sentences, key, words, asked, phrase, key).groupBy(*key, phrase).agg(F.min("start").alias("t_start"))
    exact = first.withColumn("t_end", F.col("t_start") + F.size(phrase))
    rest = asked.where(F.size(phrase) > 1).join(first, [*key, phrase], "left_anti").join(sentences.select(*key, F.col(words).alias("_all")), key)
    rest = rest.where(F.size(F.array_except(phrase, "_all")) == 0).withColumn("_at", in_order(F.col("_all"), F.col(phrase))).where("_at IS NOT NULL")
    return exact.unionByName(rest.select(*key, phrase, F.col("_at.start").alias("t_start"), F.col("_at.end").alias("t_end")))


def phrase_candidates(pairs: DataFrame, key: list[str], source: str, target: str, phrases: DataFrame) -> DataFrame:
    """(key, CANDIDATE): places of phrases (source_words, target_words, base, method) whose other side is in the target."""
    pairs, phrases = written(pairs.select(*key, source, target), "pairs"), written(phrases, "phrases")
    found = written(occurrences(pairs, key, source, phrases, "source_words"), "found")
    found = found.join(located(pairs, key, target, found, "target_words"), [*key, "target_words"])
    return found.select(*key, F.col("start").alias("s_start"), (F.col("start") + F.size("source_words")).alias("s_end"), "t_start", "t_end", F.col("base").alias("confidence"), "method")


def scored(candidates: DataFrame, least: float = 0.3) -> DataFrame:
    """Candidates with span and method bonuses, 1 at most; those below ``least`` go."""
    s, t = F.col("s_end") - F.col("s_start"), F.col("t_end") - F.col("t_start")
    bonus = reduce(lambda c, m: c.when(F.col("method") == m[0], m[1]), METHOD_BONUS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    long_ = F.when((s > 1) & (t > 1) & F.col("method").isin(*LONG_METHODS), LONG_BONUS).otherwise(0.0)
    value = F.col("confidence") + BALANCE * (F.least(s, t) / F.greatest(s, t)) + (bonus + long_)
    return candidates.withColumn("confidence", F.round(F.least(F.lit(1.0), value), 9)).where(F.col("confidence") >= least)


def chosen(candidates: DataFrame, key: list[str]) -> DataFrame:
    """(key, CANDIDATE): the surest candidates first (ties: the earlier, then the shorter span, then by method), each if less than half
    of either span is taken, or if it is a sure phrase. One sentence's candidates are held at a time."""
    order = F.struct((-F.col("confidence")).alias("o"), "s_start", "t_start", "s_end", "t_end", "method")
    listed = candidates.groupBy(*key).agg(F.array_sort(F.collect_set(order)).alias("all"))
    ints = "array<int>"
    start = F.struct(F.array().cast("array<int>").alias("keep"), F.array().cast(ints).alias("s"), F.array().cast(ints).alias("t"), F.lit(0).alias("i"))

    def step(a, x):
        s, t = F.sequence(x["s_start"], x["s_end"] - 1), F.sequence(x["t_start"], x["t_end"] - 1)
        free = lambda span, taken: F.size(F.array_intersect(span, taken)) < OVERLAP * F.size(span)
        takes = (free(s, a["s"]) & free(t, a["t"])) | ((-x["o"] > SURE) & x["method"].isin(*LONG_METHODS))
        return F.struct(
            F.when(takes, F.concat(a["keep"], F.array(a["i"]))).otherwise(a["keep"]).alias("keep"),
            F.when(takes, F.array_union(a["s"], s)).otherwise(a["s"]).alias("s"),
            F.when(takes, F.array_union(a["t"], t)).otherwise(a["t"]).alias("t"),
            (a["i"] + 1).alias("i"),
        )

    kept = listed.select(*key, "all", F.explode(F.aggregate("all", start, step)["keep"]).alias("i")).withColumn("x", F.get("all", F.col("i")))
    return kept.select(*key, "x.s_start", "x.s_end", "x.t_start", "x.t_end", (-F.col("x.o")).alias("confidence"), "x.method")
