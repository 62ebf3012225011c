"""Similarity, interval, band and mapping joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratio_above
from ..functions.text import least_normalised, normalise_for_comparison
from .search import top_per_group
from .tables import written

#: What an exact quotation adds to the string ratio.
EXACT_BONUS = 0.1
#: Room for rounding in the bound that rules pairs out.
SLACK = 1e-9


def shared_words(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_words: str, right_words: str, least: int = 3) -> DataFrame:
    """(left_id, right_id, shared) of pairs with at least ``least`` different words in common."""
    a = left.select(left_id, F.explode(F.array_distinct(left_words)).alias("word"))
    b = right.select(right_id, F.explode(F.array_distinct(right_words)).alias("word"))
    return a.join(b, "word").groupBy(left_id, right_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def quotations(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, quote: str, text: str, least: int = 3, ratio: float = 0.3, confidence: float = 0.6, k: int = 10) -> DataFrame:
    """Texts that each quote may come from: enough common words, then the string ratio, then the best ``k``.

    No ratio is over twice the shorter length over both lengths, and a confidence is
    a ratio and EXACT_BONUS at most. Lengths travel with the words, so pairs that
    can't reach both bounds are dropped before common words are counted; the ratio
    kernel drops those that a bound on matched characters rules out. Texts that are too
    long by their letters alone aren't normalised; the others are, once.
    """
    least_ratio = max(ratio, confidence - EXACT_BONUS)
    times = (2 - least_ratio) / least_ratio  # how much longer one string may be
    q = quotes.select(F.col(quote_id).alias("quote_id"), normalise_for_comparison(F.col(quote)).alias("q")).withColumn("lq", F.length("q"))
    reach = F.broadcast(q.agg(F.min("lq").alias("shortest"), F.max("lq").alias("longest")))
    t = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("t")).join(reach, least_normalised(F.col("t")) <= F.col("longest") * times)
    t = t.withColumn("t", normalise_for_comparison(F.col("t"))).withColumn("lt", F.length("t"))
    # Written before lengths are compared: a condition on them would normalise each text again.
    t = written(t, "texts").where((F.col("lt") * times >= F.col("shortest")) & (F.col("lt") <= F.col("longest") * times)).drop("shortest", "longest")
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("word")
    reachable = 2 * F.least("lq", "lt") > least_ratio * (F.col("lq") + F.col("lt"))
    near = q.select("quote_id", "lq", words("q")).join(t.select("text_id", "lt", words("t")), "word").where(reachable)
    near = near.groupBy("quote_id", "text_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    scored = near.join(q, "quote_id").join(t, "text_id").withColumn("ratio", sequence_ratio_above("q", "t", least_ratio - SLACK))
    exact = F.col("t").contains(F.col("q"))
    score = F.least(F.col("ratio") + F.when(exact, EXACT_BONUS).otherwise(0.0), F.lit(1.0))
    found = scored.where(F.col("ratio") > ratio).withColumn("confidence", score).where(F.col("confidence") > confidence)
    return top_per_group(found.select("quote_id", "text_id", "shared", "ratio", "confidence"), ["quote_id"], [F.desc("confidence"), F.asc("text_id")], k)


def interval_overlap(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose closed ranges overlap. Ranges are dealt to bins of ``width``; a pair is made in the bin of its later start only."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x = a.withColumn("_bin", bins(*a_range))
    y = b.withColumn("_bin", bins(*b_range))
    own = F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width) == F.col("_bin")
    return x.join(y, "_bin").where((F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(a_range[1]) >= F.col(b_range[0])) & own).drop("_bin")


def band(a: DataFrame, b: DataFrame, x: str, y: str, most: float) -> DataFrame:
    """Pairs with |x - y| <= most, by bins of that width: each row of b goes to its own and both neighbouring bins."""
    left = a.withColumn("_bin", F.floor(F.col(x) / most))
    right = b.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(y) / most) + i for i in (-1, 0, 1)])))
    return left.join(right, "_bin").where(F.abs(F.col(x) - F.col(y)) <= most).drop("_bin")


def first_mapping(rows: DataFrame, key: str, maps: list[tuple[DataFrame, str, str]], default: Column) -> DataFrame:
    """``target`` by the first map that knows ``key``, else ``default``; ``rule`` is the map's number from 1, 0 for the default."""
    out, targets = rows, []
    for i, (m, source, target) in enumerate(maps):
        out = out.join(m.select(F.col(source).alias(f"_s{i}"), F.col(target).alias(f"_t{i}")), F.col(key) == F.col(f"_s{i}"), "left")
        targets.append(f"_t{i}")
    rule = reduce(lambda acc, i: acc.when(F.col(targets[i]).isNotNull(), F.lit(i + 1)), range(len(targets)), F)
    return out.withColumn("target", F.coalesce(*targets, default)).withColumn("rule", rule.otherwise(F.lit(0))).drop(*targets, *[f"_s{i}" for i in range(len(maps))])
