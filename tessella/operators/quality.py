"""Checks and reports on annotated rows: rules, coverage, agreement, scores, review order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, rule, severity) for each rule (severity, condition of failure) that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, c) in rules.items()]))
    return df.select(key, F.explode(broken).alias("v")).select(key, "v.*")


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """Mean, median, population deviation and band shares of the scores within 0..1."""
    ok = df.where(F.col(score).between(0, 1))
    return ok.agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean"),
        F.median(score).alias("median"),
        F.stddev_pop(score).alias("std"),
        F.count_if(F.col(score) >= 0.7).alias("high"),
        F.count_if((F.col(score) >= 0.4) & (F.col(score) < 0.7)).alias("medium"),
        F.count_if(F.col(score) < 0.4).alias("low"),
    )


def quality_score(errors: Column, warnings: Column, infos: Column, mean: Column, agreement: Column) -> Column:
    """100 less penalties, plus (mean - 0.5) * 20 and agreement * 10, within 0..100."""
    raw = 100 - 20 * errors - 5 * warnings - infos + (mean - 0.5) * 20 + agreement * 10
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def method_agreement(df: DataFrame, unit: str, method: str, topic: str) -> DataFrame:
    """(unit, a, b, jaccard) of the topic sets that two methods give a unit."""
    sets = df.groupBy(unit, method).agg(F.collect_set(topic).alias("t"))
    x = sets.select(unit, F.col(method).alias("a"), F.col("t").alias("ta"))
    y = sets.select(unit, F.col(method).alias("b"), F.col("t").alias("tb"))
    return x.join(y, unit).where("a < b").select(unit, "a", "b", (F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("jaccard"))


def overlaps(df: DataFrame, unit: str, topic: str, score: str) -> DataFrame:
    """Units with more than three topics, and topics of a unit whose scores differ by over 0.3."""
    many = df.groupBy(unit).agg(F.count_distinct(topic).alias("n")).where("n > 3").select(unit, F.lit(None).cast("string").alias("topic"), F.lit("many_topics").alias("finding"))
    wide = df.groupBy(unit, topic).agg((F.max(score) - F.min(score)).alias("d")).where("d > 0.3").select(unit, F.col(topic).cast("string").alias("topic"), F.lit("scores_differ").alias("finding"))
    return many.unionByName(wide)


def merged(df: DataFrame, keys: list[str], method: str, score: str, weights: dict[str, float], default: float = 0.25, order: str | None = None) -> DataFrame:
    """One score for each key: the weighted mean over methods, and the method with the best one.

    With ``order``, of rows that repeat a method only the last one counts.
    """
    if order is not None:
        df = df.groupBy(*keys, method).agg(F.max_by(score, order).alias(score))
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col(method)), F.lit(default))
    return df.groupBy(*keys).agg((F.sum(w * F.col(score)) / F.sum(w)).alias("score"), F.max_by(method, F.struct(F.col(score), F.col(method))).alias("best"))


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value at place floor(share * n) of the sorted values (no interpolation), with mean and n.

    Places come from counts of equal values, so the sorted pass is over different
    values only.
    """
    n = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy(value)))
    return upto.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n") * share)).agg(F.min(value).alias("value"), F.first("mean").alias("mean"), F.first("n").alias("n"))


def check_counts(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """error where nothing came or over 5 % is missing or extra, warning where it is less, else ok."""
    off = F.abs(F.col(actual) - F.col(expected)) / F.col(expected)
    status = F.when(F.col(actual) == F.col(expected), "ok").when(F.col(actual) == 0, "error").when(F.col(expected) == 0, "error").when(off > 0.05, "error").otherwise("warning")
    return df.withColumn("status", status)


def review_priority(score: Column, verified: Column, manual: Column, controversial: Column) -> Column:
    """Higher for low or missing scores, unverified, automatic and controversial rows."""
    base = F.when(score.isNotNull(), (1 - score) * 50).otherwise(30.0)
    plus = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return base + plus(~verified, 20.0) + plus(~manual, 10.0) + plus(controversial, 15.0)


def frequency_bands(counts: DataFrame, n: str = "n") -> DataFrame:
    """Kinds and tokens in the bands from 100, 10-99, 2-9 and 1."""
    band = F.when(F.col(n) >= 100, "100+").when(F.col(n) >= 10, "10-99").when(F.col(n) >= 2, "2-9").otherwise("1")
    return counts.groupBy(band.alias("band")).agg(F.count("*").alias("kinds"), F.sum(n).alias("tokens"))


def coverage(tokens: DataFrame, word: str, known: DataFrame, known_word: str) -> DataFrame:
    """Tokens and kinds of words, and how many of them are known."""
    counts = tokens.groupBy(word).agg(F.count("*").alias("n"))
    marked = counts.join(known.select(F.col(known_word).alias("_k")).distinct(), F.col(word) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    return marked.agg(
        F.sum("n").alias("tokens"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("known_tokens"),
        F.count("*").alias("kinds"),
        F.count_if(hit).alias("known_kinds"),
    )


def uncertain_first(df: DataFrame, score: str, method_scores: str, factors: str, weight: str, tie: str, k: int = 100) -> DataFrame:
    """The ``k`` rows that a review would gain most from (impact to nine digits): a low score, methods that disagree, or many doubts.

    ``method_scores`` and ``factors`` are lists; ``weight`` is the number of entries a row stands for.
    """
    n = F.size(method_scores)
    mean = F.aggregate(method_scores, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(method_scores, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    doubt = (F.col(score) < 0.6) | ((n > 1) & (variance > 0.15)) | (F.size(factors) > 2)
    return df.where(doubt).withColumn("impact", F.round((1 - F.col(score)) * 10 * F.col(weight), 9)).orderBy(F.desc("impact"), tie).limit(k)
