"""Word alignment: co-occurrence (PMI), IBM model 1, decoding, assignment, ensembles, evaluation, phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .model1 import expectation_maximisation

NULL_WORD = "NULL"
# Weights and bonuses of the ensemble.
METHOD_WEIGHTS = {"statistical": 0.3, "neural": 0.25, "morphological": 0.2, "position": 0.1, "lexicon": 0.15}
AGREEMENT_BONUS = 0.15
PAIR_FACTOR = 1.1
THREE_FACTOR = 1.15
STATISTICAL_FACTOR = 1.05
LEAST_SCORE = 0.05


def cooccurrence(pairs: DataFrame, src: str, tgt: str, least: int = 1) -> DataFrame:
    """(s, t, pairs, s_rows, t_rows, n): rows of ``pairs`` in which words stand opposite each other, ``least`` rows or more.

    Words of fewer rows make no such pair, so they leave their rows before pairs are made.
    """
    base = cut(pairs.select(F.array_distinct(src).alias("a"), F.array_distinct(tgt).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0)).withColumn("_id", F.monotonically_increasing_id()))
    n = base.agg(F.count("*").alias("n"))

    def side(words: str, word: str) -> tuple[DataFrame, DataFrame]:
        one = base.select("_id", F.explode(words).alias(word))
        rows = one.groupBy(word).agg(F.count("*").alias(f"{word}_rows")).where(F.col(f"{word}_rows") >= least)
        kept = base.select("_id", F.col(words).alias("w")) if least <= 1 else one.join(rows, word, "left_semi").groupBy("_id").agg(F.collect_list(word).alias("w"))
        return rows, kept

    (s, a), (t, b) = side("a", "s"), side("b", "t")
    both = a.withColumnRenamed("w", "a").join(b.withColumnRenamed("w", "b"), "_id") if least > 1 else base
    both = both.select(F.explode("a").alias("s"), "b").select("s", F.explode("b").alias("t")).groupBy("s", "t").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least)
    return both.join(s, "s").join(t, "t").crossJoin(F.broadcast(n))


def pmi(counts: DataFrame) -> DataFrame:
    """Pointwise mutual information in nats, and its logistic value as a score."""
    value = F.log(F.col("pairs") * F.col("n") / (F.col("s_rows") * F.col("t_rows")))
    return counts.withColumn("pmi", value).withColumn("score", 1 / (1 + F.exp(-F.col("pmi"))))


def ibm1(pairs: DataFrame, src: str, tgt: str, rounds: int = 10, tolerance: float = 1e-3, with_null: bool = True) -> DataFrame:
    """Translation table (s, t, prob) by expectation maximisation, from a uniform start; null words take no part.

    Equal words of a sentence are merged with their counts, which keeps the sums; see ``model1`` for how pairs are counted.
    """
    source = F.concat(F.array(F.lit(NULL_WORD)), F.col(src)) if with_null else F.col(src)
    rows = pairs.select(source.alias("a"), F.col(tgt).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    return expectation_maximisation(rows, rounds, tolerance)


def decode(pairs: DataFrame, key: str, src: str, tgt: str, table: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(key, s_idx, t_idx, prob): the best source of each target position; the first of equals; NULL takes none.

    Each row of ``pairs`` is a sentence pair of its own, also where keys are equal. Probabilities, sums in no fixed order, are compared to 12 digits,
    with ``threshold`` too. No other pair of the table than those above ``threshold`` can be a best one that counts, and a source has few of
    these, so they are gathered by source: a source word goes to its row once, with its targets.
    """
    pairs = cut(pairs.select(key, F.col(src).alias("a"), F.col(tgt).alias("b")).withColumn("_id", F.monotonically_increasing_id()))
    near = table.select("s", "t", F.round("prob", 12).alias("prob")).where(F.col("prob") > threshold)
    near = near.groupBy("s").agg(F.collect_list(F.struct("t", "prob")).alias("near"))
    a = pairs.select("_id", F.posexplode(F.concat(F.array(F.lit(NULL_WORD)), F.col("a"))).alias("s_idx", "s"))
    known = a.join(near, "s").select("_id", "s_idx", F.explode("near").alias("x")).select("_id", "s_idx", "x.t", "x.prob")
    best = known.groupBy("_id", "t").agg(F.max(F.struct("prob", (-F.col("s_idx")).alias("s_idx"))).alias("m")).where("m.s_idx < 0")
    b = pairs.select("_id", key, F.posexplode("b").alias("t_idx", "t"))
    return b.join(best, ["_id", "t"]).select(key, (-F.col("m.s_idx") - 1).alias("s_idx"), "t_idx", F.col("m.prob").alias("prob"))


def position_scores(pairs: DataFrame, key: str, src: str, tgt: str) -> DataFrame:
    """Score by relative position; 1.2 times at both ends, at most 0.5."""
    rel = lambda i, n: i / F.greatest(n - 1, F.lit(1))
    a = pairs.select(key, F.size(src).alias("n"), F.posexplode(src).alias("s_idx", "s"))
    b = pairs.select(key, F.size(tgt).alias("m"), F.posexplode(tgt).alias("t_idx", "t"))
    near = 1 - F.abs(rel(F.col("s_idx"), F.col("n")) - rel(F.col("t_idx"), F.col("m")))
    edge = ((F.col("s_idx") == 0) & (F.col("t_idx") == 0)) | ((F.col("s_idx") == F.col("n") - 1) & (F.col("t_idx") == F.col("m") - 1))
    return a.join(b, key).withColumn("score", F.least(near * 0.5 * F.when(edge, 1.2).otherwise(1.0), F.lit(0.5))).select(key, "s_idx", "t_idx", "score")


def _assigned(scores: DataFrame, key: str, score: str, choose, digits: int | None = None) -> DataFrame:
    """The rows of each key that ``choose`` picks from its (source, target, score) lists. Keys come sorted through Arrow
    batches, and one key's candidates are held at a time: a sentence's, never a corpus's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = int((pdf["_group"] != pdf["_group"].iloc[-1]).sum())
            held = pdf.iloc[cut:]
            if cut:
                yield pick(pdf.iloc[:cut])
        if held is not None and len(held):
            yield pick(held)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["_score"] if digits is None else pdf["_score"].round(digits)
        sources, targets, values, group = pdf["s_idx"].tolist(), pdf["t_idx"].tolist(), values.tolist(), pdf["_group"].tolist()
        keep, at = [], 0
        for end in range(1, len(group) + 1):
            if end == len(group) or group[end] != group[at]:
                keep += [at + i for i in choose(sources[at:end], targets[at:end], values[at:end])]
                at = end
        return pdf.iloc[keep][[key, "s_idx", "t_idx", "_score"]]

    text = F.to_json(F.struct(key)).alias("_group")
    cols = scores.select(key, F.col("s_idx").cast("long"), F.col("t_idx").cast("long"), F.col(score).cast("double").alias("_score"), text)
    kind = cols.schema[key].dataType.simpleString()
    dealt = cols.repartition("_group").sortWithinPartitions("_group")
    return dealt.mapInPandas(run, f"{key} {kind}, s_idx long, t_idx long, _score double").withColumnRenamed("_score", score)


def greedy(scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    """One-to-one pairs of each key, best score first (then smaller source, then smaller target)."""

    def best_first(sources: list, targets: list, values: list) -> list[int]:
        used_s, used_t, keep = set(), set(), []
        most = min(len(set(sources)), len(set(targets)))
        for i in np.lexsort((targets, sources, -np.array(values))).tolist():
            if len(keep) == most:
                break
            if sources[i] not in used_s and targets[i] not in used_t:
                used_s.add(sources[i])
                used_t.add(targets[i])
                keep.append(i)
        return keep

    return _assigned(scores, key, score, best_first)


def by_source(scores: DataFrame, key: str, score: str = "score", least: float = LEAST_SCORE) -> DataFrame:
    """One-to-one pairs of each key, source by source: the source with the best score chooses first (then the larger one),
    and takes its best target that is left (then the smaller one) if that scores more than ``least``. Scores that are
    sums in no fixed order are compared to 12 digits."""

    def in_turn(sources: list, targets: list, values: list) -> list[int]:
        own: dict = {}
        for i, s in enumerate(sources):
            own.setdefault(s, []).append(i)
        used, keep = set(), []
        for s in sorted(own, key=lambda s: (max(values[i] for i in own[s]), s), reverse=True):
            left = [i for i in own[s] if targets[i] not in used]
            best = min(left, key=lambda i: (-values[i], targets[i]), default=None)
            if best is not None and values[best] > least:
                used.add(targets[best])
                keep.append(best)
        return keep

    return _assigned(scores, key, score, in_turn, 12)


def ensemble(scores: DataFrame, key: str, weights: dict[str, float] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """(key, s_idx, t_idx, base, methods, agreement, confidence) from rows (key, s_idx, t_idx, method, score).

    Weighted scores are summed by pair and pairs assigned source by source. The
    base then grows with the number of methods that agree and with how close their
    scores are, and by factors for what agrees; 1 at most.
    """
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in (weights or METHOD_WEIGHTS).items() for x in p]), F.col("method")), F.lit(0.1))
    votes = F.sort_array(F.collect_list(F.struct("method", (w * F.col("score")).alias("part"))))
    # Summed by method, then by value: sums of doubles must not depend on which row comes first.
    base = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x["part"])
    g = scores.groupBy(key, "s_idx", "t_idx").agg(base.alias("base"), F.collect_set("method").alias("names"), (F.max("score") - F.min("score")).alias("spread"))
    chosen = by_source(g, key, "base", least).drop("base")
    n = F.size("names")
    has = lambda m: F.array_contains("names", m)
    several = (1 + AGREEMENT_BONUS * (n - 1) * (1 - F.col("spread"))) * F.when(has("statistical") & has("morphological"), PAIR_FACTOR).otherwise(1.0) * F.when(n >= 3, THREE_FACTOR).otherwise(1.0)
    value = F.col("base") * F.when(n > 1, several).otherwise(1.0) * F.when(has("statistical"), STATISTICAL_FACTOR).otherwise(1.0)
    out = g.join(chosen, [key, "s_idx", "t_idx"]).withColumn("methods", n.cast("long")).withColumn("agreement", F.when(n > 1, 1 - F.col("spread")).otherwise(1.0))
    return out.withColumn("confidence", F.least(value, F.lit(1.0))).select(key, "s_idx", "t_idx", "base", "methods", "agreement", "confidence")


def calibrated(scores: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """The best weighted score, plus agreement, lexicon (or semantic) and morphology bonuses; filtered before it is clamped to 0.98.

    Two methods already earn the whole agreement bonus (2 / 5 is over its limit), so methods aren't counted: whether there are two shows in the least
    and largest of their 64-bit hashes, and a group holds four numbers.
    """
    method = F.col("method")
    number = F.when(method.isNotNull(), F.xxhash64(method))
    kinds = F.bit_or(F.when(method == "lexicon", 1).when(method == "semantic", 2).when(method == "morphological", 4).otherwise(0))
    groups = scores.groupBy(*keys).agg(F.max("score").alias("_best"), F.min(number).alias("_low"), F.max(number).alias("_high"), kinds.alias("_kinds"))
    has = lambda bit: F.col("_kinds").bitwiseAND(bit) > 0
    value = F.col("_best") + F.when(F.col("_low") < F.col("_high"), 0.3).otherwise(0.0) + F.when(has(1), 0.3).when(has(2), 0.15).otherwise(0.0) + F.when(has(4), 0.1).otherwise(0.0)
    return groups.select(*keys, value.alias("raw")).where(F.col("raw") >= least).withColumn("score", F.least("raw", F.lit(0.98)))


def threshold_combine(scores: DataFrame, source: list[str], target: str, weights: dict[str, float], least: float = 0.7) -> DataFrame:
    """Weighted sum by pair, then the best target of each source above ``least``."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("method")), F.lit(0.0))
    summed = scores.groupBy(*source, target).agg(F.sum(w * F.col("score")).alias("score"))
    best = summed.groupBy(*source).agg(F.max_by(F.struct(target, "score"), F.struct("score", -F.col(target))).alias("m"))
    return best.where(F.col("m.score") > least).select(*source, "m.*")


def evaluate(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall, F1, and error rate as 1 - F1. One row; shared pairs come from one join."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full")
    c = both.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("found"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("hits"))
    p = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)
    c = c.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.withColumn("f1", f1).withColumn("error_rate", 1 - F.col("f1"))


def runs(df: DataFrame, key: list[str], index: str, longest: int = 4) -> DataFrame:
    """(key, start, length): stretches of following indices, cut after ``longest``."""
    w = Window.partitionBy(*key).orderBy(index)
    island = F.col(index) - F.row_number().over(w)
    numbered = df.select(*key, index).distinct().withColumn("_island", island)
    place = F.row_number().over(Window.partitionBy(*key, "_island").orderBy(index)) - 1
    return numbered.withColumn("_part", F.floor(place / longest)).groupBy(*key, "_island", "_part").agg(F.min(index).alias("start"), F.count("*").alias("length")).drop("_island", "_part")


def token_passes(pairs: DataFrame, key: str) -> DataFrame:
    """Three passes over each key's tokens: equal numbers 0.9, similar transliterations 0.7, places 0.5 or 0.4.

    Each pass works on what earlier ones left, so a key is one Arrow group. Columns:
    key, src array<struct<strong,translit>>, tgt array<struct<strong,text>>.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, src, tgt in zip(pdf[key], pdf.src, pdf.tgt, strict=True):
                free_s, free_t = dict(enumerate(src)), dict(enumerate(tgt))

                def take(s, t, method, score, k=k, free_s=free_s, free_t=free_t):
                    out.append((k, s, t, method, score))
                    del free_s[s], free_t[t]

                for s in list(free_s):
                    hit = next((t for t in free_t if src[s]["strong"] and tgt[t]["strong"] == src[s]["strong"]), None)
                    if hit is not None:
                        take(s, hit, "number", 0.9)
                for s in list(free_s):
                    hit = next((t for t in free_t if _alike(src[s]["translit"], tgt[t]["text"])), None)
                    if hit is not None:
                        take(s, hit, "transliteration", 0.7)
                if len(free_s) <= len(free_t):
                    even = len(free_s) == len(free_t)
                    for s, t in zip(list(free_s), list(free_t), strict=False):
                        take(s, t, "position", 0.5 if even else 0.4)
            yield pd.DataFrame(out, columns=[key, "s_idx", "t_idx", "method", "score"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "src", "tgt").mapInPandas(run, f"{key} {kind}, s_idx int, t_idx int, method string, score double")


def _alike(a: str | None, b: str | None) -> bool:
    a, b = (a or "").lower(), (b or "").lower()
    if not a or not b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 0.3 * max(len(a), len(b)) or a.startswith(b) or b.startswith(a)


def window_ppmi(docs: DataFrame, doc_id: str, tokens: str, reach: int = 5) -> DataFrame:
    """(word, context, n, ppmi) of words within ``reach`` places; pairs are made inside each document's row."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1)
    around = lambda i: F.concat(F.slice(tokens, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), F.slice(tokens, i + 2, reach))
    rows = docs.where(F.size(tokens) > 1).select(F.explode(F.transform(at, lambda i: F.struct(F.get(tokens, i).alias("word"), around(i).alias("c")))).alias("x"))
    n = rows.select("x.word", F.explode("x.c").alias("context")).groupBy("word", "context").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    w = n.groupBy("word").agg(F.sum("n").alias("nw"))
    c = n.groupBy("context").agg(F.sum("n").alias("nc"))
    return n.join(w, "word").join(c, "context").crossJoin(F.broadcast(whole)).select("word", "context", "n", F.greatest(F.log(F.col("n") * F.col("all") / (F.col("nw") * F.col("nc"))), F.lit(0.0)).alias("ppmi"))


def share(df: DataFrame, group: list[str], value: str, n: str = "n") -> DataFrame:
    """Counts of values and their share of the group's total."""
    return df.groupBy(*group, value).agg(F.count("*").alias(n)).withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*group)))


def mode_share(df: DataFrame, unit: list[str], by: str, value: str) -> DataFrame:
    """Mean share of the commonest value within each unit, by ``by``, with the number of rows."""
    n = df.groupBy(*unit, by, value).agg(F.count("*").alias("n"))
    unit_score = n.groupBy(*unit, by).agg((F.max("n") / F.sum("n")).alias("s"), F.sum("n").alias("rows"))
    return unit_score.groupBy(by).agg(F.avg("s").alias("consistency"), F.sum("rows").alias("rows"))


def as_bands(value: Column, high: float, low: float) -> Column:
    return F.when(value > high, "high").when(value >= low, "medium").otherwise("low")
