"""Quality rules: base statistics and a learned, ordered decision list, all in DataFrame functions.

The statistics of a text come from array functions inside its own row; no
exploded words, no shuffle. Repeated three-word windows are found by sorting one
number for each window (its hash above its place) and comparing neighbours; equal
numbers are confirmed on the words themselves. (Two different windows of one text
that share a hash of 50 bits or more could hide a third; the odds are under
10^-12 for a text.)

The decision list is learned by sequential covering over all labelled documents:
a rule grows by the threshold that gains most (FOIL gain) on two thirds of them,
is pruned back on the other third, and what it covers leaves the training set.
Each growing step is one small aggregation (feature, bin) -> counts; the driver
holds those counts only. The result is a CASE WHEN over the statistics. A
condition is added while its gain, in bits, is more than it takes to write it down;
rules are added until none can begin so, or one, pruned, is less than
LEAST_PRECISION precise on the pruning third. There is no other limit to either.

Defined results: null text has no words and fails the base rule; labels without
a quality or a document are skipped, several labels of a document count as the
worst; without labels nothing is learned and the base rule alone decides; ties
between thresholds go to the first feature and the lower threshold; other columns
and repeated rows pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Scratch, fresh, stored

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the learned rules, from the statistics (see _features).
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share")
BINS = 32
LEAST_PRECISION = 0.95
LEAST_COVER = 5


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column of statistics, and that column's name."""
    out, w, t, v, b, j, d = docs, *(fresh(docs, n) for n in ("w_", "t_", "v_", "b_", "j_", "d_"))
    name = fresh(docs, "stats")
    out = out.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, F.array_remove(F.split(F.col(t), SPACE, -1), ""))
    out = out.withColumn(b, F.length(F.bin(F.size(w).cast("long")))).withColumn(j, F.array_join(w, ""))
    numbered = f"transform(sequence(0, size({w}) - 3), i -> shiftleft(xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2)), {b}) | cast(i AS bigint))"
    out = out.withColumn(v, F.expr(f"IF(size({w}) >= 3, sort_array({numbered}), array())"))
    place = lambda x: f"cast({x} & (shiftleft(1L, {b}) - 1) AS int)"
    twin = lambda x, y: (
        f"(shiftrightunsigned({x}, {b}) = shiftrightunsigned({y}, {b})"
        + "".join(f" AND get({w}, {place(x)} + {k}) = get({w}, {place(y)} + {k})" for k in range(3))
        + ")"
    )
    out = out.withColumn(d, F.expr(f"sort_array(transform(filter({v}, (x, k) -> {twin('x', f'get({v}, k + 1)')} OR {twin('x', f'get({v}, k - 1)')}), x -> {place('x')}))"))
    repeat = f"aggregate(transform({d}, (p, k) -> least(3, coalesce(get({d}, k + 1) - p, 3))), 0L, (a, x) -> a + x)"
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lost = lambda pattern: (F.length(j) - F.length(F.regexp_replace(F.col(j), pattern, ""))).cast("long")
    n = F.size(w).cast("long")
    stats = F.struct(
        n.alias("n_words"),
        F.length(j).cast("long").alias("word_chars"),
        lost(r"[#*$%&|<>]+").alias("n_symbols"),
        F.expr(repeat).alias("n_repeat_words"),
        lost("[A-Z]+").alias("n_upper"),
        lost("!+").alias("n_bangs"),
        lost("[0-9]+").alias("n_digits"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("n_distinct_lines"),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out = out.select(*kept, stats.alias(name))
    return out.withColumn(name, F.col(name).withField("n_dup_lines", F.col(name)["n_lines"] - F.col(name)["n_distinct_lines"])), name


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _features(stats: str) -> dict[str, Column]:
    s = F.col(stats)
    part = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(0.0)
    return {
        "n_words": s["n_words"].cast("double"),
        "word_length": part("word_chars", "n_words"),
        "symbol_share": part("n_symbols", "word_chars"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "upper_share": part("n_upper", "word_chars"),
        "bang_share": part("n_bangs", "word_chars"),
        "digit_share": part("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        x = features[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; a document that meets all conditions of one is rejected, others are kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejected_by(self, stats: str) -> Column:
        """The first rule that fits, as text; null if none does."""
        features, out = _features(stats), F
        for rule in self.rules:
            every = F.lit(True)
            for c in rule:
                every &= c.column(features)
            out = out.when(every, F.lit(str(self._say(rule))))
        return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None).cast("string"))

    @staticmethod
    def _say(rule: tuple[Condition, ...]) -> str:
        return " AND ".join(map(str, rule))


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2))) if p else 0.0


def learn(stats: DataFrame, name: str, labels: DataFrame, doc_id: str = "doc_id", label_id: str = "doc_id", label: str = "quality") -> DecisionList:
    """Rules that reject what ``label`` = 0 marks, learned from every labelled row that passes the base rule."""
    marks = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("k_")).agg((F.min(label) == 0).cast("int").alias("bad_"))
    features = _features(name)
    flat = stats.where(~base_failed(name)).select(F.col(doc_id).alias("k_"), *[c.alias(f) for f, c in features.items()])
    scratch = Scratch(stats.sparkSession)
    rows = stored(flat.join(marks, "k_").withColumn("part_", F.pmod(F.xxhash64("k_"), F.lit(3)) == 0), "labelled", scratch)
    points = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.when(F.col("bad_") == side, F.col(f)), points, 10_000).alias(f"{f}_{side}") for f in FEATURES for side in (0, 1)], F.count("*").alias("n")).first()
    if not found["n"]:
        return DecisionList()
    cuts = {f: sorted({*(found[f"{f}_0"] or ()), *(found[f"{f}_1"] or ())}) for f in FEATURES}
    # the bin of a value is the number of cuts at or below it
    bins = {f: sum(((F.col(f) >= c).cast("int") for c in cuts[f]), F.lit(0)) for f in FEATURES}
    rows = stored(rows.select("bad_", "part_", *[b.cast("int").alias(f) for f, b in bins.items()]), "binned", scratch)

    def counts(where: Column) -> dict:
        """(feature, bin, prune part) -> (bad, good), of the rows that remain."""
        pair = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(FEATURES)]))
        got = rows.where(where).select(pair.alias("x"), "bad_", "part_").groupBy("x.f", "x.b", "part_").agg(F.sum("bad_").alias("p"), F.count("*").alias("n")).collect()
        return {(FEATURES[r["f"]], r["b"], r["part_"]): (r["p"], r["n"] - r["p"]) for r in got}

    def fits(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for f, up, k in rule:
            out &= (F.col(f) > k) if up else (F.col(f) <= k)
        return out

    #: Bits that name a feature, one of its thresholds and a side.
    worth_writing = math.log2(max(2, 2 * sum(len(c) for c in cuts.values())))
    remaining, out = F.lit(True), DecisionList()
    while True:
        rule, kept = [], []
        while True:
            table = counts(remaining & fits(rule))
            total = [sum(v[i] for (f, _, part), v in table.items() if f == FEATURES[0] and not part) for i in (0, 1)]
            if not total[0] or (rule and not total[1]):
                break
            best = None
            for f in FEATURES:
                low = {False: [0, 0], True: [0, 0]}
                whole = {part: [sum(v[i] for (g, _, q), v in table.items() if g == f and q == part) for i in (0, 1)] for part in (False, True)}
                for k in range(len(cuts[f])):
                    for part in (False, True):
                        low[part] = [a + b for a, b in zip(low[part], table.get((f, k, part), (0, 0)), strict=True)]
                    for up in (True, False):
                        side = {q: [w - a for w, a in zip(whole[q], low[q], strict=True)] if up else low[q] for q in (False, True)}
                        gain = _gain(*total, *side[False])
                        if side[False][0] >= LEAST_COVER and gain > worth_writing and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (f, up, k), [*side[True]])
            if best is None:
                break
            rule.append(best[1])
            kept.append(best[2])
        if not rule:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in kept]
        size = max(range(len(rule)), key=lambda i: (worth[i], -i)) + 1
        p, n = kept[size - 1]
        if p + n == 0 or p / (p + n) < LEAST_PRECISION:
            break
        rule = rule[:size]
        remaining &= ~fits(rule)
        out.rules.append(tuple(Condition(f, up, float(cuts[f][k])) for f, up, k in rule))
    scratch.drop()
    return out


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> tuple[DataFrame, str, DecisionList]:
    """``docs``, without the text unless asked for, and with statistics (written once to the shared folder), the column's name and the learned rules."""
    out, name = statistics(docs, text)
    out = stored(out if keep_text else out.drop(text), "statistics")
    return out, name, learn(out, name, labels, doc_id)


def kept(name: str, rules: DecisionList) -> Column:
    return ~base_failed(name) & rules.rejected_by(name).isNull()


def filtered(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that neither the base rule nor a learned rule rejects. Texts are written once beside their statistics, and not shuffled."""
    out, name, rules = judge(docs, labels, text, doc_id, keep_text=True)
    return out.where(kept(name, rules)).select(*[F.col(f"`{c}`") for c in docs.columns])
