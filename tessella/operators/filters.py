"""Rule filters as Columns: nine operators with defined nulls, groups, preferences, quick filters, presets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("equals", "not_equals", "contains", "not_contains", "in", "not_in", "greater_than", "less_than", "between")
#: Operators that a null field passes.
NEGATED = ("not_equals", "not_contains", "not_in")
CERTAINTY = ("speculative", "possible", "probable", "certain")


@dataclass(frozen=True)
class FilterRule:
    """One comparison. A null field passes the negated operators only; a list field means any element;
    what can't be read as a number fails numeric comparisons; a disabled rule passes all."""

    field: str
    operator: str
    value: Any = None
    enabled: bool = True
    is_list: bool = False

    def column(self) -> Column:
        if not self.enabled:
            return F.lit(True)
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        x, v = F.col(self.field), self.value
        number = x.cast("string").try_cast("double")
        if self.operator in ("greater_than", "less_than", "between"):
            if self.is_list:
                return F.lit(False)
            low, high = v if self.operator == "between" else (v, v)
            out = {"greater_than": number > float(low), "less_than": number < float(low), "between": number.between(float(low), float(high))}[self.operator]
            return F.coalesce(out, F.lit(False))
        positive = self.operator.removeprefix("not_")
        if self.is_list:
            text = x.cast("array<string>")
            out = {
                "equals": lambda: F.lit(False),
                "contains": lambda: F.exists(text, lambda e: e.contains(str(v))),
                "in": lambda: F.arrays_overlap(text, F.array(*[F.lit(str(i)) for i in v])),
            }[positive]()
        else:
            out = {
                "equals": lambda: x == F.lit(v),
                "contains": lambda: x.cast("string").contains(str(v)),
                "in": lambda: x.isin(*v) if v else F.lit(False),
            }[positive]()
        out = F.coalesce(out, F.lit(False))
        return (x.isNull() | ~out) if self.operator in NEGATED else (x.isNotNull() & out)


@dataclass
class FilterGroup:
    """Rules joined by AND or OR; only enabled ones count, and none of them passes all."""

    rules: list[FilterRule] = field(default_factory=list)
    logic: str = "AND"

    def column(self) -> Column:
        on = [r.column() for r in self.rules if r.enabled]
        if not on:
            return F.lit(True)
        return reduce((lambda a, b: a & b) if self.logic.upper() == "AND" else (lambda a, b: a | b), on)


def has_any(column: str, values) -> Column:
    """Whether a list column holds one of ``values``; null holds none."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


@dataclass
class Preferences:
    """Excluded and preferred values of list columns, a least confidence, lists that must not be empty, groups."""

    excluded: dict[str, list[str]] = field(default_factory=dict)
    preferred: dict[str, list[str]] = field(default_factory=dict)
    confidence_column: str = "confidence"
    least_confidence: float | None = None
    not_empty: list[str] = field(default_factory=list)
    groups: list[FilterGroup] = field(default_factory=list)

    def column(self) -> Column:
        parts = [~has_any(c, v) for c, v in self.excluded.items() if v]
        parts += [has_any(c, v) for c, v in self.preferred.items() if v]
        if self.least_confidence is not None:
            parts.append(F.coalesce(F.col(self.confidence_column) >= self.least_confidence, F.lit(False)))
        parts += [F.coalesce(F.size(c) > 0, F.lit(False)) for c in self.not_empty]
        parts += [g.column() for g in self.groups]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


#: Profiles by name.
PRESETS = {
    "all": Preferences(),
    "high_confidence": Preferences(least_confidence=0.8),
    "with_evidence": Preferences(not_empty=["archaeological_evidence"]),
    "scholarly": Preferences(least_confidence=0.6, not_empty=["scholars"]),
}


def date_range(column: str, low: float, high: float) -> FilterRule:
    return FilterRule(column, "between", (low, high))


def quick(text: str, lists: tuple[str, ...], texts: tuple[str, ...]) -> Column:
    """``field:value`` or ``not field:value`` (substring, any case), else a search of all given columns."""
    if not text:
        return F.lit(True)
    if ":" in text:
        name, value = (s.strip() for s in text.split(":", 1))
        exclude = name.lower().startswith("not ")
        name, value = (name[4:] if exclude else name).strip().lower(), value.lower()
        if name in lists:
            hit = F.exists(F.col(name).cast("array<string>"), lambda e: F.lower(e).contains(value))
        else:
            hit = F.lower(F.col(name).cast("string")).contains(value)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if exclude else hit
    low = text.lower()
    hits = [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in texts]
    hits += [F.coalesce(F.exists(F.col(c), lambda e: F.lower(e).contains(low)), F.lit(False)) for c in lists]
    return reduce(lambda a, b: a | b, hits)


def certainty_at_least(column: str, level: str) -> Column:
    """Ordered levels: a true minimum."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, CERTAINTY)), F.col(column)) >= CERTAINTY.index(level) + 1, F.lit(False))


def keyword_score(text: Column, query: str) -> Column:
    """How many words of the query the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in query.lower().split()], F.lit(0))


def keyword_search(df: DataFrame, text: Column, query: str, tie: str) -> DataFrame:
    """Rows that contain at least half of the query's words, best first."""
    n = len(query.split())
    return df.withColumn("score", keyword_score(text, query)).where(F.col("score") * 2 >= n).orderBy(F.desc("score"), tie)


def facet_values(df: DataFrame, scalars: list[str], lists: list[str] = ()) -> DataFrame:
    """(facet, value) pairs that occur. Each value is counted once before the union."""
    parts = [df.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).where("value IS NOT NULL").distinct() for c in scalars]
    parts += [df.select(F.lit(c).alias("facet"), F.explode(c).alias("value")).distinct() for c in lists]
    return reduce(DataFrame.unionByName, parts)


def event_filter(
    without: dict[str, list[str]] | None = None,
    any_of: dict[str, list[str]] | None = None,
    one_of: dict[str, list[str]] | None = None,
    least_confidence: float | None = None,
    not_empty: tuple[str, ...] = (),
    contains: dict[str, str] | None = None,
    any_contains: dict[str, list[str]] | None = None,
) -> Column:
    """A conjunction over event columns; what isn't given filters nothing.

    without, any_of: list columns that share no, or some, value with the given ones
    (any_of compares in any case). one_of: columns whose value is one of the given
    ones. least_confidence: of column confidence, where it is known. not_empty: list
    columns with a value. contains, any_contains: text columns that hold the given
    text, or one of the given texts, in any case.
    """
    low = lambda values: F.array(*[F.lit(v.lower()) for v in values])
    none = F.array().cast("array<string>")
    tests = [~F.arrays_overlap(F.coalesce(c, none), F.array(*map(F.lit, v))) for c, v in (without or {}).items()]
    tests += [F.arrays_overlap(F.transform(F.coalesce(c, none), F.lower), low(v)) for c, v in (any_of or {}).items()]
    tests += [F.col(c).isin(*v) for c, v in (one_of or {}).items()]
    tests += [F.col("confidence").isNull() | (F.col("confidence") >= least_confidence)] if least_confidence is not None else []
    tests += [F.size(F.coalesce(c, none)) > 0 for c in not_empty]
    tests += [F.lower(c).contains(v.lower()) for c, v in (contains or {}).items()]
    tests += [reduce(lambda x, y: x | y, [F.lower(c).contains(v.lower()) for v in vs]) for c, vs in (any_contains or {}).items()]
    return F.coalesce(reduce(lambda x, y: x & y, tests, F.lit(True)), F.lit(False))


def confident_first(df: DataFrame, score: str, least: float, k: int, tie: str) -> DataFrame:
    """The first ``k`` rows, best first, with a score of at least ``least``."""
    return df.where(F.col(score) >= least).orderBy(F.desc(score), tie).limit(k)
