"""Signed years (negative: BCE), uncertain dates, and the parsing of date phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.44


def year(text: Column) -> Column:
    """The signed year of ``586 BCE``, ``70 CE``, ``AD 70``, ``c. 1000 BC``; null if there is none."""
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*(?:BCE?|CE|AD)\b", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)\bAD\s*(\d+)", 1), F.lit(""))).try_cast("int")
    return F.when(text.rlike(r"(?i)\bBCE?\b"), -number).otherwise(number)


def year_range(text: Column) -> Column:
    """struct(earliest, latest) of ``586-538 BCE``, ``586/587 BCE``, ``586 ± 5 BCE`` or a single year."""
    pair = r"(?i)(\d+)\s*[-/–]\s*(\d+)\s*(BCE?|CE|AD)"
    around = r"(?i)(\d+)\s*(?:±|\+/-)\s*(\d+)\s*(BCE?|CE|AD)"
    sign = lambda p: F.when(F.upper(F.regexp_extract(text, p, 3)).startswith("B"), -1).otherwise(1)
    number = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    a, b = number(pair, 1) * sign(pair), number(pair, 2) * sign(pair)
    mid, off = number(around, 1) * sign(around), number(around, 2)
    one = year(text)
    low = F.when(text.rlike(around), mid - off).when(text.rlike(pair), F.least(a, b)).otherwise(one)
    high = F.when(text.rlike(around), mid + off).when(text.rlike(pair), F.greatest(a, b)).otherwise(one)
    return F.when(low.isNotNull(), F.struct(low.alias("earliest"), high.alias("latest")))


def certainty(text: Column) -> Column:
    """1 for a plain date, less for a range, a circa mark and a question mark."""
    out = F.when(text.rlike(r"\?"), 0.5).when(text.rlike(r"(?i)\bc(?:irca|a)?\b\.?|~"), 0.7).when(text.rlike("[/±–-]"), 0.8).otherwise(1.0)
    return F.when(year_range(text).isNotNull(), out)


def regnal_year(accession: Column, n: Column) -> Column:
    """The signed year of the ``n``-th year of a reign that began in ``accession`` (there is no year 0)."""
    raw = accession + n - 1
    return F.when((accession < 0) & (raw >= 0), raw + 1).otherwise(raw)


def display(year_: Column) -> Column:
    return F.when(year_ < 0, F.concat((-year_).cast("string"), F.lit(" BCE"))).otherwise(F.concat(year_.cast("string"), F.lit(" CE")))


def to_days(years: Column, months: Column, days: Column) -> Column:
    return years * DAYS_PER_YEAR + months * DAYS_PER_MONTH + days


def bucket(year_: Column, size: int) -> Column:
    return (F.floor(year_ / size) * size).cast("int")


def axis_ticks(low: Column, high: Column, most: int = 10) -> Column:
    """Round steps (1, 2 or 5 times a power of ten) between two years, at most about ``most`` of them."""
    raw = F.greatest((high - low) / most, F.lit(1.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = (F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power)).cast("int")
    first = (F.ceil(low / step) * step).cast("int")
    return F.when(first <= high, F.sequence(first, high.cast("int"), step)).otherwise(F.array().cast("array<int>"))


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (a1 >= b0)


# First and last year of reigns, negative before the era.
REIGNS = {
    "david": (-1010, -970),
    "solomon": (-970, -931),
    "rehoboam": (-931, -913),
    "asa": (-911, -870),
    "jehoshaphat": (-873, -848),
    "hezekiah": (-715, -686),
    "josiah": (-640, -609),
    "jeroboam": (-931, -910),
    "ahab": (-874, -853),
    "jehu": (-841, -814),
    "nebuchadnezzar": (-605, -562),
    "cyrus": (-559, -530),
    "darius": (-522, -486),
    "artaxerxes": (-465, -424),
    "augustus": (-27, 14),
    "tiberius": (14, 37),
    "claudius": (41, 54),
    "nero": (54, 68),
}
# Years of named periods, and how sure they are.
PERIODS = {"first": (-960, -586, 0.85), "second": (-516, 70, 0.9)}
CIRCA_YEARS = 25


def parse_date(text: Column) -> Column:
    """struct(kind, earliest, latest, confidence, relative_to, offset) of a phrase.

    Kinds: regnal, relative, reign, circa, range, year, period, and undated for
    phrases whose form is known but names no year (a day of a month, a festival,
    an age). Null if no form fits. Years of a reign count from its first one.
    """
    t = F.trim(text)
    first = F.try_element_at(F.create_map(*[F.lit(x) for k, v in REIGNS.items() for x in (k, v[0])]), F.lower(F.coalesce(*[F.nullif(F.regexp_extract(t, p, g), F.lit("")) for p, g in _RULERS])))
    last = F.try_element_at(F.create_map(*[F.lit(x) for k, v in REIGNS.items() for x in (k, v[1])]), F.lower(F.coalesce(*[F.nullif(F.regexp_extract(t, p, g), F.lit("")) for p, g in _RULERS])))
    number = lambda p, g=1: F.regexp_extract(t, p, g).try_cast("int")
    nth = F.coalesce(number(_RULERS[0][0]), number(_RULERS[1][0]))
    regnal = regnal_year(first, nth)

    def out(kind: str, low, high, sure, to=None, offset=None) -> Column:
        cells = [F.lit(kind).alias("kind"), F.lit(low).cast("int").alias("earliest"), F.lit(high).cast("int").alias("latest"), F.lit(sure).cast("double").alias("confidence")]
        return F.struct(*cells, F.lit(to).cast("string").alias("relative_to"), F.lit(offset).cast("int").alias("offset"))

    none = F.lit(None)
    circa = F.coalesce(number(_CIRCA), number(_AROUND))
    ends = [F.coalesce(number(_BETWEEN, i), number(_SPAN, i)) for i in (1, 2)]
    reached = F.when(regnal.between(first, last), out("regnal", regnal, regnal, 0.85)).when(first.isNotNull(), out("regnal", none, none, 0.2)).otherwise(out("regnal", none, none, 0.3))
    result = (
        F.when(t.rlike(_RULERS[0][0]) | t.rlike(_RULERS[1][0]), reached)
        .when(t.rlike(_RELATIVE), out("relative", none, none, 0.7, F.regexp_extract(t, _RELATIVE, 3), F.when(F.lower(F.regexp_extract(t, _RELATIVE, 2)) == "before", -number(_RELATIVE)).otherwise(number(_RELATIVE))))
        .when(t.rlike(_RULERS[2][0]), F.when(first.isNotNull(), out("reign", first, last, 0.8)).otherwise(out("reign", none, none, 0.3)))
        .when(t.rlike(_SPAN) | t.rlike(_BETWEEN), out("range", -F.greatest(*ends), -F.least(*ends), 0.8))
        .when(t.rlike(_CIRCA) | t.rlike(_AROUND), out("circa", -circa - CIRCA_YEARS, -circa + CIRCA_YEARS, 0.7))
    )
    for name, (low, high, sure) in PERIODS.items():
        result = result.when(t.rlike(rf"(?i)^{name}\s+temple\s+period"), out("period", low, high, sure))
    result = result.when(t.rlike(r"(?i)^(?:AD\s*)?\d+\s*(?:BCE?|CE|AD)?\b") & year(t).isNotNull(), out("year", year(t), year(t), 0.9))
    return result.when(t.rlike(_UNDATED), out("undated", none, none, 0.5))


_RULERS = ((r"(?i)^(\d+)(?:st|nd|rd|th)?\s+year\s+of\s+(\w+)", 2), (r"(?i)^year\s+(\d+)\s+of\s+(\w+)", 2), (r"(?i)^during\s+the\s+reign\s+of\s+(\w+)", 1))
_RELATIVE = r"(?i)^(\d+)\s+years?\s+(before|after)\s+(.+)"
_SPAN = r"(?i)^(\d+)\s*-\s*(\d+)\s*BCE?\b"
_BETWEEN = r"(?i)^between\s+(\d+)\s+and\s+(\d+)\s*BCE?\b"
_CIRCA = r"(?i)^c(?:a|irca)?\.?\s*(\d+)\s*BCE?\b"
_AROUND = r"(?i)^around\s+(\d+)\s*BCE?\b"
_UNDATED = r"(?i)^(?:\d+(?:st|nd|rd|th)?\s+day\s+of\s+\w+\s+month|passover\s+of\s+year\s+\d+|(?:early|middle|late)\s+bronze\s+age)"
