"""Fixed hand cases of references, ranges, lists, dates, codes, mappings and count checks."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, morphology, refs
from tessella.operators import quality, versification
from tessella.plans import registry

MAPS = [
    ("a", "b", "MAL.3.19", ["MAL.4.1"], 1.0), ("a", "b", "MAL.3.20", ["MAL.4.2"], 0.9), ("a", "b", "PSA.9.0", ["PSA.10.0"], 0.8),
    ("b", "a", "JOL.2.28", ["JOL.3.1"], 1.0), ("a", "b", "ACT.19.40", ["ACT.19.40", "ACT.19.41"], 0.7), ("b", "a", "MAL.4.1", ["MAL.3.19"], 1.0), ("b", "a", "MAL.4.2", ["MAL.3.21"], 0.5), ("a", "b", "XXX.1.1", [], 0.0),
]
PARSED = [("GEN.1.1", "GEN.1.1", True), ("Rom.3.23A", "ROM.3.23a", True), ("Genesis 1:1", "GEN.1.1", True), ("1 John 3:16", "1JN.3.16", True), ("Gene 2:3b", "GEN.2.3b", True), ("GEN.51.1", "GEN.51.1", False), ("nothing 1:1", None, False), ("", None, False), ("Rev 22:21", "REV.22.21", True), ("JUD.2.1", "JUD.2.1", False)]
CODES = [("HVqp3ms", "verb", "qal", "perfect", "3", "masculine", "singular"), ("HNcfpa", "noun", None, None, None, "feminine", "plural"), ("HC/Vqw3fs", "verb", "qal", "sequential imperfect", "3", "feminine", "singular"), ("HVhrmsa", "verb", "hiphil", "active participle", None, "masculine", "singular")]
RANGES = [
    ("GEN.1.1-GEN.1.5", "GEN.1.1", "GEN.1.5"), ("Genesis 1:1-5", "GEN.1.1", "GEN.1.5"), ("gen.1.30-gen.2.3", "GEN.1.30", "GEN.2.3"), ("Genesis 1:5-1", None, None),
    ("1 John 3:16-18", "1JN.3.16", "1JN.3.18"), ("Genesis 50:1 - Exodus 1:2", "GEN.50.1", "EXO.1.2"), ("GEN.1.1", None, None), ("Genesis 99:1-2", None, None), ("", None, None),
]
LISTS = [
    ("John 3:16; Matt 5:17-19", "JHN.3.16 MAT.5.17", "JHN.3.16 MAT.5.17 MAT.5.18 MAT.5.19"), ("Gen 1.1, Exodus 2 3", "GEN.1.1 EXO.2.3", "GEN.1.1 EXO.2.3"), ("ROM.3.23a", "ROM.3.23a", "ROM.3.23a"),
    ("PRO 1:12-1; Proverbs 2:1, Genesis 3:2 ;", "PRO.2.1 GEN.3.2", "PRO.2.1 GEN.3.2"), ("nothing; ,", "", ""), ("1 John 4:8-9", "1JN.4.8", "1JN.4.8 1JN.4.9"),
]
DATES = [
    ("586 BCE", "year", -586, -586, 0.9), ("70 CE", "year", 70, 70, 0.9), ("586-538 BCE", "range", -586, -538, 0.8), ("between 600 and 500 BC", "range", -600, -500, 0.8), ("c. 1000 BCE", "circa", -1025, -975, 0.7),
    ("around 700 BCE", "circa", -725, -675, 0.7), ("15th year of Hezekiah", "regnal", -701, -701, 0.85), ("year 90 of Nero", "regnal", None, None, 0.2), ("3rd year of Nobody", "regnal", None, None, 0.3),
    ("during the reign of Josiah", "reign", -640, -609, 0.8), ("10 years before the exile", "relative", None, None, 0.7), ("second temple period", "period", -516, 70, 0.9), ("14th day of first month", "undated", None, None, 0.5),
    ("late bronze age", "undated", None, None, 0.5), ("no date", None, None, None, None),
]
YEARS = [("586 BCE", -586, -586), ("586-538 BCE", -586, -538), ("AD 70", 70, 70), ("70 AD", 70, 70), ("c. 1000 BC", -1000, -1000), ("586 ± 5 BCE", -591, -581), ("586/587 BCE", -587, -586), ("30-33 CE", 30, 33), ("no date", None, None)]

def read(spark, cases, *columns):
    """The columns over the first fields of the cases, in their order."""
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_parsed_references(spark):
    r = refs.parse_verse_id(F.col("t"))
    assert read(spark, PARSED, refs.canonical(r), refs.is_valid(r)) == [c[1:] for c in PARSED]


def test_ranges(spark):
    r = refs.verse_range(F.col("t"))
    assert read(spark, RANGES, refs.canonical(r["start"]), refs.canonical(r["end"])) == [c[1:] for c in RANGES]


def test_lists(spark):
    say = lambda expand: F.array_join(F.transform(refs.reference_list(F.col("t"), expand), refs.canonical), " ")
    assert read(spark, LISTS, say(False), say(True)) == [c[1:] for c in LISTS]


def test_odd_lists(spark):
    """Numbers beyond an int, names of several words, parts, separators of our own; the list is split once for both answers."""
    cases = [
        ("Song of Solomon 2:3; 1 John 3:16a, I 3:4", "SNG.2.3 1JN.3.16", "SNG.2.3 1JN.3.16"), ("Gen 1:99999999999; Gen 1:5-99999999999, x|y|z|4", "GEN.1.5", "GEN.1.5"), ("GEN.1.2b", "GEN.1.2b", "GEN.1.2b"),
        ("Gen 1:2\n- 4 more; $1 2:3, Gen 3:4-4", "GEN.1.2 GEN.3.4", "GEN.1.2 GEN.1.3 GEN.1.4 GEN.3.4"), (None, None, None),
    ]
    spans = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", refs.reference_spans(F.col("t")).alias("s"))
    say = lambda expand: F.array_join(F.transform(refs.span_verses(F.col("s"), expand), refs.canonical), " ")
    found = spans.select("i", say(False).alias("a"), say(True).alias("b"))
    assert [(r.a, r.b) for r in found.orderBy("i").collect()] == [c[1:] for c in cases]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[;,]") == 1


@pytest.mark.parametrize("name", ["reference_lists", "range_parsing", "reference_parsing"])
def test_books_go_to_the_rows(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "hashpartitioning(ord" not in plan and plan.count("[;,]") <= 1


def test_date_phrases(spark):
    r = dates.year_range(F.col("t"))
    assert read(spark, YEARS, r["earliest"], r["latest"]) == [c[1:] for c in YEARS]


def test_date_forms(spark):
    d = dates.parse_date(F.col("t"))
    assert read(spark, DATES, *[d[c] for c in ("kind", "earliest", "latest", "confidence")]) == [c[1:] for c in DATES]


def test_codes(spark):
    m = morphology.hebrew(F.col("t"))
    assert read(spark, CODES, *[m[f] for f in ("pos", "stem", "form", "person", "gender", "number")]) == [c[1:] for c in CODES]


def test_books(spark):
    got = refs.books(spark).groupBy("testament").agg(F.count("*"), F.sum("chapters")).collect()
    assert {tuple(r) for r in got} == {("old", 39, 929), ("new", 27, 260)}


@pytest.mark.parametrize(("low", "high", "ticks"), [(0, 97, list(range(0, 91, 10))), (-2000, 100, [-2000, -1500, -1000, -500, 0])])
def test_ticks(spark, low, high, ticks):
    assert spark.createDataFrame([(low, high)], "low int, high int").select(dates.axis_ticks(F.col("low"), F.col("high"))).first()[0] == ticks


def test_counts(spark):
    rows = spark.createDataFrame([(100, 100), (100, 0), (100, 97), (100, 120)], "expected int, actual int")
    assert [r.status for r in quality.check_counts(rows, "expected", "actual").collect()] == ["ok", "error", "warning", "error"]


@pytest.fixture
def maps(spark):
    return spark.createDataFrame([(a, b, s, d, "m", c) for a, b, s, d, c in MAPS], "from_sys string, to_sys string, src string, dst array<string>, kind string, confidence double")


def test_mappings(spark, maps):
    asked = {"MAL.3.19": ("MAL.4.1", "exact"), "JOL.3.1": ("JOL.2.28", "reverse"), "PSA.9.5": ("PSA.10.5", "chapter"), "GEN.1.1": ("GEN.1.1", "same"), "ACT.19.40": ("ACT.19.40,ACT.19.41", "exact")}
    r = spark.createDataFrame([(x, "a", "b") for x in asked], "ref string, from_sys string, to_sys string")
    assert {x.ref: (",".join(x.targets), x.rule) for x in versification.resolve(r, maps).collect()} == asked
    assert {(x.from_sys, x.src, x.holds) for x in versification.round_trips(maps).collect()} == {("a", "MAL.3.19", True), ("b", "MAL.4.1", True), ("a", "MAL.3.20", False)}
    got = {(x.from_sys, x.entries, x.exact, x.missing, x.complex, round(x.confidence, 6)) for x in versification.statistics(maps).collect()}
    assert got == {("a", 5, 3, 1, 1, 0.68), ("b", 3, 3, 0, 0, 0.833333)}
