"""Both dialects of the apparatus: lines by hand, lines written from a grammar, damaged lines."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import apparatus


def sigla(reading):
    return [w["siglum"] for w in reading["witnesses"]]


def test_verse_dialect():
    e = apparatus.parse("3-4 ¦ txt א A* 33 : τον θεον Bc2 (D) itmg pc : om 𝔓46 Or", "verse")
    assert (e["first"], e["last"], e["symbols"]) == (3, 4, ["pc"])
    base, second, third = e["readings"]
    assert (base["text"], base["is_base"], base["confidence"], sigla(base)) == ("", True, 0.9, ["א", "A", "33"])
    assert [(w["number"], w["kind"], w["corrector"]) for w in base["witnesses"]] == [("01", "uncial", None), ("02", "uncial", 1), ("33", "minuscule", None)]
    assert second["text"] == "τον θεον" and second["confidence"] is None
    assert [(w["siglum"], w["corrector"], w["partial"], w["margin"]) for w in second["witnesses"]] == [("B", 2, False, False), ("D", None, True, False), ("it", None, False, True)]
    assert (third["text"], [w["number"] for w in third["witnesses"]], third["witnesses"][1]["kind"]) == ("om", ["P46", "Or"], "father")


def test_rated_dialect():
    e = apparatus.parse("5:2 {B} θεος κυριος μου 01 A ; om D it add syr vid", "rated")
    assert (e["chapter"], e["first"], e["rating"], e["lemma"], e["symbols"]) == (5, 2, "B", "θεος", ["vid"])
    assert [(r["text"], sigla(r)) for r in e["readings"]] == [("κυριος μου", ["01", "A"]), ("om", ["D", "it"]), ("add", ["syr"])]
    assert [r["text"] for r in apparatus.parse("1:1 {A} λογος : om D", "rated")["readings"]] == ["om"]
    assert apparatus.parse("1:1 {A} om D", "rated")["lemma"] is None


@pytest.mark.parametrize(
    ("line", "dialect", "why"),
    [("τον B", "verse", "no head"), ("4-3 ¦ om B", "verse", "range"), ("3 ¦", "verse", "empty"), ("3 ¦ om B : : x C", "verse", "empty"), ("3 ¦ om B x", "verse", "word after"), ("3 ¦ om (B", "verse", "bracket"), ("1:2 {E} om B", "rated", "no head"), ("1:99999 {A} om B", "rated", "large"), ("3 ¦ om B :", "verse", "empty")],
)
def test_damaged_lines(line, dialect, why):
    with pytest.raises(apparatus.Damaged, match=why):
        apparatus.parse(line, dialect)


def test_files_with_damaged_lines(spark, tmp_path):
    """Entries written from a grammar come back, each damaged line is reported with its text."""
    rng, lines, want = random.Random(2), [], []
    for n in range(200):
        first = rng.randrange(1, 90)
        last = first + rng.randrange(3)
        readings = [(" ".join(rng.choices(["τον", "θεον", "om", "και"], k=rng.randrange(1, 4))), rng.sample(["A", "B", "33", "it", "𝔓75", "Chr"], rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))]
        lines.append(f"{first}-{last} ¦ " + " : ".join(f"{t} {' '.join(w)}" for t, w in readings))
        want += [(v, readings) for v in range(first, last + 1)]
    damaged = ["7 ¦ om B late", "no entry at all", "9-2 ¦ om B"]
    (tmp_path / "a.txt").write_text("\n".join(lines + ["", "  "] + damaged), encoding="utf-8")
    got = apparatus.read(spark, str(tmp_path), "verse").collect()
    good = [(r.verse, [(x.text, [w.siglum for w in x.witnesses]) for x in r.readings]) for r in got if r.error is None]
    assert sorted(good) == sorted(want)
    assert sorted(r.line for r in got if r.error) == sorted(damaged)
    assert all(r.verse is None and r.readings is None and r.file.endswith("a.txt") for r in got if r.error)
    none = spark.createDataFrame([(1, None)], "id int, value string")
    assert apparatus.entries(none, "value", "rated", ["id"]).collect() == []
    with pytest.raises(ValueError):
        apparatus.entries(none, "value", "other", [])


def test_changes(spark):
    rows = [("a b", "om"), ("a b", None), ("", "a"), ("a b", "b a"), ("abcd", "abxy"), ("abcd", "xyzd"), ("a b", "c")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r.c for r in df.orderBy("i").select(apparatus.change(F.col("a"), F.col("b")).alias("c")).collect()] == ["omission", "omission", "addition", "transposition", "spelling", "substitution", "substitution"]
