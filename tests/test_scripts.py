"""Both writing directions and transliteration: cases by hand, and an independent walk over random texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import bidi
from tessella.functions import transliteration as tl


@pytest.fixture()
def T(spark):  # noqa: N802
    return F.col("t")


def ask(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.i)]


def walked(text):
    """Runs by a walk over characters: (direction or none for leading neutrals, text)."""
    runs = []
    for c in text:
        d = "rtl" if "֐" <= c <= "ۿ" else "ltr" if c.isalpha() else None
        if runs and (d is None or d == runs[-1][0]):
            runs[-1][1] += c
        else:
            runs.append([d, c])
    return runs


def test_runs_by_a_walk(spark, T):
    rng = random.Random(3)
    texts = ["".join(rng.choice("אבגשׁابab éZ1.( )[]\n") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    got = ask(spark, texts, bidi.segments(T), bidi.base_direction(T), bidi.display(T), bidi.mirrored(T))
    for t, (found, base, shown, turned) in zip(texts, got, strict=True):
        runs = walked(t)
        strong = [d for c in t for d, _ in walked(c)]
        right, left = strong.count("rtl"), strong.count("ltr")
        assert base == ("rtl" if right > left else "ltr" if left else "auto")
        assert [(s.run, s.direction) for s in found] == [(r, d or ("rtl" if base == "rtl" else "ltr")) for d, r in runs]
        assert [s.start for s in found] == [sum(len(r) for _, r in runs[:k]) for k in range(len(runs))]
        assert all(s.level % 2 == (s.direction == "rtl") for s in found)
        lines = []
        for line in t.split("\n"):
            kinds = [d for c in line for d, _ in walked(c)]
            keep = kinds.count("ltr") >= max(kinds.count("rtl"), 1)
            lines.append(line if keep else "".join(r for _, r in reversed(walked(line))))
        assert shown == "\n".join(lines)
        assert turned == "".join(r.translate(str.maketrans(*bidi.BRACKETS)) if d == "rtl" else r for d, r in runs)


def test_bidi_by_hand(spark, T):
    texts = [None, "", "12 .", "שלום (a) עולם", "hi שלום", "long " * 20000]
    got = ask(spark, texts, bidi.base_direction(T), F.size(bidi.segments(T)), bidi.display(T), bidi.embedded(T))
    assert got[0][0] is None and got[0][2:] == (None, None)
    assert got[1] == ("auto", 0, "", "")
    assert got[2] == ("auto", 1, "12 .", "12 .")
    assert got[3] == ("rtl", 3, "עולםa) שלום (", "שלום (‪a‬) עולם")
    assert got[4][0] == "rtl" and got[4][3] == "‪h‬‪i‬ שלום"
    assert got[5][1] == 1 and got[5][2] == texts[5]
    assert ask(spark, ["hi שלום"], bidi.display(T, F.lit("ltr")))[0] == ("hi שלום",)


def test_strong_characters_and_number_of_runs(spark, T):
    rng = random.Random(5)
    texts = ["".join(rng.choice("אׁabZé漢1.( )[]\n\0ﭏ٣") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    got = ask(spark, [None, "", " ", "1\n.", "RL", *texts], bidi.strong(T), bidi.n_runs(T), F.size(bidi.runs(T)), bidi.base_direction(T), bidi.direction_of(bidi.strong(T)))
    assert [g[:2] for g in got[:5]] == [(None, None), ("", 0), ("", 1), ("\n", 1), ("LL", 1)]
    for t, (strong, n, size, base, other) in zip(texts, got[5:], strict=True):
        assert strong == "".join("R" if c in "אׁﭏ٣" else "L" if c in "abZé漢" else c if c == "\n" else "" for c in t)
        assert n == size and base == other


def test_interlinear(spark, T):
    pairs = F.expr("array(named_struct('source', 0, 'target', 1), named_struct('source', 1, 'target', 0))")
    got = ask(spark, ["אב גדה ו", "ab c", ""], bidi.interlinear(T, F.lit("x yyyy"), pairs))
    assert tuple(got[0][0]) == (f"{'ו':>3} {'גדה':>5} {'אב':>6}", f"{'—'.center(3)} {'x'.center(5)} {'yyyy'.center(6)}")
    assert tuple(got[1][0]) == (f"{'ab':<6} {'c':<3}", f"{'yyyy'.center(6)} {'x'.center(3)}")
    assert tuple(got[2][0]) == ("", "")


def test_rule_by_rule(spark, T):
    """All schemes on random texts of their own sources, against replacing rule after rule."""
    rng = random.Random(5)
    for name, rules in tl.SCHEMES.items():
        sources = [r.source for r in rules] + [" ", "7"]
        texts = ["".join(rng.choice(sources) for _ in range(30)) for _ in range(40)]
        back = ["".join(rng.choice([r.target for r in rules] + [" "]) for _ in range(30)) for _ in range(40)]
        for given, table, column in ((texts, rules, tl.transliterate(T, name)), (back, tl.reversed_rules(rules), tl.reverse_transliterate(T, name))):
            want = []
            for t in given:
                for r in sorted(table, key=lambda r: (-r.priority, -len(r.source))):
                    t = t.replace(r.source, r.target)
                want.append(t)
            assert [g[0] for g in ask(spark, given, column)] == want, name


def test_round_trips(spark, T):
    """A scheme gives a text back if each of its rules is the one its target is read as, and no two targets run together."""
    words = {"beta_code": "λογοσ θεοσ Αβ", "simple_greek": "λογοσ", "arabic_din": "كتب قلم", "syriac_academic": "ܡܠܟܐ", "sbl_hebrew": "קדם דבר", "sbl_greek": "λογοσ"}
    for name, text in words.items():
        result = tl.transliterate(T, name)
        back = tl.reverse_transliterate(result, name)
        assert tl.in_order(tl.reversed_rules(tl.SCHEMES[name]))
        if name == "sbl_hebrew":  # letters that may carry a point come back with it
            assert ask(spark, [text], result, back)[0] == ("qdm dbr", "קדּמ דּבּר")
        else:
            assert ask(spark, [text], back, tl.is_reversible(T, result, name))[0] == (text, True), name
    assert ask(spark, ["λόγος", None], tl.transliterate(T, "greek"))[1] == (None,)


def test_contexts_and_faults(spark, T):
    rules = [tl.Rule("б", "v", 12, before=r"[а-я]"), tl.Rule("б", "b"), tl.Rule("а", "a"), tl.Rule("ж", "$1")]
    assert ask(spark, ["бабж"], tl.transliterate(T, rules)) == [("bav$1",)]
    with pytest.raises(ValueError):
        tl.in_order([tl.Rule("a", "b"), tl.Rule("b", "c")])
    assert ask(spark, ["אb", ""], tl.problems(T, T, "hebrew"), tl.problems(F.lit("x"), T, "hebrew")) == [(["unconverted"], ["unconverted"]), ([], ["empty"])]
