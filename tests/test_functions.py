"""Scalar functions on small literal inputs."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, morphology, probability, refs, scripts, similarity, text


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in out]


def test_tokens(spark):
    t = F.col("t")
    rows = [("Čas, time's UP! a/b",), (None,)]
    assert values(spark, rows, "t string", text.words(t)) == [["čas", "time", "s", "up", "a", "b"], []]
    assert values(spark, rows, "t string", text.ascii_words(t))[0] == ["as", "time", "s", "UP", "a", "b"]
    assert values(spark, [("a, b",)], "t string", text.word_and_sign_tokens(t)) == [["a", ",", "b"]]
    assert values(spark, [(["a/b", "c", "/"],)], "t array<string>", text.compound_parts(t)) == [["a", "b", "c"]]
    assert values(spark, [(["the", "king"],)], "t array<string>", text.without_stop_words(t)) == [["king"]]


@pytest.mark.parametrize(("word", "stem"), [("walking", "walk"), ("red", "red"), ("bring", "bring"), ("string", "str"), ("tests", "test"), ("gas", "gas"), ("quickly", "quick"), ("taller", "tall"), ("bus", "bus")])
def test_simple_stem(spark, word, stem):
    assert values(spark, [(word,)], "w string", text.simple_stem(F.col("w"))) == [stem]


def test_guess_pos(spark):
    words = ["walking", "slowly", "nation", "David", "The", "the", "she", "tree"]
    assert values(spark, [(w,) for w in words], "w string", text.guess_pos(F.col("w"))) == ["verb", "adverb", "noun", "proper_noun", "determiner", "determiner", "pronoun", "other"]


def test_normal_form_and_ngrams(spark):
    assert values(spark, [("Behold, he SAITH -- yea!",)], "t string", text.normalise_for_comparison(F.col("t"))) == ["see he says yes"]
    w = F.col("w")
    rows = [(["a", "b", "c"],), (["a"],), ([],)]
    assert values(spark, rows, "w array<string>", text.ngrams(w, 2)) == [["a b", "b c"], [], []]
    assert values(spark, rows, "w array<string>", text.phrases(w, 2, 3)) == [["a b", "b c", "a b c"], [], []]
    found = values(spark, [(list("abcdefgh"),)], "w array<string>", text.context_phrases(w, 2, 3))[0]
    assert [(x["phrase"], x["left"], x["right"]) for x in found][4] == ("e f", ["b", "c", "d"], ["g", "h"])


def test_similarity(spark):
    a, b = F.col("a"), F.col("b")
    assert values(spark, [(["x", "y"], ["y", "z"]), ([], [])], "a array<string>, b array<string>", similarity.jaccard(a, b)) == [1 / 3, 0.0]
    assert values(spark, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>", similarity.cosine(a, b)) == [pytest.approx(1 / math.sqrt(2)), None]
    pairs = [("kitten", "sitting"), ("", ""), ("abc", None), ("x" * 300 + "abc", "abc" + "y" * 300)]
    got = values(spark, pairs, "a string, b string", similarity.sequence_ratio(a, b))
    assert got == [None if q is None else pytest.approx(difflib.SequenceMatcher(None, p, q).ratio()) for p, q in pairs]
    assert values(spark, [("abcbdab", "bdcaba"), ("", "")], "a string, b string", similarity.lcs_ratio(a, b)) == [pytest.approx(8 / 13), 0.0]
    assert values(spark, [("david", "davis"), ("mose", "moses"), ("cat", "dog")], "a string, b string", similarity.edit_similar(a, b)) == [True, True, False]


def test_references(spark):
    rows = [("GEN.1.1",), ("Genesis 1:1",), ("Gen. 2:3b",), ("1 John 3:16",), ("Song of Solomon 1:2",), ("PSA.151.1",), ("Foo 1:1",), ("ROM.3",), (None,)]
    r = refs.parse_verse_id(F.col("t"))
    got = values(spark, rows, "t string", refs.canonical(r), refs.is_valid(r))
    assert got == [("GEN.1.1", True), ("GEN.1.1", True), ("GEN.2.3b", True), ("1JN.3.16", True), ("SNG.1.2", True), ("PSA.151.1", False), (None, False), (None, False), (None, False)]
    df = spark.createDataFrame([("MAL.1.1",), ("GEN.2.1",), ("GEN.1.2a",), ("GEN.1.2",)], "t string").withColumn("r", r)
    assert [x["t"] for x in df.orderBy(*refs.sort_key(F.col("r"))).collect()] == ["GEN.1.2", "GEN.1.2a", "GEN.2.1", "MAL.1.1"]
    verses = spark.createDataFrame([("GEN", c, v) for c in (1, 2, 3) for v in range(1, 6)], "book string, chapter int, verse int")
    span = spark.createDataFrame([("GEN.1.4", "GEN.2.2")], "a string, b string").select(refs.parse_verse_id(F.col("a")).alias("a"), refs.parse_verse_id(F.col("b")).alias("b"))
    assert [(x["chapter"], x["verse"]) for x in refs.expand_range(span, "a", "b", verses).orderBy("chapter", "verse").collect()] == [(1, 4), (1, 5), (2, 1), (2, 2)]


def test_dates(spark):
    phrases = {"586 BCE": (-586, -586), "586-587 BCE": (-587, -586), "586? BCE": (None, None), "586 ± 5 BCE": (-591, -581), "AD 70": (70, 70), "70 CE": (70, 70), "no": (None, None)}
    r = dates.year_range(F.col("t"))
    got = values(spark, [(p,) for p in phrases], "t string", r["earliest"], r["latest"])
    assert got == list(phrases.values())
    y = F.col("y")
    assert values(spark, [(-5,), (5,)], "y int", dates.display(y), dates.bucket(y, 10)) == [("5 BCE", -10), ("5 CE", 0)]
    assert values(spark, [(-3, 5), (-715, 15), (14, 3)], "y int, n int", dates.regnal_year(y, F.col("n"))) == [2, -701, 16]


def test_distributions(spark):
    rows = [("uniform", 0.0, 12.0, 0.0, 0.0), ("normal", 5.0, 2.0, 0.0, 0.0), ("triangular", 0.0, 6.0, 3.0, 0.0), ("beta", 0.0, 1.0, 2.0, 2.0)]
    args = [F.col(c) for c in "kabcd"]
    got = values(spark, rows, "k string, a double, b double, c double, d double", probability.mean(*args), probability.std(*args), probability.interval(*args)["low"])
    assert got == [(6.0, pytest.approx(math.sqrt(12)), pytest.approx(0.3)), (5.0, 2.0, pytest.approx(1.080072)), (3.0, pytest.approx(math.sqrt(1.5)), pytest.approx(math.sqrt(0.025 * 18))), (0.5, pytest.approx(math.sqrt(0.05)), pytest.approx(0.5 - 1.959963985 * math.sqrt(0.05)))]
    c = F.col("c")
    assert values(spark, [([0.5, 0.8],), ([],)], "c array<double>", probability.path_confidence(c), probability.aggregate_confidence(c)) == [(pytest.approx(0.36), pytest.approx(0.605)), (1.0, 0.0)]


def test_scripts(spark):
    t = F.col("t")
    rows = [("בְּרֵאשִׁית",), ("ἐν ἀρχῇ",), ("in the",), ("שלום hi",), ("12",)]
    assert values(spark, rows, "t string", scripts.main_script(t)) == ["Hebrew", "Greek", "Latin", "Hebrew", None]
    assert values(spark, rows, "t string", scripts.direction(t)) == ["rtl", "ltr", "ltr", "rtl", "neutral"]
    assert values(spark, rows, "t string", scripts.is_mixed(t)) == [False, False, False, True, False]
    assert values(spark, rows[:1], "t string", scripts.without_points(t), scripts.transliterate_hebrew(t)) == [("בראשית", "brʾšyt")]
    assert values(spark, rows[1:2], "t string", scripts.without_marks(t), scripts.transliterate_greek(t)) == [("εν αρχη", "en archē")]
    assert values(spark, [("λογοσ",)], "t string", scripts.final_sigma(t)) == ["λογος"]
    assert values(spark, [("é",), ("é",)], "t string", scripts.nfc(t)) == ["é", "é"]
    assert values(spark, rows[3:4], "t string", scripts.runs(t)) == [["שלום", " ", "hi"]]
    assert values(spark, [("é",)], "t string", scripts.count_marks(t)) == [1]


def test_morphology(spark):
    g = morphology.greek(F.col("c"))
    got = values(spark, [("V-AAI-3S",), ("N-NSM",), ("V-PAP-NSM",), ("X",)], "c string", g["pos"], g["tense"], g["mood"], g["person"], g["case"], g["number"], g["gender"])
    assert got == [
        ("verb", "aorist", "indicative", "3", None, "singular", None),
        ("noun", None, None, None, "nominative", "singular", "masculine"),
        ("verb", "present", "participle", None, "nominative", "singular", "masculine"),
        ("particle", None, None, None, None, None, None),
    ]
    assert values(spark, [("b/7225",), ("1254 a",), ("x",)], "c string", morphology.strong_number(F.col("c"), "H")) == ["H7225", "H1254", None]


def test_reference_ranges_and_lists(spark):
    from tessella.functions import refs

    df = spark.createDataFrame([("GEN.1.1a", "GEN.1.1"), ("EXO.1.1", "GEN.50.26"), ("GEN.1.1", "GEN.1.1"), ("x", "GEN.1.1")], "a string, b string")
    got = [r[0] for r in df.select(refs.compare(refs.parse_verse_id(F.col("a")), refs.parse_verse_id(F.col("b")))).collect()]
    assert got == [1, 1, 0, None]
    empty = spark.createDataFrame([(None,)], "t string")
    assert empty.select(refs.verse_range(F.col("t"))).first()[0] is None
    assert empty.select(refs.reference_list(F.col("t"))).first()[0] is None


def test_modern_spelling_and_order(spark):
    from tessella.functions import text

    df = spark.createDataFrame([("Thou shalt 3:16 see THY house, thine", ["a", "b", "c", "d"], ["d", "b", "c", "a", "x"])], "t string, a array<string>, b array<string>")
    assert tuple(df.select(text.modern_spelling(F.col("t")), text.order_changes(F.col("a"), F.col("b"))).first()) == ("you shalt  see your house, yours", 2)


def test_bound_on_matched_characters_is_never_too_low(spark):
    r = random.Random(5)
    letters = "ab cdefghij" * 3 + "xyzqw"
    pairs = []
    for n in [200, 260, 420] * 30:
        b = "".join(r.choice(letters) for _ in range(n))
        cut = r.randint(0, n)
        pairs += [(b[cut:] + b[:cut], b), (b[:cut] + "aaaa" * 9, b), ("".join(c if r.random() > 0.1 else "x" for c in b), b), ("a" * cut, b), ("", b)]
    for a, b in pairs:
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert similarity.most_matched(a, b, similarity.rare_places(b)) >= matched
    pairs += [("kurz", "kurze"), (None, "x"), ("", "")]
    got = values(spark, pairs, "a string, b string", similarity.sequence_ratio_above(F.col("a"), F.col("b"), 0.5))
    for (a, b), ratio in zip(pairs, got, strict=True):
        want = None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()
        assert ratio == want or (ratio is None and want <= 0.5)


def test_letters_bound_the_normalised_length(spark):
    rows = [("Behold, saith he: yea",), ("behold " * 50,), ("  ... ",), ("",), (None,), ("Élan 12 verily",)]
    t = F.col("t")
    for low, n in values(spark, rows, "t string", text.least_normalised(t), F.length(text.normalise_for_comparison(t))):
        assert (low is None and n is None) or low <= n
