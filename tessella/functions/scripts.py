"""Scripts, marks, direction, Unicode forms and transliteration."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCRIPTS = ("Latin", "Hebrew", "Greek", "Arabic", "Syriac", "Coptic", "Ethiopic", "Cyrillic")
RIGHT_TO_LEFT = ("Hebrew", "Arabic", "Syriac")
# Consonants of two one-letter schemes.
HEBREW_ACADEMIC = ("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "ʾbgdhwzḥṭykklmmnnsʿppṣṣqršt")
GREEK_ACADEMIC = ("αβγδεζηικλμνξοπρσςτυω", "abgdezēiklmnxoprsstyō")
GREEK_PAIRS = (("θ", "th"), ("φ", "ph"), ("χ", "ch"), ("ψ", "ps"))


def count_of(text: Column, script: str) -> Column:
    """Characters of a script, without combining marks."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{Is{script}}}]|\p{{M}}", ""))


def main_script(text: Column) -> Column:
    """The script with most characters, the first listed one of equals; null if there is none."""
    counts = [F.struct(count_of(text, s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SCRIPTS)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["s"])


def is_mixed(text: Column) -> Column:
    return sum((count_of(text, s) > 0).cast("int") for s in SCRIPTS) > 1


def direction(text: Column) -> Column:
    """rtl if right-to-left letters are more than others, ltr if fewer, neutral without letters."""
    right = sum(count_of(text, s) for s in RIGHT_TO_LEFT)
    left = sum(count_of(text, s) for s in SCRIPTS if s not in RIGHT_TO_LEFT)
    return F.when(right + left == 0, "neutral").when(right > left, "rtl").otherwise("ltr")


def runs(text: Column) -> Column:
    """Stretches of right-to-left letters, of left-to-right letters, and of the rest, in order."""
    rtl = "".join(rf"\p{{Is{s}}}" for s in RIGHT_TO_LEFT)
    return F.regexp_extract_all(text, F.lit(rf"([{rtl}]+|[\p{{L}}\p{{M}}&&[^{rtl}]]+|[^\p{{L}}\p{{M}}]+)"), F.lit(1))


def without_points(text: Column) -> Column:
    """Hebrew without vowel points and cantillation."""
    return F.regexp_replace(text, "[֑-ֽֿׁ-ׂׄ-ׇׅ]", "")


def without_final_forms(text: Column) -> Column:
    return F.translate(text, "ךםןףץ", "כמנפצ")


def final_sigma(text: Column) -> Column:
    """Sigma in its final form at the end of words, in its other form elsewhere."""
    return F.regexp_replace(F.translate(text, "ς", "σ"), r"σ(?=$|[^\p{L}\p{M}])", "ς")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


# Characters that decompose into one letter and marks, and their letters. Syllables decompose into several letters, and
# marks that Java's tables don't know yet are kept, in their canonical order.
_ORDERED = "".join(rf"\x{{{i:X}}}" for i in range(0x300, 0x30000) if unicodedata.combining(chr(i)))
SEVERAL = rf"(?![\x00-\x{{2FF}}])[\x{{AC00}}-\x{{D7A3}}[{_ORDERED}&&[^\p{{M}}]]]"
_DECOMPOSED = [(c, re.sub("[^ -~]", lambda m: "" if unicodedata.category(m[0])[0] == "M" else m[0], unicodedata.normalize("NFD", c))) for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.decomposition(c)[:1] not in ("", "<")]
UNMARKED = "".join(c for c, to in _DECOMPOSED if len(to) == 1), "".join(to for _, to in _DECOMPOSED if len(to) == 1)


def without_marks(text: Column) -> Column:
    """Letters without combining marks (decomposed, marks dropped).

    The order of marks that are dropped doesn't matter, so each character stands for its letter and Python sees few texts.
    """
    several = text.rlike(SEVERAL)
    one = F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, *UNMARKED), r"\p{M}+", "")).otherwise(text)
    return F.when(several, F.regexp_replace(nfd(F.when(several, text)), r"\p{M}+", "")).otherwise(one)


def count_marks(text: Column) -> Column:
    return F.length(F.regexp_replace(nfd(text), r"\P{M}+", ""))


def transliterate_hebrew(text: Column) -> Column:
    return F.translate(without_points(text), *HEBREW_ACADEMIC)


def transliterate_greek(text: Column) -> Column:
    """Decomposed Greek in Latin letters; a rough breathing before a vowel becomes h."""
    t = F.lower(nfd(text))
    t = F.regexp_replace(t, "([αεηιουω]{1,2})([̀́͂]*)̔", "h$1")
    t = F.regexp_replace(t, "ῥ", "rh")
    t = F.regexp_replace(t, r"\p{M}+", "")
    t = F.regexp_replace(t, "γ(?=[γκξχ])", "n")
    for letter, pair in GREEK_PAIRS:
        t = F.replace(t, F.lit(letter), F.lit(pair))
    return F.translate(t, *GREEK_ACADEMIC)
