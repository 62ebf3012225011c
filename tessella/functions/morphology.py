"""Morphology codes to structs: position-coded letters looked up in small tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the codes.
HEBREW_POS = {"A": "adjective", "C": "conjunction", "D": "adverb", "N": "noun", "P": "pronoun", "R": "preposition", "S": "suffix", "T": "particle", "V": "verb"}
HEBREW_STEM = {"q": "qal", "N": "niphal", "p": "piel", "P": "pual", "h": "hiphil", "H": "hophal", "t": "hithpael"}
HEBREW_FORM = {"p": "perfect", "q": "sequential perfect", "i": "imperfect", "w": "sequential imperfect", "v": "imperative", "r": "active participle", "s": "passive participle", "a": "infinitive absolute", "c": "infinitive construct", "j": "jussive", "h": "cohortative"}
GENDER = {"m": "masculine", "f": "feminine", "n": "neuter", "c": "common", "b": "both"}
NUMBER = {"s": "singular", "p": "plural", "d": "dual"}
STATE = {"a": "absolute", "c": "construct", "d": "determined"}
GREEK_POS = {"N": "noun", "V": "verb", "A": "adjective", "T": "article", "P": "pronoun", "R": "relative pronoun", "D": "adverb", "C": "conjunction", "X": "particle", "I": "interjection"}
GREEK_TENSE = {"P": "present", "I": "imperfect", "F": "future", "A": "aorist", "R": "perfect", "L": "pluperfect"}
GREEK_VOICE = {"A": "active", "M": "middle", "P": "passive", "E": "middle or passive", "D": "deponent"}
GREEK_MOOD = {"I": "indicative", "S": "subjunctive", "O": "optative", "M": "imperative", "N": "infinitive", "P": "participle"}
GREEK_CASE = {"N": "nominative", "G": "genitive", "D": "dative", "A": "accusative", "V": "vocative"}


def _at(code: Column, i: int, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.substring(code, i, 1))


def hebrew(code: Column) -> Column:
    """Fields of codes like ``HVqp3ms`` and ``HNcmsa``; the main word is the part after the last slash."""
    c = F.element_at(F.split(F.regexp_replace(code, "^[HA]", ""), "/"), -1)
    pos, verb, noun = _at(c, 1, HEBREW_POS), F.substring(c, 1, 1) == "V", F.substring(c, 1, 1).isin("N", "A")
    # a participle or infinitive has no person, so its gender stands one place earlier
    person = F.regexp_extract(F.substring(c, 4, 1), "([123])", 1)
    at = lambda i, t: F.when(person != "", _at(c, i + 1, t)).otherwise(_at(c, i, t))
    return F.struct(
        F.when(code.startswith("A"), "aramaic").otherwise("hebrew").alias("language"),
        pos.alias("pos"),
        F.when(verb, _at(c, 2, HEBREW_STEM)).alias("stem"),
        F.when(verb, _at(c, 3, HEBREW_FORM)).alias("form"),
        F.when(verb & (person != ""), person).alias("person"),
        F.when(verb, at(4, GENDER)).when(noun, _at(c, 3, GENDER)).alias("gender"),
        F.when(verb, at(5, NUMBER)).when(noun, _at(c, 4, NUMBER)).alias("number"),
        F.when(noun, _at(c, 5, STATE)).alias("state"),
    )


def greek(code: Column) -> Column:
    """Fields of codes like ``V-AAI-3S`` and ``N-NSM``."""
    parts = F.split(code, "-")
    pos, body, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    verb = pos == "V"
    low = lambda c, i, t: _at(F.lower(c), i, t)
    participle = verb & (F.substring(body, 3, 1) == "P")
    return F.struct(
        _at(pos, 1, GREEK_POS).alias("pos"),
        F.when(verb, _at(body, 1, GREEK_TENSE)).alias("tense"),
        F.when(verb, _at(body, 2, GREEK_VOICE)).alias("voice"),
        F.when(verb, _at(body, 3, GREEK_MOOD)).alias("mood"),
        F.when(verb & ~participle, F.nullif(F.regexp_extract(tail, "^([123])", 1), F.lit(""))).alias("person"),
        F.when(participle, _at(tail, 1, GREEK_CASE)).when(~verb, _at(body, 1, GREEK_CASE)).alias("case"),
        F.when(verb, low(tail, 2, NUMBER)).otherwise(low(body, 2, NUMBER)).alias("number"),
        F.when(participle, low(tail, 3, GENDER)).when(~verb, low(body, 3, GENDER)).alias("gender"),
    )


def strong_number(lemma: Column, prefix: str) -> Column:
    """``b/7225`` to ``H7225``: the first run of digits of the lemma's first word."""
    digits = F.regexp_extract(F.get(F.split(lemma, r"\s+"), F.lit(0)), r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit(prefix), digits))
