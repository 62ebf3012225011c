"""Text expressions: tokenisers, stemming, tagging by form, normalising, n-grams. Column in, Column out."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the search index.
STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an", "is", "are", "was",
    "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "can", "shall", "must", "ought", "said", "says", "he", "she", "it", "they", "them", "their", "his",
    "her", "its", "this", "that", "these", "those", "i", "you", "we", "us", "me", "him",
)
# Suffixes of the simple stemmer, tried in this order.
STEM_SUFFIXES = ("ing", "ed", "er", "est", "ly", "s")
# Spellings made equal before texts are compared.
ARCHAIC_FOR_COMPARISON = (("saith", "says"), ("yea", "yes"), ("verily", "truly"), ("behold", "see"))
DETERMINERS = ("the", "a", "an", "this", "that", "these", "those")
PRONOUNS = ("he", "she", "it", "they", "we", "you", "i")


def words(text: Column) -> Column:
    r"""Lower-cased words, Unicode ``\w+``; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def ascii_words(text: Column) -> Column:
    """Runs of the letters A-Z and a-z, in their own case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([a-zA-Z]+)"), F.lit(1))


def latin_words(text: Column) -> Column:
    """Lower-cased runs of a-z, for queries that must agree between engines."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def word_and_sign_tokens(text: Column) -> Column:
    """Words, and single signs that are neither word characters nor white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def compound_parts(tokens: Column) -> Column:
    """Tokens joined by a slash are split into their parts; empty parts go."""
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "/"))), lambda t: t != "")


def without_stop_words(tokens: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def simple_stem(word: Column) -> Column:
    """The word without the first listed suffix that leaves more than two characters."""
    out = F
    for suffix in STEM_SUFFIXES:
        fits = word.endswith(suffix) & (F.length(word) > len(suffix) + 2)
        out = out.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def guess_pos(word: Column) -> Column:
    """A word class from the form of the word."""
    low = F.lower(word)
    first = F.substring(word, 1, 1)
    return (
        F.when(low.endswith("ing") | low.endswith("ed"), "verb")
        .when(low.endswith("ly"), "adverb")
        .when(low.endswith("ness") | low.endswith("tion"), "noun")
        .when((first != F.lower(first)) & ~word.isin("I", "The", "A", "An"), "proper_noun")
        .when(low.isin(*DETERMINERS), "determiner")
        .when(low.isin(*PRONOUNS), "pronoun")
        .otherwise("other")
    )


def normalise_for_comparison(text: Column) -> Column:
    """Lower case, equal spellings, punctuation to spaces, single spaces."""
    out = low = F.lower(text)
    for old, new in ARCHAIC_FOR_COMPARISON:
        out = F.regexp_replace(out, rf"(?U)\b{old}\b", new)
    some = "|".join(old for old, _ in ARCHAIC_FOR_COMPARISON)
    out = F.when(low.rlike(rf"(?U)\b(?:{some})\b"), out).otherwise(low)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def least_normalised(text: Column) -> Column:
    """A bound from below on the length of ``normalise_for_comparison``, by one translation: ASCII letters and digits stay, and no spelling is shortened by over half."""
    return (F.length(text) - F.length(F.translate(text, string.ascii_letters + string.digits, ""))) / 2


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` tokens as strings, in order; empty if there are fewer."""
    last = F.size(tokens) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), sep))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def phrases(tokens: Column, shortest: int = 2, longest: int = 5) -> Column:
    return F.concat(*[ngrams(tokens, n) for n in range(shortest, longest + 1)])


def context_phrases(tokens: Column, n: int, reach: int = 3) -> Column:
    """(phrase, start, left, right): each run of ``n`` tokens with up to ``reach`` tokens around it."""
    last = F.size(tokens) - n

    def one(i: Column) -> Column:
        begin = F.greatest(i - reach, F.lit(0))
        return F.struct(
            F.array_join(F.slice(tokens, i + 1, n), " ").alias("phrase"),
            i.alias("start"),
            F.slice(tokens, begin + 1, i - begin).alias("left"),
            F.slice(tokens, i + n + 1, reach).alias("right"),
        )

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one))


def classify_phrase(phrase: Column, count: Column) -> Column:
    """A phrase is fixed from ten uses, frequent from five, else occasional."""
    return F.when(count >= 10, "fixed").when(count >= 5, "frequent").otherwise("occasional")


# Old words and what stands for them before texts are embedded.
MODERN_SPELLINGS = (
    ("thou", "you"),
    ("thee", "you"),
    ("thy", "your"),
    ("thine", "yours"),
    ("ye", "you"),
    ("hath", "has"),
    ("doth", "does"),
    ("saith", "says"),
)


def modern_spelling(text: Column) -> Column:
    """Old words replaced in any case, and ``3:16`` numbers dropped."""
    out = F.regexp_replace(text, r"\b\d+:\d+\b", "")
    for old, new in MODERN_SPELLINGS:
        out = F.regexp_replace(out, rf"(?i)\b{old}\b", new)
    return F.trim(out)


def order_changes(a: Column, b: Column) -> Column:
    """How many words of ``a`` first stand more than one place away in ``b``."""
    places = F.transform(a, lambda w, i: F.when(F.array_contains(b, w), F.abs(i - F.array_position(b, w) + 1)))
    return F.size(F.filter(places, lambda d: d > 1))
