"""Critical apparatuses in two dialects, one entry a line; lines that don't parse are kept as error rows.

``verse``  :  verses ¦ reading : reading ...       3-4 ¦ txt 01 A : τον θεον B D* (it) : om 𝔓46
``rated``  :  chapter:verse {A-D} [lemma] reading ...   5:2 {B} θεος κυριος 01 A ; om D it

A reading is words, then witnesses. ``txt`` marks the reading of the base text, which needs
no words. Readings are parted by ``:``, ``;``, ``¦`` or ``|``; in the rated dialect a word
after witnesses starts a reading too, and a first word before other words is the lemma. A
witness is a siglum, in brackets if it supports a reading in part, with ``*`` or ``c`` and a
number for its correctors and ``mg`` for its margin.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sigla by kind, numbers of those that have a letter, words that stand for no reading.
KINDS = {
    "papyrus": r"(?:𝔓|P)\d+",
    "uncial": r"[אABCDEFGHIKLPQWΔΘΨΩ]|0\d+",
    "minuscule": r"[1-9]\d*",
    "version": r"it|vg|syr|cop|eth|arm|geo|slav|arab",
    "father": r"Or|Ir|Cl|Chr|Aug",
}
LETTERS = {"א": "01", "A": "02", "B": "03", "C": "04", "D": "05", "E": "06", "F": "07", "G": "08", "H": "09", "I": "10"}
SYMBOLS = ("vid", "pc", "al", "rell", "mg", "s", "v.l.")
BASE_CONFIDENCE = 0.9

_SIGLUM = re.compile("(?P<siglum>" + "|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()) + r")(?:(?P<hand>\*)|(?P<corrector>c\d*))?(?P<margin>mg)?")
_HEADS = {"verse": re.compile(r"\s*(?P<first>\d+)(?:-(?P<last>\d+))?\s*¦(?P<rest>.*)", re.S), "rated": re.compile(r"\s*(?P<chapter>\d+):(?P<first>\d+)\s*\{(?P<rating>[ABCD])\}(?P<rest>.*)", re.S)}
_TOKEN = re.compile(r"[:;¦|]|[^\s:;¦|]+")
_WITNESS = "struct<siglum: string, number: string, kind: string, corrector: int, margin: boolean, partial: boolean>"
ENTRY = f"chapter int, first int, last int, rating string, lemma string, symbols array<string>, readings array<struct<text: string, is_base: boolean, confidence: double, witnesses: array<{_WITNESS}>>>, error string"


class Damaged(ValueError):
    pass


@dataclass
class _Reading:
    words: list[str] = field(default_factory=list)
    witnesses: list[dict] = field(default_factory=list)
    is_base: bool = False

    def row(self) -> dict:
        return {"text": " ".join(self.words), "is_base": self.is_base, "confidence": BASE_CONFIDENCE if self.is_base else None, "witnesses": self.witnesses}


def _witness(token: str) -> dict | None:
    partial = token.startswith("(") and token.endswith(")") and len(token) > 2
    m = _SIGLUM.fullmatch(token[1:-1] if partial else token)
    if not m:
        if token.startswith("(") != token.endswith(")"):
            raise Damaged(f"open bracket: {token}")
        return None
    s, hand = m["siglum"], m["corrector"]
    number = "P" + s.lstrip("𝔓P") if m["papyrus"] else LETTERS.get(s, s)
    corrector = 1 if m["hand"] else int(hand[1:] or 1) if hand else None
    return {"siglum": s, "number": number, "kind": next(k for k in KINDS if m[k]), "corrector": corrector, "margin": m["margin"] is not None, "partial": partial}


def _reading(tokens: list[str], at: int, symbols: list[str], joined: bool) -> tuple[_Reading, int]:
    """The reading at a place and the place after it; ``joined`` if a word after witnesses ends it."""
    r = _Reading()
    while at < len(tokens) and tokens[at] not in ":;¦|":
        token = tokens[at]
        if token == "txt" and not r.words and not r.witnesses:
            r.is_base = True
        elif token in SYMBOLS:
            symbols.append(token)
        elif (w := _witness(token)) is not None:
            r.witnesses.append(w)
        elif r.witnesses and joined:
            break
        elif r.witnesses:
            raise Damaged(f"word after witnesses: {token}")
        else:
            r.words.append(token)
        at += 1
    if not (r.words or r.witnesses or r.is_base):
        raise Damaged("empty reading")
    return r, at


def parse(line: str, dialect: str) -> dict:
    """One line as a row of ENTRY without error; raises Damaged."""
    head = _HEADS[dialect].fullmatch(line)
    if not head:
        raise Damaged("no head")
    found, tokens, symbols, readings, lemma = head.groupdict(), _TOKEN.findall(head["rest"]), [], [], None
    rated = dialect == "rated"
    first, last = int(found["first"]), int(found.get("last") or found["first"])
    if max(first, last, int(found.get("chapter") or 0)) > 9999:
        raise Damaged("number too large")
    if last < first:
        raise Damaged("range turned round")
    plain = lambda t: t not in ":;¦|" and t not in SYMBOLS and t != "txt" and _witness(t) is None
    at = 0
    if rated and len(tokens) > 1 and plain(tokens[0]) and (plain(tokens[1]) or tokens[1] in ":;¦|"):
        lemma, at = tokens[0], 1 + (tokens[1] in ":;¦|")
    while True:
        r, at = _reading(tokens, at, symbols, rated)
        readings.append(r.row())
        if at == len(tokens):
            break
        at += tokens[at] in ":;¦|"
    return {"chapter": int(found["chapter"]) if rated else None, "first": first, "last": last, "rating": found.get("rating"), "lemma": lemma, "symbols": symbols, "readings": readings}


def entries(lines: DataFrame, text: str, dialect: str, kept: list[str]) -> DataFrame:
    """(kept..., line, verse, and the columns of ENTRY without first and last): a row for each verse of each line.

    Lines that are null or blank are left out. Of a damaged line one row stays, with its
    text, ``error`` and no readings.
    """
    if dialect not in _HEADS:
        raise ValueError(f"no dialect {dialect}")

    @F.pandas_udf(ENTRY)
    def parsed(column: pd.Series) -> pd.DataFrame:
        def one(line):
            try:
                return {**parse(line, dialect), "error": None}
            except Damaged as e:
                return {"error": str(e)}

        names = ["chapter", "first", "last", "rating", "lemma", "symbols", "readings", "error"]
        out = pd.DataFrame([one(t) for t in column], columns=names)
        return out.astype({n: "Int32" for n in ("chapter", "first", "last")}).astype({n: object for n in names[3:]}).where(out.notna(), None)

    rows = lines.where(F.col(text).rlike(r"\S")).select(*kept, F.col(text).alias("line"), parsed(text).alias("e"))
    verses = F.explode(F.when(F.col("e.error").isNull(), F.sequence("e.first", "e.last")).otherwise(F.array(F.lit(None).cast("int"))))
    return rows.select(*kept, "line", verses.alias("verse"), *[f"e.{c}" for c in ("chapter", "rating", "lemma", "symbols", "readings", "error")])


def read(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """The entries of text files, with ``file``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return entries(lines, "value", dialect, ["file"])


def change(base: Column, reading: Column) -> Column:
    """Kind of a reading against the base text: omission, addition, transposition, spelling (same length, two letters at most), substitution.

    Repeated words count once in transpositions.
    """
    words = lambda t: F.array_sort(F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")))
    letters = lambda t: F.split(t, "")
    apart = F.size(F.filter(F.zip_with(letters(base), letters(reading), lambda a, b: a != b), lambda x: x))
    return (
        F.when(F.coalesce(reading, F.lit("")).isin("", "om"), "omission")
        .when(F.coalesce(base, F.lit("")).isin("", "om"), "addition")
        .when(words(base) == words(reading), "transposition")
        .when((F.length(base) == F.length(reading)) & (apart <= 2), "spelling")
        .otherwise("substitution")
    )
