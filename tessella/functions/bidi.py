"""Texts of both writing directions: runs with levels, order on display, mirrored brackets, embedding marks, interlinear lines.

Strong characters are those of the right-to-left blocks, and letters, spacing marks and
letter numbers of all others; a run is a strong character with all that follows up to
one of the other direction. Characters before the first strong one make a run of their
own in the base direction, so the runs of a text always give it back. All are column
expressions over whole texts. Null texts give null, empty ones no runs.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks written from right to left, pairs of brackets, marks of embedding.
BLOCKS = ((0x0590, 0x05FF), (0x0600, 0x06FF), (0x0700, 0x074F), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF), (0xFB1D, 0xFB4F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))
BRACKETS = ("()[]{}<>", ")(][}{><")
EMBED = {"rtl": "‫", "ltr": "‪"}
POP = "‬"


def _ranges(blocks: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """The same characters in fewer ranges: each range is asked for each character."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(blocks):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RANGES = _ranges(BLOCKS)
RIGHT = "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in RANGES)
LETTER = r"\p{L}\p{Mc}\p{Nl}"
_RIGHTS = "".join(chr(i) for a, b in RANGES for i in range(a, b + 1))
_NEUTRAL = "".join(c for c in map(chr, range(128)) if c not in string.ascii_letters + "\n")
LEFT = rf"[{LETTER}]&&[^{RIGHT}]"
_RUNS = rf"[{RIGHT}][{RIGHT}[^{LETTER}]]*+|[{LEFT}][^{RIGHT}]*+|[^{RIGHT}{LETTER}]++"


def base_direction(text: Column) -> Column:
    """rtl if right-to-left characters are more than left-to-right ones, ltr if there are others, auto without strong ones."""
    return direction_of(strong(text))


def _once(value: Column, then) -> Column:
    """``then`` of a value that it names several times: the value is computed once."""
    return F.transform(F.array(value), then)[0]


def strong(text: Column) -> Column:
    """The text's strong characters, each as R or L, and its line ends; all others are left out.

    Translating costs less than a match for each character, so expressions are left what is neither
    ASCII nor of the right-to-left blocks.
    """
    known = F.translate(text, _RIGHTS + string.ascii_letters + _NEUTRAL, "R" * len(_RIGHTS) + "L" * len(string.ascii_letters))
    return F.regexp_replace(F.regexp_replace(known, rf"[[^RL\n]&&[{LETTER}]]", "L"), r"[^RL\n]++", "")


def _count(found: Column, part: str) -> Column:
    return (F.length(found) - F.length(F.replace(found, F.lit(part), F.lit("")))) / len(part)


def _sides(found: Column) -> Column:
    return F.struct(_count(found, "R").alias("right"), _count(found, "L").alias("left"))


def direction_of(found: Column) -> Column:
    """The base direction of the text with these ``strong`` characters."""
    return _once(_sides(found), _direction)


def n_runs(text: Column, found: Column | None = None) -> Column:
    """How many ``runs`` there are, none of them made: changes of direction are counted in the text's ``strong`` characters."""
    first = F.when(text.rlike(rf"^[^{RIGHT}{LETTER}]"), 1).otherwise(0)
    count = lambda s: F.when(s == "", 0).otherwise(1 + _count(s, "RL") + _count(s, "LR"))
    joined = F.replace(strong(text) if found is None else found, F.lit("\n"), F.lit(""))
    return (F.when(text.isNotNull(), first) + _once(joined, count)).cast("long")


def _direction(n: Column) -> Column:
    return F.when(n["right"] > n["left"], "rtl").when(n["left"] > 0, "ltr").when(n["right"].isNotNull(), "auto")


def _is_right(run: Column) -> Column:
    """By the order of code points, which strings compare by."""
    first = F.substring(run, 1, 1)
    tests = [first.between(chr(a), chr(b)) for a, b in RANGES]
    return reduce(lambda x, y: x | y, tests)


def _is_left(run: Column) -> Column:
    return run.rlike(rf"^[{LEFT}]")


def segments(text: Column, base: Column | None = None) -> Column:
    """array<struct<start, run, direction, level>> in logical order; ``start`` counts characters from 0.

    On a base of auto the level of left-to-right runs is 2, as on a base of rtl.
    """
    base = base_direction(text) if base is None else base
    even = F.when(base == "ltr", 0).otherwise(2)

    def add(done: Column, run: Column) -> Column:
        start = F.when(F.size(done) == 0, F.lit(0)).otherwise(F.try_element_at(done, F.lit(-1))["start"] + F.length(F.try_element_at(done, F.lit(-1))["run"]))
        to = F.when(_is_right(run), "rtl").when(_is_left(run), "ltr").when(base == "rtl", "rtl").otherwise("ltr")
        one = F.struct(start.cast("int").alias("start"), run.alias("run"), to.alias("direction"), F.when(to == "rtl", F.lit(1)).otherwise(even).alias("level"))
        return F.concat(done, F.array(one))

    empty = F.array().cast("array<struct<start:int,run:string,direction:string,level:int>>")
    return F.aggregate(runs(text), empty, add)


def runs(text: Column) -> Column:
    """array of the runs in logical order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))


def display(text: Column, base: Column | None = None, found: Column | None = None) -> Column:
    """Lines with their runs in order of display: reversed unless the line's base is ltr. Letters within a run keep their order.

    ``found`` are the text's ``strong`` characters, where they are known already.
    """
    shown = lambda t, b: F.when(b == "ltr", t).otherwise(F.array_join(F.reverse(runs(t)), ""))
    cut = lambda t: F.split(t, "\n")
    if base is not None:
        return F.array_join(F.transform(cut(text), lambda t: shown(t, base)), "\n")
    found = strong(text) if found is None else found
    return F.array_join(F.zip_with(cut(text), cut(found), lambda t, s: shown(t, direction_of(s))), "\n")


def mirrored(text: Column) -> Column:
    """Brackets in right-to-left runs turned round. A text's leading neutrals are taken as left-to-right.
    A text without brackets stays as it is.
    """
    has = lambda t: t.rlike(r"[()\[\]{}<>]")
    turned = F.transform(runs(text), lambda r: F.when(_is_right(r) & has(r), F.translate(r, *BRACKETS)).otherwise(r))
    return F.when(has(text), F.array_join(turned, "")).otherwise(text)


def embedded(text: Column, base: Column | None = None) -> Column:
    """Each strong character against the base direction stands between a mark of embedding and one that ends it; all do where the base is auto."""
    base = base_direction(text) if base is None else base
    right = F.regexp_replace(text, rf"[{RIGHT}]", f"{EMBED['rtl']}$0{POP}")
    left = lambda t: F.regexp_replace(t, rf"[{LEFT}]", f"{EMBED['ltr']}$0{POP}")
    return F.when(base == "ltr", right).when(base == "rtl", left(text)).otherwise(left(right))


def _centred(word: Column, width: Column) -> Column:
    """The spare place of an odd rest stands left where the width is odd."""
    rest = width - F.length(word)
    before = F.floor(rest / 2) + (rest % 2) * (width % 2)
    return F.rpad(F.concat(F.repeat(F.lit(" "), before.cast("int")), word), width, " ")


def interlinear(original: Column, translation: Column, pairs: Column) -> Column:
    """struct(original, translation): words under their translations in columns two wider than the longer word.

    ``pairs`` is array<struct<source, target>> of word numbers from 0; the last pair of a
    word holds, words without a translation have a dash. Right-to-left lines start with
    their last word and stand flush right.
    """
    cut = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    words, other = cut(original), cut(translation)
    right = base_direction(original) == "rtl"

    def column(w: Column, i: Column) -> Column:
        target = F.try_element_at(F.filter(pairs, lambda p: p["source"] == i), F.lit(-1))["target"]
        below = F.when(target.between(0, F.size(other) - 1), F.get(other, target.cast("int")))
        return F.struct(w.alias("w"), F.coalesce(below, F.lit("—")).alias("t"))

    made = F.transform(words, column)
    made = F.when(right, F.reverse(made)).otherwise(made)
    width = lambda p: F.greatest(F.length(p["w"]), F.length(p["t"])) + 2
    top = F.transform(made, lambda p: F.when(right, F.lpad(p["w"], width(p), " ")).otherwise(F.rpad(p["w"], width(p), " ")))
    low = F.transform(made, lambda p: _centred(p["t"], width(p)))
    return F.struct(F.array_join(top, " ").alias("original"), F.array_join(low, " ").alias("translation"))
