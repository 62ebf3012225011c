"""Transliteration by rule tables: Hebrew, Greek, Arabic, Syriac, and schemes of the caller.

Rules apply to a whole text one after the other, those of higher priority first, then
longer sources, then in the order of their table; a rule that can't fire any more is
left out. No target may hold a character of a source, so that nothing is replaced twice
and the rules for single characters become one ``translate``. Everything else stays as
it is. Reverse schemes swap the two sides of all rules that are reversible.
Null texts give null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``before`` and ``after`` are regular expressions that must match next to the source; reversed rules have none."""

    source: str
    target: str
    priority: int = 10
    before: str = ""
    after: str = ""
    reversible: bool = True


def _table(text: str, priority: int) -> list[Rule]:
    return [Rule(*pair.split("=", 1), priority) for pair in text.split()]


# The schemes, source=target.
_HEBREW_SBL = (
    _table("א=ʾ ב=b ג=g ד=d ה=h ו=w ז=z ח=ḥ ט=ṭ י=y כ=k ך=ḵ ל=l מ=m ם=m נ=n ן=n ס=s ע=ʿ פ=p ף=p̄ צ=ṣ ץ=ṣ ק=q ר=r ש=š ת=t", 10)
    + _table("בּ=b גּ=g דּ=d וּ=w כּ=k פּ=p שׁ=š שׂ=ś תּ=t", 11)
    + _table("ַ=a ָ=ā ֶ=e ֵ=ē ִ=i ֹ=ō ֻ=u ְ=ĕ ֲ=ă ֱ=ĕ ֳ=ŏ", 5)
    + _table("וֹ=ô וּ=û יִ=î", 6)
    + _table("־=- ׃=.", 1)
)
_HEBREW_SIMPLE = (
    _table("א=' ב=v ג=g ד=d ה=h ו=v ז=z ח=ch ט=t י=y כ=kh ך=kh ל=l מ=m ם=m נ=n ן=n ס=s ע=' פ=f ף=f צ=ts ץ=ts ק=k ר=r ש=sh ת=t", 10)
    + _table("בּ=b כּ=k פּ=p שׁ=sh שׂ=s", 11)
    + _table("ַ=a ָ=a ֶ=e ֵ=e ִ=i ֹ=o ֻ=u ְ=e", 5)
)
_GREEK_SBL = (
    _table("α=a β=b γ=g δ=d ε=e ζ=z η=ē θ=th ι=i κ=k λ=l μ=m ν=n ξ=x ο=o π=p ρ=r σ=s ς=s τ=t υ=y φ=ph χ=ch ψ=ps ω=ō", 10)
    + _table("αι=ai ει=ei οι=oi υι=yi αυ=au ευ=eu ου=ou ά=á ὰ=à ᾶ=â", 11)
    + _table("ἀ=a ἁ=ha γγ=ng γκ=nk γξ=nx γχ=nch", 12)
)
_GREEK_SIMPLE = _table("α=a β=b γ=g δ=d ε=e ζ=z η=e θ=th ι=i κ=k λ=l μ=m ν=n ξ=x ο=o π=p ρ=r σ=s ς=s τ=t υ=u φ=f χ=ch ψ=ps ω=o", 10)
_BETA_CODE = _table("α=a β=b γ=g δ=d ε=e ζ=z η=h θ=q ι=i κ=k λ=l μ=m ν=n ξ=c ο=o π=p ρ=r σ=s ς=s τ=t υ=u φ=f χ=x ψ=y ω=w", 10) + _table("Α=*a Β=*b", 11)
_ARABIC_DIN = _table("ا=ā ب=b ت=t ث=ṯ ج=ǧ ح=ḥ خ=ḫ د=d ذ=ḏ ر=r ز=z س=s ش=š ص=ṣ ض=ḍ ط=ṭ ظ=ẓ ع=ʿ غ=ġ ف=f ق=q ك=k ل=l م=m ن=n ه=h و=w ي=y ء=ʾ ة=h ى=ā", 10) + _table("ال=al-", 11)
_SYRIAC = _table("ܐ=ʾ ܒ=b ܓ=g ܕ=d ܗ=h ܘ=w ܙ=z ܚ=ḥ ܛ=ṭ ܝ=y ܟ=k ܠ=l ܡ=m ܢ=n ܣ=s ܥ=ʿ ܦ=p ܨ=ṣ ܩ=q ܪ=r ܫ=š ܬ=t", 10)
SCHEMES: dict[str, list[Rule]] = {
    "sbl_hebrew": _HEBREW_SBL,
    "academic_hebrew": _HEBREW_SBL + _table("צ=ṣ ץ=ṣ ק=q", 12),
    "simple_hebrew": _HEBREW_SIMPLE,
    "iso_259": _HEBREW_SIMPLE,
    "sbl_greek": _GREEK_SBL,
    "academic_greek": _GREEK_SBL + _table("ῥ=rh Ῥ=Rh", 13),
    "simple_greek": _GREEK_SIMPLE,
    "beta_code": _BETA_CODE,
    "arabic_din": _ARABIC_DIN,
    "syriac_academic": _SYRIAC,
}
DEFAULT = {"hebrew": "sbl_hebrew", "greek": "sbl_greek", "arabic": "arabic_din", "syriac": "syriac_academic"}
#: Characters that must be gone after a scheme was applied.
UNCONVERTED = {"hebrew": r"[\x{0590}-\x{05FF}]", "greek": r"[\x{0370}-\x{03FF}]", "arabic": r"[\x{0600}-\x{06FF}]", "syriac": r"[\x{0700}-\x{074F}]"}


def _rules(scheme: str | list[Rule]) -> list[Rule]:
    return SCHEMES[DEFAULT.get(scheme, scheme)] if isinstance(scheme, str) else scheme


def in_order(rules: list[Rule]) -> list[Rule]:
    """Rules that can fire, in the order in which they do. Raises ValueError where a target holds a character of a source."""
    seen = {c for r in rules for c in r.source}
    clash = sorted({c for r in rules for c in r.target} & seen)
    if clash or any(r.source == "" for r in rules):
        raise ValueError(f"targets hold characters of sources: {clash}" if clash else "a rule has no source")
    live: list[Rule] = []
    for r in sorted(rules, key=lambda r: (-r.priority, -len(r.source))):
        if not any(e.source in r.source and not (e.before or e.after) for e in live):
            live.append(r)
    return live


def reversed_rules(rules: list[Rule]) -> list[Rule]:
    return [Rule(r.target, r.source, r.priority) for r in rules if r.reversible]


def _apply(text: Column, rules: list[Rule]) -> Column:
    live = in_order(rules)
    single = [r for r in live if len(r.source) == len(r.target) == 1 and not (r.before or r.after)]
    for r in live:
        if r in single:
            # Its place is free: what holds its source and fires later was left out, what fires earlier comes before translate.
            continue
        if r.before or r.after:
            ahead = f"(?<={r.before})" if r.before else ""
            behind = f"(?={r.after})" if r.after else ""
            text = F.regexp_replace(text, f"{ahead}{re.escape(r.source)}{behind}", r.target.replace("\\", "\\\\").replace("$", "\\$"))
        else:
            text = F.replace(text, F.lit(r.source), F.lit(r.target))
    return F.translate(text, "".join(r.source for r in single), "".join(r.target for r in single)) if single else text


def transliterate(text: Column, scheme: str | list[Rule]) -> Column:
    """``scheme`` is a name of SCHEMES, a language of DEFAULT, or a list of rules."""
    return _apply(text, _rules(scheme))


def reverse_transliterate(text: Column, scheme: str | list[Rule]) -> Column:
    """Back to the source script; of rules with equal targets the first in order wins, so final forms are lost."""
    return _apply(text, reversed_rules(_rules(scheme)))


def problems(original: Column, result: Column, language: str) -> Column:
    """array of: empty, unconverted (characters of the language's block are left), null character."""
    found = (
        F.when((F.length(original) > 0) & (F.coalesce(F.length(result), F.lit(0)) == 0), "empty"),
        F.when(result.rlike(UNCONVERTED[language]), "unconverted"),
        F.when(F.instr(result, "\0") > 0, "null character"),
    )
    return F.array_compact(F.array(*found))


def is_reversible(original: Column, result: Column, scheme: str | list[Rule]) -> Column:
    """Whether the reverse scheme gives the original; both must be in one Unicode form."""
    return reverse_transliterate(result, scheme).eqNullSafe(original)
