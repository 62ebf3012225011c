"""Queries over texts of both directions, transliteration, and ranges of uncertain values.

The given texts are in Latin letters; Spark writes some of their letters in another
script first, and the SQL works on texts written alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bidi, probability, transliteration
from ..operators import consensus
from .base import query, table

MANY = ("bcdfghklmnpqrstvwz", "בגדפהחכלמנסעצקרשתט")
FEW = ("rst", "רשת")
GREEK = ("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω")
#: Both directions, as RE2 says them for Latin and Hebrew letters.
_R, _L = r"\x{0590}-\x{05FF}", r"\p{Latin}"
_SPLIT = rf"[{_R}][^{_L}]*|[{_L}][^{_R}]*|[^{_R}{_L}]+"


def _base(t: str) -> str:
    n = lambda s: f"len(regexp_extract_all({t}, '[{s}]'))"
    return f"CASE WHEN {n(_R)} > {n(_L)} THEN 'rtl' WHEN {n(_L)} > 0 THEN 'ltr' ELSE 'auto' END"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.translate("text", *FEW)).otherwise(F.translate("text", *MANY)).alias("t"))


WRITTEN = f"w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, '{FEW[0]}', '{FEW[1]}') ELSE translate(text, '{MANY[0]}', '{MANY[1]}') END AS t FROM documents)"


@query(f"""WITH {WRITTEN}, b AS (SELECT *, CASE WHEN t IS NOT NULL THEN {_base('t')} END AS direction, regexp_extract_all(t, '{_SPLIT}') AS runs FROM w)
  SELECT doc_id, direction, CAST(len(runs) AS BIGINT) AS n_runs,
    md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN {_base('x')} = 'ltr' THEN x ELSE coalesce(array_to_string(list_reverse(regexp_extract_all(x, '{_SPLIT}')), ''), '') END), chr(10))) AS display,
    md5(array_to_string(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[{_R}]') THEN translate(r, '()[]{{}}<>', ')(][}}{{><') ELSE r END), '')) AS mirrored,
    md5(CASE direction WHEN 'ltr' THEN regexp_replace(t, '([{_R}])', chr(8235) || '\\1' || chr(8236), 'g') WHEN 'rtl' THEN regexp_replace(t, '([{_L}])', chr(8234) || '\\1' || chr(8236), 'g') ELSE t END) AS embedded
  FROM b""")
def writing_directions(spark, sf_dir):
    """Half of the documents with many Hebrew letters among their Latin ones, half with a few."""
    w, t = _written(spark, sf_dir), F.col("t")
    w, found = w.withColumn("found", bidi.strong(t)), F.col("found")
    w = w.withColumn("direction", bidi.direction_of(found))
    shown, marked = bidi.display(t, found=found), bidi.embedded(t, F.col("direction"))
    return w.select("doc_id", "direction", bidi.n_runs(t, found).alias("n_runs"), F.md5(shown).alias("display"), F.md5(bidi.mirrored(t)).alias("mirrored"), F.md5(marked).alias("embedded"))


_PAIRS = "replace(replace(replace(g, 'θ', 'th'), 'χ', 'ch'), 'ψ', 'ps')"
_NASAL = "replace(replace(replace(replace(g, 'γγ', 'ng'), 'γκ', 'nk'), 'γξ', 'nx'), 'γχ', 'nch')"
_SBL = f"replace(replace(replace(replace(replace(replace(replace(replace({_NASAL}, 'υι', 'yi'), 'αυ', 'au'), 'ευ', 'eu'), 'ου', 'ou'), 'θ', 'th'), 'φ', 'ph'), 'χ', 'ch'), 'ψ', 'ps')"


@query(f"""WITH w AS (SELECT doc_id, text, translate(text, '{GREEK[0]}', '{GREEK[1]}') AS g FROM documents)
  SELECT doc_id, md5(text) AS beta, md5(translate({_PAIRS}, 'αβγδεζηικλμνξοπρστυφω', 'abgdezeiklmnxoprstufo')) AS simple,
    md5(translate({_SBL}, 'αβγδεζηικλμνξοπρστυω', 'abgdezēiklmnxoprstyō')) AS sbl, text NOT LIKE '%*a%' AND text NOT LIKE '%*b%' AS reversible,
    CASE WHEN text IS NOT NULL THEN 0 END AS problems FROM w""")
def transliteration_schemes(spark, sf_dir):
    """Documents in Greek letters, back in Latin ones by three schemes; whether the plainest of them can be undone."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", *GREEK).alias("g"))
    g = F.col("g")
    beta, simple, sbl = (transliteration.transliterate(g, s) for s in ("beta_code", "simple_greek", "sbl_greek"))
    back = F.when(g.isNotNull(), transliteration.is_reversible(g, beta, "beta_code"))
    bad = F.when(g.isNotNull(), F.size(transliteration.problems(g, simple, "greek")))
    return w.select("doc_id", F.md5(beta).alias("beta"), F.md5(simple).alias("simple"), F.md5(sbl).alias("sbl"), back.alias("reversible"), bad.alias("problems"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value as the start of a range of one to seven, in one of four distributions; its inner 68 %."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    v, w, k = F.col("value"), (1 + F.col("event_id") % 7).cast("double"), F.col("event_id") % 4
    kind = F.element_at(F.array(*[F.lit(x) for x in ("uniform", "normal", "triangular", "beta")]), (k + 1).cast("int"))
    b = F.when(k == 1, w).otherwise(v + w)
    c = F.when(k == 2, v + w / 4).when(k == 3, (1 + F.col("event_id") % 3).cast("double"))
    d = F.when(k == 3, F.lit(1.0))
    return e.select("event_id", "user_id", kind.alias("kind"), probability.interval(kind, v, b, c, d, 0.68).alias("i")).select("event_id", "user_id", "kind", "i.low", "i.high")


RANGES = """e AS (SELECT event_id, user_id, value AS v, 1.0::DOUBLE + event_id % 7 AS w, event_id % 4 AS k, 1.0::DOUBLE / (1 + event_id % 3) AS power FROM events WHERE value IS NOT NULL),
  r AS (SELECT event_id, user_id, CASE k WHEN 0 THEN 'uniform' WHEN 1 THEN 'normal' WHEN 2 THEN 'triangular' ELSE 'beta' END AS kind,
    CASE k WHEN 0 THEN v + 0.16 * w WHEN 1 THEN v - 0.994457883209753 * w WHEN 2 THEN v + 0.2 * w ELSE v + w * pow(0.16, power) END AS low,
    CASE k WHEN 0 THEN v + 0.84 * w WHEN 1 THEN v + 0.994457883209753 * w WHEN 2 THEN v + w - sqrt(0.12) * w ELSE v + w * pow(0.84, power) END AS high FROM e)"""


@query(f"WITH {RANGES} SELECT event_id, kind, round(low, 6) AS low, round(high, 6) AS high FROM r")
def uncertain_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir).select("event_id", "kind", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {RANGES}, p AS (SELECT a.user_id, sum(CASE WHEN least(a.high, b.high) > greatest(a.low, b.low)
    THEN (least(a.high, b.high) - greatest(a.low, b.low)) / (greatest(a.high, b.high) - least(a.low, b.low)) ELSE 0 END) AS s
    FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_id < b.event_id GROUP BY a.user_id)
  SELECT user_id, n, round(CASE WHEN n = 1 THEN 1 ELSE s / (n * (n - 1) / 2) END, 6) AS consensus
  FROM (SELECT user_id, count(*) AS n FROM r GROUP BY user_id) LEFT JOIN p USING (user_id)""")
def interval_consensus(spark, sf_dir):
    """How far the ranges of a user's events agree."""
    return consensus.interval_consensus(_ranges(spark, sf_dir), "user_id", "low", "high").withColumn("consensus", F.round("consensus", 6))
