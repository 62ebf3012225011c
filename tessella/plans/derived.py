"""Queries over references, ranges, dates, codes and number mappings that Spark writes from the rows of the given tables.

The text of a row is put together from its numbers; the SQL states what must be read from
it out of the same numbers, without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, morphology, refs
from ..operators import quality, versification
from ..operators.graph import cut
from .base import query, table

BOOKS = "book AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}', {o}, {most}, '{t}')" for c, n, o, most, t in refs.book_rows()) + ") AS v(code, name, ord, most, testament))"
#: Each line item names a place: numbers first, then how it is written.
PLACES = f"""{BOOKS}, place AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 4 AS style, code, ord, most, testament, l_linenumber * 5 + l_orderkey % 7 AS ch, l_suppkey % 30 AS v
  FROM lineitem JOIN book ON ord = l_partkey % 66 + 1),
  said AS (SELECT *, CASE WHEN style < 3 THEN code || '.' || ch || '.' || v || CASE WHEN style = 2 THEN 'a' ELSE '' END END AS ref FROM place)"""


def _cat(*parts) -> F.Column:
    return F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])


def _books(spark: SparkSession) -> DataFrame:
    return refs.books(spark).select("code", "name", F.col("book_order").cast("long").alias("ord"))


def _with_book(spark: SparkSession, rows: DataFrame, number: str, key: list[str]) -> DataFrame:
    """Each row with its book. The 66 books go to the rows, which are dealt by their key, four tasks a core: parsing takes far longer than
    their size says, by their book it would fall to a few tasks."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    return rows.withColumn("ord", F.col(number) % 66 + 1).repartition(tasks, *key).join(F.broadcast(_books(spark)), "ord")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``written``, a place in one of four spellings (one of them names no book)."""
    li = _with_book(spark, table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey"])
    ch, v, style = F.col("l_linenumber") * 5 + F.col("l_orderkey") % 7, F.col("l_suppkey") % 30, F.col("l_quantity").cast("long") % 4
    written = F.when(style == 0, _cat(F.col("code"), ".", ch, ".", v)).when(style == 1, _cat(F.col("name"), " ", ch, ":", v)).when(style == 2, _cat(F.lower("name"), " ", ch, ":", v, "A")).otherwise(_cat("Nothing ", ch, ":", v))
    return li.select("l_orderkey", "l_linenumber", written.alias("written"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``r``, the reference parsed from what is written."""
    return _said(spark, sf_dir).select("l_orderkey", "l_linenumber", refs.parse_verse_id(F.col("written")).alias("r"))


@query(f"WITH {PLACES} SELECT l_orderkey, l_linenumber, ref, style < 3 AND ch BETWEEN 1 AND most AND v >= 1 AS valid FROM said")
def reference_parsing(spark, sf_dir):
    return _places(spark, sf_dir).select("l_orderkey", "l_linenumber", refs.canonical(F.col("r")).alias("ref"), refs.is_valid(F.col("r")).alias("valid"))


@query(f"WITH {PLACES} SELECT testament, count(DISTINCT code) AS books, count(DISTINCT code || ch) AS chapters, count(*) AS places FROM said WHERE ref IS NOT NULL GROUP BY testament")
def book_dimension(spark, sf_dir):
    # each different text is parsed once; written first, as filters on what was parsed would else move below the count
    texts = cut(_said(spark, sf_dir).groupBy("written").agg(F.count("*").alias("n"))).select(refs.parse_verse_id(F.col("written")).alias("r"), "n")
    p = texts.where("r IS NOT NULL").select(F.col("r.book").alias("code"), F.col("r.chapter").alias("ch"), "n").groupBy("code", "ch").agg(F.sum("n").alias("n"))
    per_book = p.groupBy("code").agg(F.count("*").alias("c"), F.sum("n").alias("n")).join(refs.books(spark), "code")
    return per_book.groupBy("testament").agg(F.count("*").alias("books"), F.sum("c").alias("chapters"), F.sum("n").alias("places"))


@query(f"""WITH {PLACES} SELECT l_orderkey, ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord, ch, v, style = 2) AS place
  FROM (SELECT DISTINCT l_orderkey, ref, ord, ch, v, style = 2 AS style FROM said WHERE ref IS NOT NULL)""".replace("style = 2) AS place", "style) AS place"))
def canonical_order(spark, sf_dir):
    """Different references of each order, in canonical order; a whole verse stands before its parts."""
    # exploded, as a filter would parse once more; line items are dealt by their order, so nothing else is shuffled
    r = _places(spark, sf_dir).select("l_orderkey", F.explode(F.filter(F.array("r"), lambda x: x.isNotNull())).alias("r")).distinct()
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*refs.sort_key(F.col("r"))))
    return r.select("l_orderkey", refs.canonical(F.col("r")).alias("ref"), place.cast("long").alias("place"))


SPANS = f"""{BOOKS}, span AS (SELECT o_orderkey, o_orderkey % 3 AS style, code, most, o_orderkey % 5 + 1 AS ch, o_custkey % 20 + 1 AS a, o_orderkey // 3 % 25 + 1 AS b FROM orders JOIN book ON ord = o_custkey % 66 + 1)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _with_book(spark, table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"])
    return o.select("o_orderkey", "code", "name", (F.col("o_orderkey") % 3).alias("style"), (F.col("o_orderkey") % 5 + 1).alias("ch"), (F.col("o_custkey") % 20 + 1).alias("a"), (F.floor(F.col("o_orderkey") / 3) % 25 + 1).alias("b"))


@query(f"""WITH {SPANS}, good AS (SELECT *, style = 2 OR b >= a AND (style = 0 OR ch <= most) AS ok FROM span)
  SELECT o_orderkey, CASE WHEN ok THEN code || '.' || ch || '.' || a END AS first, CASE WHEN ok THEN code || '.' || (ch + CASE WHEN style = 2 THEN 1 ELSE 0 END) || '.' || b END AS last FROM good""")
def range_parsing(spark, sf_dir):
    """Ranges in all three spellings; reversed ones, and short ones beyond the book, are none."""
    s, c = _spans(spark, sf_dir), F.col
    written = F.when(c("style") == 0, _cat(c("code"), ".", c("ch"), ".", c("a"), "-", c("code"), ".", c("ch"), ".", c("b"))).when(c("style") == 1, _cat(c("name"), " ", c("ch"), ":", c("a"), "-", c("b")))
    r = refs.verse_range(written.otherwise(_cat(c("name"), " ", c("ch"), ":", c("a"), " - ", c("name"), " ", c("ch") + 1, ":", c("b"))))
    return s.select("o_orderkey", refs.canonical(r["start"]).alias("first"), refs.canonical(r["end"]).alias("last"))


@query(f"""WITH {SPANS}, t AS (SELECT *, code || '.' || (ch + 1) || '.' || b AS one, list_transform(range(a, b + 1), lambda x: code || '.' || ch || '.' || x) AS many FROM span)
  SELECT o_orderkey, array_to_string(list_append(many[1:1], one), ' ') AS firsts, array_to_string(list_append(many, one), ' ') AS verses FROM t""")
def reference_lists(spark, sf_dir):
    """Lists of a range, a single place and a word that is none: the first verse of each, and all verses."""
    s, c = _spans(spark, sf_dir), F.col
    written = _cat(c("code"), " ", c("ch"), ":", c("a"), "-", c("b"), "; ", c("name"), " ", c("ch") + 1, ":", c("b"), ", nothing ;")
    say = lambda a: F.array_join(F.transform(a, refs.canonical), " ")
    spans = s.select("o_orderkey", refs.reference_spans(written).alias("spans"))
    return spans.select("o_orderkey", say(refs.span_verses(c("spans"))).alias("firsts"), say(refs.span_verses(c("spans"), True)).alias("verses"))


NUMBERS = "n AS (SELECT event_id, event_id % 8 AS style, CAST(event_id // 8 % 900 + 1 AS INT) AS a, CAST(event_id // 8 % 900 + 1 + user_id % 60 AS INT) AS b FROM events)"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.floor(F.col("event_id") / 8) % 900 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8).alias("style"), a.alias("a"), (a + F.col("user_id") % 60).cast("int").alias("b"))


def _phrase(forms: list[tuple]) -> F.Column:
    out = F
    for i, parts in enumerate(forms):
        out = out.when(F.col("style") == i, _cat(*parts))
    return out


@query(f"""WITH {NUMBERS} SELECT event_id, CASE style WHEN 0 THEN -a WHEN 1 THEN -b WHEN 2 THEN a WHEN 3 THEN a - 5 WHEN 4 THEN -a - 5 WHEN 5 THEN -b WHEN 6 THEN a END AS earliest,
  CASE style WHEN 0 THEN -a WHEN 1 THEN -a WHEN 2 THEN a WHEN 3 THEN a + 5 WHEN 4 THEN -a + 5 WHEN 5 THEN -a WHEN 6 THEN b END AS latest FROM n""")
def date_phrases(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    forms = [(a, " BCE"), (b, "-", a, " BCE"), ("AD ", a), (a, " ± 5 CE"), (a, " ± 5 BCE"), (b, "/", a, " BC"), (a, "-", b, " CE"), ("no date",)]
    r = dates.year_range(_phrase(forms))
    return _numbers(spark, sf_dir).select("event_id", r["earliest"].alias("earliest"), r["latest"].alias("latest"))


@query(f"""WITH {NUMBERS}, r AS (SELECT *, -715 + b - 1 AS nth FROM n)
  SELECT event_id, CASE style WHEN 0 THEN 'year' WHEN 1 THEN 'range' WHEN 2 THEN 'circa' WHEN 3 THEN 'range' WHEN 4 THEN 'regnal' WHEN 5 THEN 'reign' WHEN 6 THEN 'relative' ELSE 'undated' END AS kind,
  CASE style WHEN 0 THEN -a WHEN 1 THEN -b WHEN 2 THEN -a - 25 WHEN 3 THEN -b WHEN 4 THEN CASE WHEN nth BETWEEN -715 AND -686 THEN nth END WHEN 5 THEN -640 END AS earliest,
  CASE style WHEN 0 THEN -a WHEN 1 THEN -a WHEN 2 THEN -a + 25 WHEN 3 THEN -a WHEN 4 THEN CASE WHEN nth BETWEEN -715 AND -686 THEN nth END WHEN 5 THEN -609 END AS latest,
  CASE style WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 WHEN 3 THEN 0.8 WHEN 4 THEN CASE WHEN nth BETWEEN -715 AND -686 THEN 0.85 ELSE 0.2 END WHEN 5 THEN 0.8 WHEN 6 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN style = 6 THEN -a END AS moved FROM r""")
def date_forms(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    forms = [(a, " BCE"), (b, "-", a, " BCE"), ("c. ", a, " BCE"), ("between ", b, " and ", a, " BC"), (b, "th year of Hezekiah"), ("during the reign of Josiah",), (a, " years before the exile"), (a, "th day of first month")]
    d = dates.parse_date(_phrase(forms))
    return _numbers(spark, sf_dir).select("event_id", *[d[c].alias(c) for c in ("kind", "earliest", "latest", "confidence")], d["offset"].alias("moved"))


@query(f"""WITH {NUMBERS}, s AS (SELECT event_id, b * -2 AS low, b * -2 + a * 3 AS high FROM n), p AS (SELECT *, greatest((high - low) / 10.0, 1.0) AS raw FROM s), q AS (SELECT *, pow(10, floor(log10(raw))) AS p FROM p),
  t AS (SELECT *, CAST(CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS INT) AS step FROM q)
  SELECT event_id, low, high, array_to_string(list_filter(list_transform(range(0, 40), lambda i: CAST(ceil(low / step) AS INT) * step + i * step), lambda x: x <= high), ' ') AS ticks FROM t""")
def axis_ticks(spark, sf_dir):
    n = _numbers(spark, sf_dir).select("event_id", (F.col("b") * -2).alias("low"), (F.col("b") * -2 + F.col("a") * 3).alias("high"))
    return n.withColumn("ticks", F.array_join(F.transform(dates.axis_ticks(F.col("low"), F.col("high")), lambda x: x.cast("string")), " "))


@query("""WITH c AS (SELECT event_id, event_id % 3 AS style, user_id % 2 = 0 AS q, event_id // 3 % 2 = 0 AS m, event_id // 6 % 2 = 0 AS s, CAST(user_id % 3 + 1 AS VARCHAR) AS p FROM events)
  SELECT event_id, CASE WHEN style = 1 THEN 'noun' ELSE 'verb' END AS pos, CASE WHEN style <> 1 THEN CASE WHEN q THEN 'qal' ELSE 'hiphil' END END AS stem,
  CASE style WHEN 0 THEN 'perfect' WHEN 2 THEN 'active participle' END AS form, CASE WHEN style = 0 THEN p END AS person, CASE WHEN m THEN 'masculine' ELSE 'feminine' END AS gender, CASE WHEN s THEN 'singular' ELSE 'plural' END AS number FROM c""")
def morphology_codes(spark, sf_dir):
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    e, style = table(spark, sf_dir, "events"), F.col("event_id") % 3
    stem, person = pick(F.col("user_id") % 2 == 0, "q", "h"), F.col("user_id") % 3 + 1
    gender, number = pick(F.floor(F.col("event_id") / 3) % 2 == 0, "m", "f"), pick(F.floor(F.col("event_id") / 6) % 2 == 0, "s", "p")
    code = F.when(style == 0, _cat("HC/V", stem, "p", person, gender, number)).when(style == 1, _cat("HNc", gender, number, "a")).otherwise(_cat("HV", stem, "r", gender, number, "a"))
    m = morphology.hebrew(code)
    return e.select("event_id", *[m[f].alias(f) for f in ("pos", "stem", "form", "person", "gender", "number")])


@query("""WITH c AS (SELECT l_suppkey, count(*) AS expected, count(*) FILTER (l_quantity > 1) - CASE WHEN l_suppkey % 10 = 0 THEN count(*) FILTER (l_quantity > 1) ELSE 0 END AS actual FROM lineitem GROUP BY l_suppkey)
  SELECT l_suppkey, expected, actual, CASE WHEN expected = actual THEN 'ok' WHEN actual = 0 OR abs(actual - expected) / expected > 0.05 THEN 'error' ELSE 'warning' END AS status FROM c""")
def count_validation(spark, sf_dir):
    """Lines of each supplier against those that arrived: of every tenth supplier none, of others all but single pieces."""
    arrived = (F.col("l_quantity") > 1) & (F.col("l_suppkey") % 10 != 0)
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("expected"), F.count_if(arrived).alias("actual"))
    return quality.check_counts(c, "expected", "actual")


# Maps between two numberings of the parts, P.<size>.<key + 1>. Of four parts in turn, the first has an entry from a
# to b (and one back, which only every other time leads home), the second one from b to a only, the third is split in
# two, and the fourth is left to its size's entry (even sizes) or to itself.
MAPS = """p AS (SELECT p_partkey AS k, p_size AS s, p_partkey + 1 AS v FROM part), m AS (
  SELECT 'a' AS f, 'b' AS t, 1 AS n, 1.0 AS c FROM p WHERE k % 4 = 0 UNION ALL SELECT 'b', 'a', 1, 0.5 FROM p WHERE k % 4 = 0 UNION ALL SELECT 'b', 'a', 1, 0.9 FROM p WHERE k % 4 = 1
  UNION ALL SELECT 'a', 'b', 2, 0.7 FROM p WHERE k % 4 = 2 UNION ALL SELECT 'a', 'b', 1, 0.8 FROM (SELECT DISTINCT s FROM p WHERE s % 2 = 0))"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))


def _at(size: F.Column, part: bool = True) -> F.Column:
    return _cat("P.", size, ".", F.col("k") + 1 if part else F.lit(0))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, turn = _parts(spark, sf_dir), F.col("s"), F.col("k") % 4

    def entries(rows: DataFrame, f: str, t: str, src: F.Column, dst: list, sure: float) -> DataFrame:
        return rows.select(F.lit(f).alias("from_sys"), F.lit(t).alias("to_sys"), src.alias("src"), F.array(*dst).alias("dst"), F.lit("m").alias("kind"), F.lit(sure).alias("confidence"))

    home = F.when(F.col("k") % 8 == 0, _at(s)).otherwise(_at(s + 2))
    sizes = p.where("s % 2 = 0").select("s").distinct()
    return (
        entries(p.where(turn == 0), "a", "b", _at(s), [_at(s + 1)], 1.0)
        .unionByName(entries(p.where(turn == 0), "b", "a", _at(s + 1), [home], 0.5))
        .unionByName(entries(p.where(turn == 1), "b", "a", _at(s + 1), [_at(s)], 0.9))
        .unionByName(entries(p.where(turn == 2), "a", "b", _at(s), [_at(s), _at(s + 1)], 0.7))
        .unionByName(entries(sizes, "a", "b", _at(s, False), [_at(s + 100, False)], 0.8))
    )


@query(f"""WITH {MAPS} SELECT 'P.' || s || '.' || v AS ref, CASE WHEN k % 4 IN (0, 1) THEN 'P.' || (s + 1) || '.' || v WHEN k % 4 = 2 THEN 'P.' || s || '.' || v || ',P.' || (s + 1) || '.' || v
  WHEN s % 2 = 0 THEN 'P.' || (s + 100) || '.' || v ELSE 'P.' || s || '.' || v END AS targets, CASE WHEN k % 4 IN (0, 2) THEN 'exact' WHEN k % 4 = 1 THEN 'reverse' WHEN s % 2 = 0 THEN 'chapter' ELSE 'same' END AS rule,
  CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE CASE WHEN s % 2 = 0 THEN 0.8 ELSE 1.0 END END::DOUBLE AS confidence FROM p""")
def verse_map_priority(spark, sf_dir):
    r = _parts(spark, sf_dir).select(_at(F.col("s")).alias("ref"), F.lit("a").alias("from_sys"), F.lit("b").alias("to_sys"))
    return versification.resolve(r, _maps(spark, sf_dir)).select("ref", F.array_join("targets", ",").alias("targets"), "rule", "confidence")


@query(f"""WITH {MAPS} SELECT 'a' AS from_sys, 'P.' || s || '.' || v AS src, k % 8 = 0 AS holds FROM p WHERE k % 4 = 0 UNION ALL SELECT 'b', 'P.' || (s + 1) || '.' || v, true FROM p WHERE k % 8 = 0""")
def roundtrip_mapping(spark, sf_dir):
    return versification.round_trips(_maps(spark, sf_dir)).select("from_sys", "src", "holds")


@query(f"""WITH {MAPS} SELECT f AS from_sys, t AS to_sys, count(*) AS entries, count(*) FILTER (n = 1) AS exact, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 1) AS complex, round(avg(c::DOUBLE), 6) AS confidence FROM m GROUP BY f, t""")
def mapping_statistics(spark, sf_dir):
    return versification.statistics(_maps(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
