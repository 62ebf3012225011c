"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

The base patterns give spans with code point offsets: the text is split at the
matches, and a match starts after all pieces and matches before it.

Bootstrapping: base matches are the seed entities. The word before an occurrence,
and the two words before it, are its lexical patterns (letters lower-cased, digits
as #, without punctuation around a word). All identifier-like tokens of the corpus
with their patterns form a bipartite graph. A pattern's confidence is the sum of
its instances' scores over all places of its words in the corpus, identifiers or
not, so common words before identifiers are no evidence. It is supported if
LEAST_SEEDS different instances are sure. An instance scores the highest
confidence of its supported patterns; seeds stay at 1. Scores only rise, and are
computed until none rises any more. Sure patterns mark their other instances:
spans of kind "context".

Patterns that could not be sure if all of their instances were are dropped before
the rounds, so no frequent word is a join key in them; all aggregations combine
before they shuffle.

Defined results: null text is empty and has no spans; repeated rows get the same
spans; equal texts under one id share a key; rows with a null id are told apart by
their text; an empty table gives an empty result; a context word must lie whole in
the CONTEXT_CHARS code points before the identifier, or there is no pattern; ties
don't arise, as all sure patterns count; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, stored

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "context")
#: The contract's patterns. Look-arounds and possessive repeats only save the search from starting inside a run
#: whose start has failed; ``\G`` is where the last match ended. The card pattern holds the whole chain of 16 to 19 digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match holds: texts without it skip the pattern.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: A token with a digit or @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LEAST_DIGITS = 5
CONTEXT_CHARS = 256
LEAST_CONFIDENCE = 0.8
LEAST_SEEDS = 3
#: A rise of a score below this counts as none.
LEAST_RISE = 1e-6
#: Texts without it have no base span and no candidate.
MAY = r"@|\+[0-9]|[0-9]\.[0-9]|[0-9](?:\S*?[0-9]){4}|[0-9](?:[\x20-]?[0-9]){15}"
_CHUNK = 64

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value); prefix sums go over chunks of _CHUNK matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"), m.alias("v")))

    def with_steps(s: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x["p"] + x["m"])
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int")), lambda c: total(F.slice(s, c * _CHUNK + 1, _CHUNK)))
        before = lambda cs, i: F.aggregate(F.slice(cs, 1, F.floor(i / _CHUNK).cast("int")), F.lit(0), lambda acc, x: acc + x)

        def place(cs: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                first = F.floor(i / _CHUNK).cast("int") * _CHUNK
                start = before(cs, i) + total(F.slice(s, first + 1, i - first)) + x["p"]
                return F.struct(start.alias("start"), (start + x["m"]).alias("end"), x["v"].alias("value"))

            return F.transform(s, one)

        return F.flatten(F.transform(F.array(chunks), place))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.flatten(F.transform(F.array(steps), lambda s: F.when(F.size(s) > 0, with_steps(s)).otherwise(none)))


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans (kind, start, end, value), by kind as listed, then start."""
    none = F.array().cast(_SPAN)

    def of_kind(kind: str) -> Column:
        good = F.filter(_located(text, PATTERNS[kind]), lambda x: _holds(kind, x["value"]))
        spans = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        needed = text.contains("@") if kind == "email" else text.rlike(NEEDS[kind])
        return F.when(needed, spans).otherwise(none)

    return F.concat(*map(of_kind, KINDS))


def candidates(text: Column, base: Column) -> Column:
    """Tokens with at least LEAST_DIGITS digits, trimmed of outer punctuation, that no base span touches."""
    located = F.filter(_located(text, TOKEN), lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]+", "")) >= LEAST_DIGITS)

    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["value"], r"^[^\p{L}\p{N}+]*", 0))
        value = F.regexp_extract(x["value"], r"^[^\p{L}\p{N}+]*+((?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++)*+)", 1)
        start = x["start"] + lead
        return F.struct(F.lit("context").alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    free = F.filter(F.transform(located, trimmed), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.when(text.rlike("[0-9]"), free).otherwise(F.array().cast(_SPAN))


def normal_words(text: Column) -> Column:
    """The words of a text as patterns have them: lower case, digits as #, no punctuation around them."""
    plain = F.translate(F.lower(text), "0123456789", "#" * 10)
    plain = F.regexp_replace(plain, r"(?<!\S)[^\p{L}\p{N}\s#]++|(?<![^\p{L}\p{N}\s#])[^\p{L}\p{N}\s#]++(?!\S)", "")
    return F.split(plain, r"\s+", -1)


def patterns_of(text: Column, start: Column) -> Column:
    """The patterns of a place: the word before it, and the two words before it, where they are there."""
    from_ = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    left = F.substring(text, from_ + 1, start - from_)
    # what is attached to the identifier, like a bracket, is no word
    left = F.regexp_replace(left, r"[^\p{L}\p{N}\s]+$", "")
    # a word that may begin before the window is left out
    whole = F.when(from_ > 0, F.regexp_replace(left, r"^\S+", "")).otherwise(left)

    def build(words: Column) -> Column:
        one, two = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
        good = lambda w: w.isNotNull() & (w != "")
        return F.filter(F.array(F.when(good(one), one), F.when(good(one) & good(two), F.concat(two, F.lit(" "), one))), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(normal_words(F.rtrim(F.regexp_replace(whole, r"\s", " ")))), build), F.lit(0))


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each row of ``docs``: id_, key_ (hash of the text), base spans, and seen_ (spans with patterns)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.select(F.col(f"`{doc_id}`").alias("id_"), t.alias("t_"))
    out = out.withColumn("base_", base_spans(F.col("t_")))
    out = out.withColumn("free_", candidates(F.col("t_"), F.col("base_")))
    seen = F.transform(
        F.concat("base_", "free_"),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), patterns_of(F.col("t_"), x["start"]).alias("patterns")),
    )
    slim = F.transform("base_", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select("id_", F.xxhash64("t_").alias("key_"), slim.alias("base_"), seen.alias("seen_"))


def places(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(pattern, places): how often the words of each pattern of ``wanted`` stand in the corpus."""
    words = docs.select(normal_words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("w"))
    each = words.select(F.explode(F.expr("flatten(transform(w, (x, i) -> IF(i > 0, array(x, concat(w[i - 1], ' ', x)), array(x))))")).alias("pattern"))
    return each.join(wanted.select("pattern"), "pattern").groupBy("pattern").agg(F.count("*").alias("places"))


def sure_patterns(rows: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(pattern, confidence): the patterns that are sure when no score rises any more; ``rows`` as occurrences() gives them."""
    keep = lambda df, name: stored(df, name, scratch)
    seen = rows.where(F.size("seen_") > 0).select(F.explode("seen_").alias("x")).select("x.kind", "x.value", F.explode("x.patterns").alias("pattern"))
    edges = keep(seen.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max((F.col("kind") != "context").cast("int")).alias("seed")), "edges")
    wanted = keep(edges.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("different")).where(F.col("different") >= LEAST_SEEDS), "wanted")
    total = F.greatest("n", F.coalesce("places", F.lit(0)))
    viable = wanted.join(places(docs, wanted, text), "pattern", "left").withColumn("places", total)
    viable = keep(viable.where(F.col("n") / (F.col("places") + 1) >= LEAST_CONFIDENCE).select("pattern", "places"), "viable")
    # an identifier that is a seed somewhere is one everywhere
    seeds = edges.groupBy("value").agg(F.max("seed").alias("is_seed")).where("is_seed = 1")
    scores = edges.join(viable, "pattern").join(seeds, "value", "left")
    scores = keep(scores.withColumn("score", F.coalesce(F.col("is_seed"), F.lit(0)).cast("double")).drop("is_seed"), "scores")
    while True:
        confident = scores.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.max("places") + 1)).alias("confidence"), F.count_if(F.col("score") >= LEAST_CONFIDENCE).alias("sure"))
        confident = keep(confident.where(F.col("sure") >= LEAST_SEEDS).select("pattern", "confidence"), "patterns")
        reached = scores.join(confident, "pattern").groupBy("value").agg(F.max("confidence").alias("reached"))
        after = scores.join(reached, "value", "left").withColumn("rise", F.greatest(F.coalesce("reached", F.lit(0.0)) - F.col("score"), F.lit(0.0)))
        scores = keep(after.withColumn("score", F.col("score") + F.col("rise")).drop("reached"), "scores")
        risen = scores.where(F.col("rise") > LEAST_RISE).head(1)
        scores = scores.drop("rise")
        if not risen:
            return confident.where(F.col("confidence") >= LEAST_CONFIDENCE)


def discovered(rows: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(id_, key_, found_): the context spans that sure patterns find, of ``rows`` as occurrences() gives them."""
    good = sure_patterns(rows, docs, text, scratch).select("pattern")
    seen = rows.where(F.size("seen_") > 0).select("id_", "key_", F.explode("seen_").alias("x")).where("x.kind = 'context'").select("id_", "key_", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    found = seen.join(good, "pattern", "left_semi")
    return found.groupBy("id_", "key_").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found_"))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id_, key_, and spans_ (kind, start, end): base ones by kind and start, then those of the method."""
    scratch = Scratch(docs.sparkSession)
    rows = stored(occurrences(docs, doc_id, text), "spans", scratch)
    found = discovered(rows, docs, text, scratch)
    joined = rows.alias("r").join(found.alias("f"), F.col("r.id_").eqNullSafe(F.col("f.id_")) & (F.col("r.key_") == F.col("f.key_")), "left")
    more = F.transform("f.found_", lambda x: F.struct(F.lit("context").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    out = stored(joined.select("r.id_", "r.key_", F.concat("r.base_", F.coalesce(more, none)).alias("spans_")), "detected")
    scratch.drop()
    return out


def say(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans, and all spans."""
    s = F.col("spans_")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(s, lambda x: x["kind"] != "context")
    return detect(docs, doc_id, text).select(F.col("id_").alias(doc_id), *[count(k) for k in KINDS], F.sha2(say(base), 256).alias("base_sha256"), say(s).alias("spans"))


def redact_text(text: Column, spans: Column) -> Column:
    """``text`` with each stretch of overlapping spans replaced by the first one's kind in brackets."""
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    reach = lambda a, i: F.coalesce(F.array_max(F.transform(F.slice(a, 1, i), lambda y: y["end"])), F.lit(0))

    def build(a: Column) -> Column:
        heads = F.filter(F.transform(a, lambda x, i: F.struct(x["start"].alias("start"), reach(a, i).alias("from"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])
        parts = F.transform(heads, lambda x: F.concat(F.substring(text, x["from"] + 1, x["start"] - x["from"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substring(text, reach(a, F.size(a)) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(by_start), build), F.lit(0))).otherwise(text)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all spans redacted in ``text``; null stays null. Only texts that may hold a span take part in the join."""
    hits = detect(docs, doc_id, text).where(F.size("spans_") > 0).groupBy("id_", "key_").agg(F.first("spans_").alias("spans_"))
    key = fresh(docs, "key_")
    may = F.coalesce(F.col(f"`{text}`").rlike(MAY), F.lit(False))
    left = docs.where(may).withColumn(key, F.xxhash64(F.col(f"`{text}`")))
    names = {n: fresh(left, n) for n in ("hit_id_", "hit_key_", "hit_spans_")}
    hits = hits.select(F.col("id_").alias(names["hit_id_"]), F.col("key_").alias(names["hit_key_"]), F.col("spans_").alias(names["hit_spans_"]))
    out = left.join(hits, F.col(f"`{doc_id}`").eqNullSafe(F.col(names["hit_id_"])) & (F.col(key) == F.col(names["hit_key_"])), "left")
    spans = F.coalesce(F.col(names["hit_spans_"]), F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.withColumn(text, redact_text(F.col(f"`{text}`"), spans)).select(*columns).unionByName(docs.where(~may).select(*columns))
