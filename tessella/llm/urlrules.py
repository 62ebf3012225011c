"""URL filters: host rules, and association rules mined from labelled URLs with Spark's FP-growth.

A URL becomes the set of its tokens: its scheme, all host labels with their place
from the end, all path words with a letter, the names of all query parameters.
FP-growth finds frequent token sets among labelled URLs; rules that end in "block"
with enough confidence and support stay, less any that a shorter rule already
covers. Tokens that no such rule of several tokens can hold are taken out
beforehand, which loses no rule and keeps item sets few: those in too few blocked
URLs, those in every URL, and those that are a rule by themselves. Rules are matched
through an inverted index: each rule stands under its rarest token, the tokens of
every URL are looked up, and a rule fits if the URL has all its tokens. Labels
are what the host rules say of the pages they fit. Rules are mined from two thirds
of the labelled URLs; one stays if it fits some of the others, and is as precise
there. Rules of schemes and last host labels alone are left out: such tokens say
where the host rules look, not what a page is.

Defined results: a null URL, or one without ://, has an empty host and path and
no tokens; it is allowed. Repeated rows are judged alike; nothing labelled, or no
rule that is confident enough, allows all that the host rules leave open.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, lower_ascii, stored

#: (host, path, verdict), the contract's fixed rules.
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LEAST_SUPPORT = 0.005
LEAST_CONFIDENCE = 0.95
#: URLs that a rule's tokens must hold together, whatever their share.
LEAST_URLS = 10
BLOCK = "=block"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host_: Column, path_: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits."""
    name, verdict = F, F
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.reverse(F.split(host(url), r"\.", -1))
    at = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    lettered = F.filter(F.split(path(url), r"[^A-Za-z0-9]+", -1), lambda x: x.rlike("[A-Za-z]"))
    words = F.transform(lettered, lambda x: F.concat(F.lit("p:"), lower_ascii(x)))
    names = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    query = F.transform(names, lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    whole = F.array_distinct(F.concat(scheme, at, words, query))
    return F.when(url.isNotNull() & url.contains("://"), whole).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, n: int, url: str, label: str, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rules (items, confidence, support) for "block" from ``n`` labelled URLs, written to the shared folder; ``label`` is block or allow."""
    sets = labelled.where(F.col(label).isin("block", "allow")).select((F.col(label) == "block").alias("bad"), tokens(F.col(url)).alias("items"))
    least = min(1.0, max(support, LEAST_URLS / n))
    each = sets.select("bad", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("k"), F.count_if("bad").alias("b"))
    each = stored(each.where(F.col("b") >= math.ceil(least * n)), "url-tokens")
    # a token that every URL holds changes no confidence; it can only be a rule where all tokens are
    alone = each.where(F.col("b") / F.col("k") >= confidence).select(F.array("item").alias("items"), (F.col("b") / F.col("k")).alias("confidence"), (F.col("b") / n).alias("support"))
    mixed = each.where((F.col("b") / F.col("k") < confidence) & (F.col("k") < n))
    known = F.array(*[F.lit(r["item"]) for r in mixed.collect()]).cast("array<string>")
    left = sets.select(F.concat(F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")), F.array_intersect("items", known)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(left)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK) & ~F.array_contains("antecedent", BLOCK))
    rules = stored(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support").unionByName(alone), "rules")
    # a rule is left out if its items contain those of another: each smaller item set is looked up by its rarest item
    short = rules.select(F.col("items").alias("small"), F.explode("items").alias("item"))
    covered = (
        rules.withColumn("item", F.explode("items"))
        .join(short, "item")
        .where((F.size("small") < F.size("items")) & (F.size(F.array_except("small", "items")) == 0))
        .select("items")
        .distinct()
    )
    return rules.join(covered, "items", "left_anti")


def matched(urls: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """The distinct URLs that a rule fits."""
    rarity = rules.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    by_item = rules.select("items", F.explode("items").alias("item")).join(rarity, "item")
    index = by_item.groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    looked = urls.select(F.col(url).alias("url_")).distinct().withColumn("tokens_", tokens(F.col("url_"))).withColumn("item", F.explode("tokens_"))
    return looked.join(index, "item").where(F.size(F.array_except("items", "tokens_")) == 0).select("url_").distinct()


def precision(rules: DataFrame, labelled: DataFrame, url: str, label: str) -> DataFrame:
    """(items, fitted, precision): how many labelled URLs each rule fits, and the share of them that is block."""
    rarity = rules.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    index = rules.select("items", F.explode("items").alias("item")).join(rarity, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    looked = labelled.select((F.col(label) == "block").alias("bad"), tokens(F.col(url)).alias("tokens_")).withColumn("item", F.explode("tokens_"))
    fits = looked.join(index, "item").where(F.size(F.array_except("items", "tokens_")) == 0)
    return fits.groupBy("items").agg(F.count("*").alias("fitted"), (F.count_if("bad") / F.count("*")).alias("precision"))


def learned(labelled: DataFrame, url: str, label: str, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rules (items, confidence, support, fitted, precision) mined from two thirds of the URLs and confirmed on the last one."""
    held = F.pmod(F.xxhash64(F.lit(1), F.col(url)), F.lit(3)) == 0
    train, test = labelled.where(~held), labelled.where(held)
    n = train.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, fitted long, precision double")
    found = mine(train, n, url, label, confidence=confidence)
    found = found.where(F.exists("items", lambda x: ~(x.startswith("s:") | x.startswith("h0:"))))
    return stored(found.join(precision(found, test, url, label), "items").where(F.col("precision") >= confidence), "confirmed")


def judged(pages: DataFrame, url: str = "url", rules=HOST_RULES) -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with columns for host, path, rule and verdict; the second value maps those names to the columns."""
    names = {n: fresh(pages, n) for n in ("host", "path", "rule", "verdict")}
    out = pages.withColumn(names["host"], host(F.col(url))).withColumn(names["path"], path(F.col(url)))
    rule, verdict = host_rule(F.col(names["host"]), F.col(names["path"]), rules)
    out = out.withColumn(names["rule"], rule).withColumn(names["verdict"], verdict)
    found = learned(out.where(F.col(names["verdict"]).isNotNull()).select(F.col(url), F.col(names["verdict"])), url, names["verdict"])
    blocked = matched(out.where(F.col(names["verdict"]).isNull()).select(url), found, url)
    key, mark = fresh(out, "url_"), fresh(out, "blocked_")
    blocked = blocked.select(F.col("url_").alias(key), F.lit(True).alias(mark))
    out = out.join(blocked, out[url] == blocked[key], "left")
    final = F.coalesce(F.col(names["verdict"]), F.when(F.col(mark), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn(names["verdict"], final).drop(key, mark), names
