"""Comparison of ordered, sectioned collections of members (canons of books, catalogues of parts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common(df: DataFrame, group: str, member: str, groups: list | None = None) -> DataFrame:
    """Members of every group (or of all the given ones)."""
    d = df.select(group, member).distinct()
    if groups is not None:
        d = d.where(F.col(group).isin(*groups))
        return d.groupBy(member).agg(F.count("*").alias("n")).where(F.col("n") == len(set(groups))).select(member)
    n = d.agg(F.count_distinct(group).alias("groups"))
    return d.groupBy(member).agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("groups")).select(member)


def only_in(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member) of members that one group alone has."""
    return df.select(group, member).distinct().groupBy(member).agg(F.count("*").alias("n"), F.first(group).alias(group)).where("n = 1").select(group, member)


def covering(df: DataFrame, group: str, member: str, wanted: DataFrame) -> DataFrame:
    """Groups that have all of ``wanted`` (member): relational division."""
    n = wanted.select(member).distinct().agg(F.count("*").alias("wanted"))
    d = df.select(group, member).distinct().join(wanted.select(member).distinct(), member)
    return d.groupBy(group).agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("wanted")).select(group)


def compare(df: DataFrame, a, b, group: str, member: str) -> DataFrame:
    """(member, side): common, or only in one of two groups."""
    x = df.where(F.col(group) == a).select(member).distinct().withColumn("in_a", F.lit(True))
    y = df.where(F.col(group) == b).select(member).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_a") & F.col("in_b"), "common").when(F.col("in_a"), "only_a").otherwise("only_b")
    return x.join(y, member, "full").select(member, side.alias("side"))


def similarity_matrix(df: DataFrame, group: str, member: str, order: str, section: str) -> DataFrame:
    """(a, b, common, score) for pairs of groups with a common member:
    0.5 Jaccard + 0.25 (1 - share of moved members) + 0.25 (1 - share in other sections). A member has moved if its
    relative place differs by over 5 %."""
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    cols = lambda p: sized.select(F.col(group).alias(f"{p}"), F.col(member), (F.col(order) / F.col("_n")).alias(f"{p}_pos"), F.col(section).alias(f"{p}_sec"), F.col("_n").alias(f"{p}_n"))
    pairs = cols("a").join(cols("b"), member).where("a < b")
    g = pairs.groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("common"), F.count_if(F.abs(F.col("a_pos") - F.col("b_pos")) > 0.05).alias("moved"), F.count_if(F.col("a_sec") != F.col("b_sec")).alias("resectioned"))
    score = 0.5 * F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common")) + 0.25 * (1 - F.col("moved") / F.col("common")) + 0.25 * (1 - F.col("resectioned") / F.col("common"))
    return g.select("a", "b", "common", score.alias("score"))


def merge(*collections: DataFrame, key: list[str]) -> DataFrame:
    """The union of collections, one row for each key: that of the first collection that has it."""
    from functools import reduce

    numbered = [c.withColumn("_i", F.lit(i)) for i, c in enumerate(collections)]
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), numbered)
    rest = [c for c in whole.columns if c not in (*key, "_i")]
    return whole.groupBy(*key).agg(F.min_by(F.struct(*rest), "_i").alias("_r")).select(*key, "_r.*")


def in_both_directions(edges: DataFrame, reverse: dict[str, str]) -> DataFrame:
    """Edges and their reverses (src, dst, kind), kinds mapped by ``reverse`` or kept."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in reverse.items() for x in p]), F.col("kind")), F.col("kind"))
    return edges.select("src", "dst", "kind").union(edges.select("dst", "src", kind)).distinct()


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def pairs_and_triples(lists: DataFrame, words: str, least: int) -> DataFrame:
    """(phrase, n): runs of two and of three words that the word lists hold ``least`` times or more.

    Each pair travels once, with the word after it (null at the end of a list), and both counts are
    taken where it arrives: the exchange is read twice and made once, and a triple is spelt out only
    if it is returned.
    """
    w, rest = F.col(words), F.greatest(F.size(words), F.lit(1))
    at = F.inline_outer(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), rest).alias("b"), F.slice(w, F.lit(3), rest).alias("c"))).alias("a", "b", "c")
    dealt = lists.select(at).where("b IS NOT NULL").select(F.concat("a", F.lit(" "), "b").alias("pair"), "c").repartition("pair")
    # Both sides read all rows and both columns, or their exchanges would differ.
    pairs = dealt.groupBy("pair").agg(F.count("c").alias("inside"), F.count_if(F.col("c").isNull()).alias("last"))
    pairs = pairs.select(F.col("pair").alias("phrase"), (F.col("inside") + F.col("last")).alias("n")).where(F.col("n") >= least)
    triples = dealt.groupBy("pair", "c").agg(F.count("c").alias("n")).where(F.col("n") >= least)
    return pairs.unionByName(triples.select(F.concat("pair", F.lit(" "), "c").alias("phrase"), "n"))


def without_subphrases(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Phrases that are no part of a longer listed phrase, whatever their counts: the longer ones' parts are exploded and anti-joined."""
    from ..functions.text import ngrams

    words = F.split(F.col(phrase), " ")
    parts = phrases.select(words.alias("_w")).where(F.size("_w") > 2)
    gone = parts.select(F.explode(F.concat(*[F.when(F.size("_w") > n, ngrams(F.col("_w"), n)).otherwise(F.array().cast("array<string>")) for n in range(2, 6)])).alias(phrase)).distinct()
    return phrases.join(gone, phrase, "left_anti")


def most_inclusive(df: DataFrame, group: str, member: str, order: str) -> DataFrame:
    """(group, members) of the group with most members; of equals the first by ``order``. One row."""
    return df.groupBy(group).agg(F.count_distinct(member).alias("members"), F.min(order).alias("_o")).orderBy(F.desc("members"), "_o", group).limit(1).drop("_o")


def first_covering(df: DataFrame, group: str, member: str, wanted: DataFrame, order: str) -> DataFrame:
    """The first group by ``order`` that has all of ``wanted``. One row at most."""
    places = df.groupBy(group).agg(F.min(order).alias("_o"))
    return covering(df, group, member, wanted).join(places, group).orderBy("_o", group).limit(1).select(group)


def in_group(rows: DataFrame, member: str, df: DataFrame, group: str, df_member: str, wanted) -> DataFrame:
    """Rows whose member belongs to the group ``wanted``."""
    own = df.where(F.col(group) == wanted).select(F.col(df_member).alias("_m"))
    return rows.join(own, rows[member] == own["_m"], "left_semi")


def mapped_across(rows: DataFrame, member: str, df: DataFrame, group: str, df_member: str, source, target) -> DataFrame:
    """``rows`` with ``mapped``: the member itself where both groups have it, else null."""
    own = df.where(F.col(group).isin(source, target)).groupBy(F.col(df_member).alias("_m")).agg(F.count_distinct(group).alias("_n"))
    out = rows.join(own, rows[member] == own["_m"], "left")
    return out.withColumn("mapped", F.when(F.col("_n") == len({source, target}), F.col(member))).drop("_m", "_n")


def journey(df: DataFrame, group: str, member: str, order: str, section: str) -> DataFrame:
    """(member, group, in_group, place, section) for every member and every group: where it stands, or that it is missing."""
    groups, members = df.select(group).distinct(), df.select(member).distinct()
    own = df.select(group, member, F.col(order).alias("place"), F.col(section).alias("section"))
    whole = members.withColumn("_k", F.lit(1)).join(groups.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return whole.join(own, [group, member], "left").select(member, group, F.col("place").isNotNull().alias("in_group"), "place", "section")
