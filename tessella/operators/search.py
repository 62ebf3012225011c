"""Inverted index, document frequencies and BM25 ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(term, doc_id, tf, length): counts are made inside each document's row, so nothing is shuffled.

    Sorted equal neighbours of the token list are one posting.
    """
    t = F.array_sort(tokens)
    base = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.size(tokens).alias("length"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.col("length"), F.lit(1))), lambda i: (i <= F.col("length")) & ((i == 1) | (F.get("t", i - 1) != F.get("t", i - 2))))
    base = base.withColumn("s", starts)
    runs = F.transform("s", lambda p, k: F.struct(F.get("t", p - 1).alias("term"), (F.coalesce(F.get("s", k + 1), F.col("length") + 1) - p).alias("tf")))
    return base.select("doc_id", "length", F.explode(runs).alias("r")).select("r.term", "doc_id", "r.tf", "length")


def inverted_index(posted: DataFrame) -> DataFrame:
    """term -> sorted list of documents, for reading back; terms of a closed vocabulary fit a row."""
    return posted.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, doc_id: str, tokens: Column, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with one of ``terms``.

    Only the query's terms leave a document's row; the corpus figures come from one more aggregate.
    """
    wanted = sorted(set(terms))
    base = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t")).withColumn("length", F.size("t"))
    tf = F.array(*[_count(w) for w in wanted])
    rows = base.select("doc_id", "length", F.explode(tf).alias("x")).select("doc_id", "length", "x.term", "x.tf")
    stats = rows.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("int")).alias("df"), F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return rows.where("tf > 0").join(F.broadcast(stats), "term").groupBy("doc_id").agg(F.sum(score).alias("score"))


def _count(word: str) -> Column:
    return F.struct(F.lit(word).alias("term"), F.size(F.filter("t", lambda x: x == word)).alias("tf"))


def top(df: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows of a group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
